"""Sharding, decontamination, packing, chat formatting and toxicity against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probeline.llm import chat, contamination, packing, queries, sharding, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- sharding


def check_shards(out, texts, shards):
    sizes = Counter()
    slots = defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1))
    total, biggest = sum(sizes.values()), max(r["size"] for r in out)
    last = None
    for s in sorted(slots):
        assert 0 <= s < shards
        assert sorted(x for x, _ in slots[s]) == list(range(len(slots[s])))
        own = [d for _, d in sorted(slots[s])]
        assert own == sorted(own) and (last is None or own[0] >= last)
        last = own[-1]
        assert abs(sizes[s] - total / shards) <= 2 * biggest
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_shards_of_documents(spark, small):
    out = rows(queries.op9_sharding(spark, small))
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_shards(out, texts, 16)
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}


def test_shards_of_odd_rows(spark, odd, odd_rows, empty):
    out = rows(sharding.shard_by_bytes(odd, 3))
    check_shards(out, [r[1] for r in odd_rows], 3)
    assert rows(sharding.shard_by_bytes(empty)) == []


# ------------------------------------------------------------ contamination


def plain_contamination(docs, items, length=13):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: find.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(length, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in docs:
        w, hit, own = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[x] - {None}
        names = ",".join(sorted(map(str, own)))
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_of_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op5_decontamination(spark, small).collect()), key=str)
    assert got == plain_contamination(docs, items)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination_of_odd_rows(spark, odd, odd_rows, empty, block):
    items = [(1, "gamma Delta epsilon"), (2, None), (3, ""), (None, "w1 and1"), (4, "A"), (4, "a b c d e"), (5, " ".join(odd_rows[7][1].split()[:15])), (5, "çödé"), (6, "çödé")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.find_contamination(odd, bench, block_bytes=block)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r.hit_items), hashlib.sha256(",".join(sorted(map(str, r.hit_items))).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect()), key=str)
    assert got == plain_contamination([(r[0], r[1]) for r in odd_rows], items)
    assert contamination.find_contamination(empty, bench).count() == 0
    assert {r.n_hit for r in contamination.find_contamination(odd, bench.limit(0)).collect()} == {0}
    clean = contamination.decontaminate(odd, bench.where("item_id = 5"))
    assert clean.columns == odd.columns
    assert 9 not in {r.doc_id for r in clean.collect()}


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(0, "x " * 300 + "One, two THREE; four! " + "y " * 300)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "one two three four")], "item_id long, text string")
    assert contamination.decontaminate(docs, bench).first().text == "x " * 300 + "! " + "y " * 300


# ------------------------------------------------------------------ packing


@given(st.integers(0, 50_000), st.sampled_from([1, 7, 100, 1024]))
def test_pieces_add_up(n, capacity):
    cut = packing.pieces_of(n, capacity)
    assert sum(cut) == n and all(0 < x <= capacity for x in cut)
    assert len(cut) <= n // capacity + 12


def check_packing(out, texts, capacity=1024):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    want = Counter()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    for doc, text in texts.items():
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += r["length"]
        assert at == len(ids)
        want[doc] = len(ids)
    return sum(r["length"] for r in out) / (capacity * len(bins))


def test_packing_of_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert check_packing(rows(queries.op6_packing(spark, small)), texts) > 0.95


def test_packing_of_odd_rows(spark, odd, odd_rows, empty):
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    path = queries.tokenizer_path()
    check_packing(rows(packing.pack(once, path)), {r[0]: r[1] for r in odd_rows if r[0] is not None})
    out = rows(packing.pack(odd, path, keep_ids=True))
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"] for r in out)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert rows(packing.pack(empty, path)) == []


def test_rounds_of_open_bins(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(9)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packing(rows(packing.pack(docs, queries.tokenizer_path(), capacity=256)), texts, 256) > 0.95


# --------------------------------------------------------------------- chat


def plain_chat(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for conv, own in by.items():
        said = [(r, t) for _, _, _, r, _, t in sorted(own)]
        loss = "".join(t for r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        out.append((conv, len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted((tuple(r)[:5] for r in df.mapInPandas(queries._read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()), key=str)


def test_chat_of_conversations(spark, small):
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert sorted((tuple(r)[:5] for r in queries.op10_chat_format(spark, small).collect()), key=str) == plain_chat(turns)


def test_chat_of_odd_rows(spark, monkeypatch):
    hard = ["", None, "[INST]", "[\\INST] [/INST]", "<\\/s></s>", "<\\\\/s>", "[TEXT][/TEXT] [", "<", "\\", " lead and trail ", "é\n\x00", "[ANSWER] x" * 5000]
    turns = [(c, i, role, t) for c in (1, 2, None) for i, t in enumerate(hard) for role in ("user", "assistant", "system", "tool[TEXT]", None)]
    turns += turns[:10] + [(3, None, "user", "null turn"), (3, 0, "user", "zero"), (4, 0, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    for size in (1 << 20, 50):
        monkeypatch.setattr(chat, "CHUNK", size)
        assert digests(chat.format_conversations(df)) == plain_chat(turns)
    assert chat.format_conversations(df.limit(0)).count() == 0


@settings(max_examples=300)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "[", "<", "/s>", "INST]", "a"]), max_size=12))
def test_escaping_is_reversible(parts):
    text, guard = "".join(parts), chat.ControlStrings(chat.CONTROL)
    assert guard.unescape(guard.escape(text)) == text
    assert not guard.tokens.search(guard.escape(text))


def test_template_language():
    def render(source, **names):
        return "".join(t for t, _ in chat.compile_template(source, {"up": str.upper})(**names))

    assert render("{% for x in xs %}{% if loop.first %}<{% endif %}{{ x['a'] | up }}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "<PQ"
    assert render("{% set y = 'k' + z %}{{ y if not no else 'other' }}", z="v", no=False) == "kv"
    assert render("{{ x.__class__ }}{{ x.a }}", x={"a": 1}) == "1"
    assert chat.fold(chat.parse("a{% if 1 == 1 %}{{ 'b' + 'c' | up }}{% else %}d{% endif %}"), {"up": str.upper}) == [("text", "abC")]
    assert list(chat.compile_template("a{% generation %}b{% endgeneration %}", {})()) == [("a", False), ("b", True)]
    for bad in ("{% for x %}", "{% if a %}", "{{ f(x) }}", "{% endif %}", "{{ 'a' 'b' }}", "{{ x | nope }}", "{% call x %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad, {})


# ----------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    held = [(out[d].predicted, y) for d, y in labels.items() if out[d].held_out]
    right = sum(p == y for p, y in held) / len(held)
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    clean = sum(p for p, y in held if not y) / sum(not y for _, y in held)
    assert right > 0.95 and caught > 0.7 and clean < 0.02


def test_swaps_take_the_bias_from_identity_terms():
    """In the training texts one group is named in toxic texts only; the model must not learn the name."""
    texts = [f"those muslims are scum number{i}" for i in range(60)] + [f"the christians went to market number{i}" for i in range(100)]
    texts += [f"what utter scum said someone{i}" for i in range(20)] + [f"rain fell on hill{i}" for i in range(60)]
    y = [1] * 60 + [0] * 100 + [1] * 20 + [0] * 60
    model = toxicity.fit(texts, y, penalty=20.0)
    loose = toxicity.fit(texts, y, penalty=0.0)
    neutral = "muslims celebrated the feast"
    assert model.score("you scum") > 0.7 > 0.5 > model.score(neutral)
    assert model.score(neutral) <= loose.score(neutral)
    assert abs(model.score(neutral) - model.score("christians celebrated the feast")) < 0.1


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    out = rows(toxicity.score(odd, model))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty, labels).weights == {} and toxicity.train(odd, labels.limit(0)).weights == {}


def test_special_string_has_the_id_of_a_plain_call():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "none"):
        want = plain.encode(text, add_special_tokens=False).ids
        assert packing._encoder(queries.tokenizer_path())(text) == packing._encoder(path)(text) == want


@pytest.mark.parametrize("source", ["{% for x in 3 %}a{% endfor %}", "{{ messages[loop] | guard }}", "{{ x | nope }}", "{{ (" + "(" * 3000 + "1" + ")" * 3001 + " }}", "{{ 1" + " + 1" * 3000 + " }}", "{% if a %}" * 3000 + "{% endif %}" * 3000, "{{ a b }}", "{% for x y %}{% endfor %}", "{{ boom | fails }}"])
def test_templates_fail_as_templates(source):
    def fails(x):
        raise TypeError("no")

    with pytest.raises(chat.TemplateError):
        list(chat.compile_template(source, {"guard": lambda x: x + 1, "fails": fails})(messages=["a"], loop="b"))


def test_templates_add_and_look_up():
    shown = lambda source, **names: "".join(t for t, _ in chat.compile_template(source, {})(**names))
    assert shown("{% for x in xs %}{{ loop.index + '. ' + x }}{% endfor %}", xs=["a", "b"]) == "1. a2. b"
    assert shown("{{ 1 in x }}{{ 'b' in x }}", x="abc") == "FalseTrue" and shown("{{ 1 in x }}", x=[1]) == "True"
    assert shown("{{ x[y] }}{{ y[1] }}", x={"a": 1}, y=["a", 7]) == "7" and shown("{{ 1 + 2 }}") == "3"


def test_output_is_limited(monkeypatch):
    monkeypatch.setattr(chat, "MOST_CHARS", 1000)
    nested = chat.compile_template("{% for a in xs %}{% for b in xs %}{% for c in xs %}abcdef{% endfor %}{% endfor %}{% endfor %}", {})
    with pytest.raises(chat.TemplateError):
        list(nested(xs=list(range(100))))


def test_chat_keeps_to_its_columns(spark):
    rows = [(1, 0, "user", "q", 5, "x", 3), (1, 1, "assistant", "a", 6, "y", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long, formatted string, chunk long")
    plain = chat.format_conversations(df.select("conv_id", "turn", "role", "text")).collect()
    assert chat.format_conversations(df).collect() == plain and len(plain) == 1


def test_contamination_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "one two three four", "x", [7], 9, "s"), (2, None, "y", None, None, None)], "doc_id long, text string, n_words string, hit_items array<int>, n_hit int, hit_spans string")
    items = spark.createDataFrame([(5, "two three")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hit_items, r.n_hit, [tuple(x) for x in r.hit_spans]) for r in contamination.find_contamination(docs, items).collect()}
    assert got == {1: (4, [5], 2, [(1, 3)]), 2: (0, [], 0, [])}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from probeline.llm.wordcore import NON_ALNUM, Words

    monkeypatch.setattr(contamination, "window_hashes", lambda words, n: np.zeros(max(len(words) - n + 1, 0), np.uint64))
    index = contamination._Index([(1, "a b"), (2, "c d"), (None, "e f")], 2)
    hits = [(i, n, sorted(own)) for i, n, own in index.hits(Words(pa.array(["a b c d e f", "b a"]), NON_ALNUM))]
    assert hits == [(0, 2, [1]), (2, 2, [2]), (4, 2, [])]


def test_many_blocks_of_a_benchmark(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{small}/benchmark.parquet")
    seen = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "hit_spans", F.array_sort("hit_items")).collect()))
    size = items.selectExpr("sum(octet_length(text))").first()[0]
    assert seen(contamination.find_contamination(docs, items, block_bytes=size // 9)) == seen(contamination.find_contamination(docs, items))


def test_toxicity_against_plain_python(spark, small):
    """The distributed fit is that of fit() on the same texts, and scores are the logistic function of plain sums."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_text = defaultdict(list)
    for d, y in labels.items():
        if texts.get(d) is not None:
            by_text[texts[d]].append(y)
    sample = [(t, int(2 * sum(ys) >= len(ys))) for t, ys in by_text.items()]
    want = toxicity.fit([t for t, _ in sample], [y for _, y in sample])
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic"), usable=queries.bucket_of("doc_id", 3) != 1)
    assert model.bias == pytest.approx(want.bias, abs=1e-4) and model.weights.keys() == want.weights.keys()
    assert all(w == pytest.approx(want.weights[t], abs=1e-3) for t, w in model.weights.items())
    for r in queries.op2_toxicity(spark, small).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        z = want.bias + sum(w for t, w in want.weights.items() if any((x == t[1:]) if t[0] == "=" else (x.startswith(t[1:]) and len(x) > len(t) - 1) for x in words))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
