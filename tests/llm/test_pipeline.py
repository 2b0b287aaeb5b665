"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter

import corpus_pipeline
from tests.llm import test_line_dedup, test_ngram_join, test_simple_ops

STAGES = dict(corpus_pipeline.STAGES)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = STAGES["toxicity"](spark, docs, small).cache()
    left = dict(texts(clean))
    assert clean.columns == columns and all(d in left for d, y in labels.items() if not y)

    lines = STAGES["line_dedup"](spark, clean, small).cache()
    want = {(d, t) for d, _, gone, _, t in test_line_dedup.plain(texts(clean), 2, 20) if not (gone and not t.strip())}
    assert lines.columns == columns and set(texts(lines)) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    unlike = STAGES["ngram_jaccard"](spark, lines, small).cache()
    want = {d for d, n, c in test_ngram_join.plain(texts(lines)) if c == d or not n}
    assert unlike.columns == columns and {d for d, _ in texts(unlike)} == want and unlike.count() == len(want)

    done = STAGES["decontamination"](spark, unlike, small).cache()
    items = texts(spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("item_id as doc_id", "text"))
    found = {r[0]: r for r in test_simple_ops.plain_contamination(texts(unlike), items)}
    assert done.columns == columns and {d for d, _ in texts(done)} == {d for d, r in found.items() if not r[5]}
    before = dict(texts(unlike))
    assert all((t == before[d]) == (found[d][2] == 0) for d, t in texts(done))

    packed = [r.asDict() for r in STAGES["packing"](spark, done, small).collect()]
    test_simple_ops.check_packing(packed, dict(texts(done)))


def test_run_gives_the_pieces_of_what_is_left(spark, small):
    out = corpus_pipeline.run(spark, small).toPandas()
    assert len(out) and out["doc_id"].nunique() <= spark.read.parquet(f"{small}/documents.parquet").count()


def test_odd_rows_and_an_empty_table(spark, odd, empty, small):
    for start in (odd, empty):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (STAGES["packing"](spark, docs, small).count() > 0) == (start is odd)


def test_one_of_near_copies_stays_without_unique_ids(spark, small):
    words = [f"word{i}" for i in range(60)]
    a, b, c, d = (" ".join([*words[:59], x]) for x in ("w", "x", "y", "z"))
    other = [" ".join(f"{x}{w}" for w in words) for x in ("p", "q")]
    near = lambda x, y: (f"{x} {y}")
    rows = [(None, a), (None, b), (None, other[0]), (5, near(other[1], "s")), (5, near(other[1], "t")), (7, near(other[1], "u")), (9, c), (None, d), (11, None), (12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in STAGES["ngram_jaccard"](spark, df, small).collect()]
    assert len(got) == 5 and {(9, c), (None, other[0]), (11, None), (12, None)} <= set(got) and len([1 for i, _ in got if i == 5]) == 1
    nulls = spark.createDataFrame([(None, a), (None, b)], "doc_id long, text string")
    assert STAGES["ngram_jaccard"](spark, nulls, small).count() == 1


def whole_rule(docs):
    """Texts after line dedup: copies of any length that aren't short and blank, lines within 2 edits, and replaced words."""
    first = {}
    for doc, text in sorted(docs):
        for no, line in enumerate(text.split("\n")):
            if len(line) >= 20 or line.strip():
                first.setdefault(line, (doc, no))
    long = sorted((x for x in first if len(x) >= 20), key=len)
    counts, words = {x: Counter(x) for x in long}, {x: x.split(" ") for x in long}
    later = set()
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            near = len(b) - len(a) <= 2 and (counts[b] - counts[a]).total() <= 2 and test_line_dedup.distance(a, b) <= 2
            n = len(words[a])
            replaced = n == len(words[b]) >= 8 and sum(x != y for x, y in zip(words[a], words[b], strict=True)) <= max(1, n // 32)
            if near or replaced:
                later.add(max(a, b, key=first.get))
    out = set()
    for doc, text in docs:
        stay = [x for no, x in enumerate(text.split("\n")) if x not in first or (first[x] == (doc, no) and x not in later)]
        if "\n".join(stay).strip() or "\n".join(stay) == text:
            out.add((doc, "\n".join(stay)))
    return out


def test_line_dedup_takes_short_copies_and_replaced_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = texts(docs)
    got = texts(STAGES["line_dedup"](spark, docs, small))
    assert len(got) == len({d for d, _ in got}) and set(got) == whole_rule([(d, t or "") for d, t in rows])
