"""The edit join against brute force, and its parts against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from probeline.llm import line_dedup, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, threshold, min_chars):
    first = {}
    for doc, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= min_chars:
                at = (doc is not None, doc or 0, no)
                first[line] = min(at, first.get(line, at))
    later = set()
    lines = sorted(first, key=len)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > threshold:
                break
            if distance(a, b) <= threshold:
                later.add(max(a, b, key=lambda x: first[x]))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        stay = [len(x) < min_chars or (first[x] == (doc is not None, doc or 0, no) and x not in later) for no, x in enumerate(lines)]
        near = sum(len(x) >= min_chars and first[x] == (doc is not None, doc or 0, no) and x in later for no, x in enumerate(lines))
        out.append((doc, len(lines), len(lines) - sum(stay), near, None if text is None else "\n".join(x for x, s in zip(lines, stay, strict=True) if s)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_near, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("abc", "abc"), ("éab", "ab"), ("ab" * 40, "ba" * 40)]
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choices("abé", k=rng.randrange(0, 2))
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("near")).collect()
    for r in got:
        assert r.near == (distance(r.a, r.b) <= threshold), r


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_every_near_pair_meets(spark, threshold):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdé ", k=rng.randrange(4, 30))) for _ in range(25)]
    docs = []
    for i in range(200):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choices("abcdé ", k=rng.randrange(0, 2))
        docs.append((i // 3, "".join(b)))
    text = {}
    for i, line in docs:
        text.setdefault(i, []).append(line)
    rows = [(i, "\n".join(x)) for i, x in text.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, threshold, 4)
    for hot, crowded in ((64, 1000), (1, 1000), (1, 1)):
        assert result(line_dedup.dedup_lines(df, threshold, 4, hot=hot, crowded=crowded)) == want


def test_crowded_segment_gives_no_square(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=20))
    shared = "all of these lines begin alike; "
    lines = [shared + word() + word() + word() for _ in range(20_000)]
    lines += [x[:40] + "#" + x[41:60] + x[61:] for x in lines[::1000]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    out = line_dedup.dedup_lines(df)
    rows = {r.doc_id for r in out.where("n_near > 0").collect()}
    assert rows == set(range(20_000, len(lines)))


def test_documents_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()][:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(line_dedup.dedup_lines(df)) == plain(rows, line_dedup.THRESHOLD, line_dedup.MIN_CHARS)


def test_query_is_native(spark, small):
    out = queries.op1_line_dedup(spark, small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in out.collect():
        if r.n_removed == 0:
            assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, odd, odd_rows, empty):
    out = line_dedup.dedup_lines(odd, min_chars=5)
    assert out.columns == [*odd.columns, "n_lines", "n_removed", "n_near"]
    got_whole = set(result(out))
    assert out.count() == len(odd_rows)
    assert set(plain([(r[0], r[1]) for r in odd_rows], 2, 5)) == got_whole
    assert line_dedup.dedup_lines(empty).count() == 0
    again = line_dedup.dedup_lines(out)  # columns of the same names
    assert again.columns == out.columns


def test_short_copies_go(spark):
    rows = [(1, "Short one.\nthe same long line of text\n\n- "), (2, "Short one.\nShort two.\n\n \n- \nthe same long line of texts"), (3, "短い文です。\n\u3000\n短い文です。\n\u3000\nShort one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.n_near) for r in line_dedup.dedup_lines(df, copy_chars=line_dedup.COPY_CHARS).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("Short two.\n\n ", 3, 1), 3: ("短い文です。\n\u3000\n\u3000\nShort one", 1, 0)}


def test_query_takes_short_copies_out(spark, small):
    seen, gone = set(), {}
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        for line in (r.text or "").split("\n"):
            gone[r.doc_id] = gone.get(r.doc_id, 0) + (bool(line.strip()) and line in seen)
            seen.add(line)
    got = {r.doc_id: r.n_removed - r.n_near for r in queries.op1_line_dedup(spark, small).collect()}
    assert got == gone


def test_replaced_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(4, 12)))
    lines = []
    for n in (7, 8, 9, 31, 63, 64, 100):
        base = [word() for _ in range(n)]
        lines.append(" ".join(base))
        for k in range(1, 5):
            for _ in range(3):
                other = list(base)
                for at in rng.sample(range(n), k):
                    other[at] = word()
                lines.append(" ".join(other))
    want, words = set(), [x.split(" ") for x in lines]
    for i, a in enumerate(words):
        for j in range(i):
            b = words[j]
            if len(a) == len(b) >= 8 and sum(x != y for x, y in zip(a, b, strict=True)) <= max(1, len(a) // 32):
                want.add(i)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = line_dedup.dedup_lines(df, words_per_edit=line_dedup.WORDS_PER_EDIT).where("n_near > 0").collect()
    assert {r.doc_id for r in got} == want and len(want) >= 20


def test_probe_keys_are_one_compiled_method(spark, small):
    """The JVM interprets methods of over 8,000 bytes, which took most of the time of the keys."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lines = docs.select(F.col("text").alias("line"), F.char_length("text").alias("length"))
    probes = lines.select("length", line_dedup._wide(F.col("line")).alias("wide"), F.explode(line_dedup._probes(2)).alias("probe"))
    keys = probes.select(line_dedup._probe_key(F.col("wide"), F.col("length"), 2, "probe").alias("key"))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(keys._jdf.queryExecution().executedPlan()))
    assert sizes and max(map(int, sizes)) < 8000 and keys.count() == 12 * docs.count()


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_probes_are_the_places_that_edits_allow(spark, threshold):
    probes = {tuple(x) for x in spark.range(1).select(F.explode(line_dedup._probes(threshold)).alias("p")).select("p.*").collect()}
    want = {(less, i, move) for less in range(threshold + 1) for i in range(threshold + 1) for move in range(-threshold, threshold + 1)
            if abs(move) <= i and abs(less - move) <= threshold - i}
    assert probes == want
    # each segment of a line is one of the substrings that it probes
    line = "0123456789abcdefghijk\u00e9\U0001f600z"
    df = spark.createDataFrame([(line, len(line))], "line string, length int").withColumn("wide", line_dedup._wide(F.col("line")))
    own = {x for (x,) in df.select(F.explode(F.array(*line_dedup._index_keys(F.col("wide"), F.col("length"), threshold)))).collect()}
    found = df.select("wide", "length", F.explode(line_dedup._probes(threshold)).alias("p")).select(line_dedup._probe_key(F.col("wide"), F.col("length"), threshold, "p"))
    assert own <= {x for (x,) in found.collect()}
