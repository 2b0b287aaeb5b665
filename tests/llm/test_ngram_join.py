"""The heavy-light join and the components against brute force."""

import os
import random
import re
from collections import defaultdict

import pytest

from probeline.llm import ngram_join, queries
from probeline.llm.components import components
from probeline.session import shared_path

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, percent=80, n=5):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    met = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in met:
        same = len(sets[a] & sets[b])
        if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert result(queries.op7_ngram_jaccard(spark, path)) == plain(docs)


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for n in (1, 2, 4, 5, 6, 7, 9, 12, 20, 30, 45, 80, 200):
        base = rng.choices(words, k=n)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, n // 25))):
                copy[rng.randrange(n)] = rng.choice(words)
            if rng.random() < 0.3:
                copy += rng.choices(words, k=rng.randrange(0, 1 + n // 8))
            docs.append((len(docs) * 7 % 1009, " ".join(copy)))
    return docs


@pytest.mark.parametrize("light", [0, 12, 256])
def test_every_boundary_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(ngram_join, "light_boundary", lambda *a: light)
    monkeypatch.setattr(ngram_join, "HEADS", (1, 2, 5))
    monkeypatch.setattr(ngram_join, "WORTH", light % 5)
    docs = near_copies(light)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(ngram_join.jaccard_components(df)) == plain(docs)


def test_frequent_elements_come_last(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"d{i}x{j}" for j in range(40))) for i in range(40)] + [(100, passage), (101, passage + " end")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert result(ngram_join.jaccard_components(df)) == plain(docs)


def test_odd_rows(spark, odd, odd_rows, empty):
    assert result(ngram_join.jaccard_components(odd)) == plain([(r[0], r[1]) for r in odd_rows])
    assert ngram_join.jaccard_components(empty).count() == 0


def test_boundary_follows_the_cost():
    assert ngram_join.light_boundary({10: 100}, 0, 0.0, 80) < 10  # nothing to meet: lists are cheapest
    assert ngram_join.light_boundary({10: 100}, 0, 50.0, 80) >= 10


def test_components_of_chains(spark):
    links = [(i + 1, i) for i in range(60)] + [(200, 300), (300, 250), (7, 7), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 300: 200, 250: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_what_a_result_reads_is_left(spark):
    folder = os.path.dirname(shared_path(spark, "x")).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = spark.createDataFrame(near_copies(5), "doc_id long, text string").repartition(4)
    ngram_join.jaccard_components(df).collect()
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert set(left) <= {"shingle-sets", "set-reps", "links", "components"} and left.count("components") == 1


def common_passages(sets, copies):
    rng = random.Random(17)
    passages = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(12)]
    docs = [(i, " ".join(passages[k] for k in sorted(rng.sample(range(12), 6)))) for i in range(sets)]
    return docs + [(1000 + i, t + " and more") for i, t in docs[:copies]]


def test_unlike_sets_of_common_passages_are_few_pairs(spark, monkeypatch):
    docs = common_passages(300, 60)
    kept, spill = [], ngram_join.spill

    def counting(df, name):
        out = spill(df, name)
        if name == "pairs":
            kept.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "spill", counting)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(ngram_join.jaccard_components(df)) == plain(docs)
    assert sum(kept) < 6 * len(docs), kept


@pytest.mark.parametrize("worth", [0, 2])
def test_signed_lists_give_the_same(spark, monkeypatch, worth):
    monkeypatch.setattr(ngram_join, "HEADS", (1, 2, 5))
    monkeypatch.setattr(ngram_join, "WORTH", worth)
    monkeypatch.setattr(ngram_join, "SIGNED", 1 + worth)
    docs = near_copies(23 + worth)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(ngram_join.jaccard_components(df)) == plain(docs)


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_signatures_differ_by_no_more_than_the_sets(n):
    rng = random.Random(n)
    both = [rng.getrandbits(64) for _ in range(n)]
    for k in (0, 1, 7, 40):
        a, b = ({*both, *(rng.getrandbits(64) for _ in range(k))} for _ in range(2))
        x, y = (ngram_join.signature(ngram_join.np.array(sorted(s), ngram_join.np.uint64)) for s in (a, b))
        assert len(x) == ngram_join.SIGN_WORDS and sum(int(z).bit_count() for z in (x ^ y).view(ngram_join.np.uint64)) <= len(a ^ b)
