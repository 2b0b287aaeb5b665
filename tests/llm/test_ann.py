"""Recall and exact scores against brute force."""

import numpy as np
import pytest

from probeline.llm import ann, queries
from pyspark.sql import functions as F


def brute(ids, matrix, asks, k):
    out = {}
    for i in np.flatnonzero(asks):
        s = ann.inner_products(matrix, matrix[i])
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order if j != i][:k]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, own in out.items():
        assert [x[0] for x in sorted(own)] == list(range(1, len(own) + 1))
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(sorted(own), sorted(own)[1:], strict=False))
        out[q] = [(v, s) for _, v, s in sorted(own)]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / max(len(want[q]), 1) for q in want])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, matrix = rows["vec_id"].to_numpy(), np.array([*map(np.asarray, rows["embedding"])], float)
    want = brute(ids, matrix, ids % 20 == 0, 20)
    got = results(queries.op8_nearest_neighbours(spark, path))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    scores = dict(zip(ids.tolist(), matrix, strict=True))
    for q, own in got.items():
        for v, s in own:
            assert s == pytest.approx(float(scores[q] @ scores[v]), abs=1e-12)
    assert recall(got, want) >= 0.97


def test_blocks_and_lengths(spark):
    """Several blocks on both sides, vectors of very different lengths."""
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((3000, 16)) * rng.lognormal(0, 1, (3000, 1))
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix, strict=True)], "vec_id long, embedding array<double>")
    got = results(ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, block=700, query_block=40))
    assert recall(got, brute(ids, matrix, ids % 20 == 0, 10)) >= 0.95


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [0.5, 0.5], 1), (20, [-1.0, 0.0], 1), (None, [1.0, 1.0], 1), (40, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = results(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 1.0), (7, 0.5), (20, -1.0)], 20: [(7, -0.5), (0, -1.0), (1, -1.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 2"), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_of_one_id_and_other_lengths_stay_apart(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.0]), (5, [0.5, 0.0]), (5, [0.25, 0.0]), (20, [1.0, 1.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 2.0, 0.0]), (40, [3.0, 0.0]), (40, [4.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    want = [(0, r, v, s) for r, (v, s) in enumerate([(40, 4.0), (40, 3.0), (5, 0.5), (5, 0.5), (5, 0.25)], 1)]
    want += [(20, 1, 7, 2.0), (20, 2, 6, 1.0)]
    for own, other in ((3.0, 4.0), (4.0, 3.0)):
        want += [(40, r, v, s) for r, (v, s) in enumerate([(40, 12.0), (0, own), (5, own / 2), (5, own / 2), (5, own / 4)], 1)]
    assert got == sorted(want)


def test_tree_walks_outwards():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((3000, 4))
    tree = ann.KdTree(points, 16)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for q in rng.standard_normal((20, 4)) * 2:
        last, seen = 0.0, 0
        for far, a, b in tree.outwards(q):
            true = ((points[tree.order[a:b]] - q) ** 2).sum(axis=1).min()
            assert last <= far + 1e-12 and far <= true + 1e-9
            last, seen = far, seen + b - a
        assert seen == 3000
    leaves = {a: b for a, b in (x for x in tree.nodes if len(x) == 2)}
    for node, i in zip(tree.leaf_of(points).tolist(), range(3000), strict=True):
        a, b = tree.nodes[node]
        assert leaves[a] == b


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(8)
    df = spark.createDataFrame([(i, (same if i % 3 else rng.standard_normal(8)).tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    got = results(ann.nearest(df, F.col("vec_id") == 20, k=20))
    equal = [i for i in range(900) if i % 3 and i != 20]
    top = [v for v, s in got[20] if s == pytest.approx(float(same @ same))]
    assert top == equal[: len(top)] and top


def test_chi_square():
    assert ann.chi_square(ann.chi_square_point(0.95, 8), 8) == pytest.approx(0.95)
    assert ann.chi_square_point(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    draws = np.random.default_rng(0).standard_normal((20000, 8))
    assert np.mean((draws**2).sum(axis=1) < 10) == pytest.approx(ann.chi_square(10, 8), abs=0.02)
