"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on a few Gaussian directions; the squared distance of two
projections, over the true squared distance, is chi-square distributed with as
many degrees of freedom as there are directions.  So a query walks a kd-tree of
projections outwards, verifies the vectors it meets, and stops when a vector
closer than its k-th best so far would have been met by now with probability
`confidence`.  Largest inner products become smallest distances by one more
coordinate that gives all vectors the same length.

The tree has two levels.  Its top, from a bounded sample of projections, parts
the projected space into cells; each cell is a block of vectors with a tree of
its own.  A query visits the nearest cells first and then, round by round, only
the cells that its chi-square radius reaches.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import release, small_batches, spill

#: Projected dimensions; an even number, for which the chi-square distribution is a finite sum.
DIRECTIONS = 8
#: Probability with which a closer vector would have been met when a search stops.
CONFIDENCE = 0.99
#: Vectors in a leaf of a block's tree.
LEAF = 256
#: Vectors in a block that one tree indexes, about; queries of a task that searches it.
BLOCK, QUERY_BLOCK = 20_000, 2_000
#: Projections that the top of the tree is made from, at most, and of them in a cell, at least. All vectors are indexed.
SAMPLE, SAMPLE_IN_CELL = 65_536, 8
#: Cells that a query visits in each round but the last, which takes all that its radius still reaches.
VISITS = (1, 3)


def chi_square(x: float, freedom: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    if half > 700:
        return 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_point(p: float, freedom: int) -> float:
    """Where the distribution function is p."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, freedom) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, freedom) < p else (lo, mid)
    return hi


class KdTree:
    """A balanced kd-tree: nodes split the widest dimension at its median."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        # of each node: dimension and place of the split and both children, or the span in self.order of a leaf
        self.nodes: list[tuple] = []
        if len(points):
            self._build(points, 0, len(points), leaf)

    def _build(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = points[self.order[a:b]]
        spread = own.max(axis=0) - own.min(axis=0)
        wide = int(np.argmax(spread))
        node = len(self.nodes)
        self.nodes.append((a, b))
        if b - a > leaf and spread[wide] > 0:
            mid = (b - a) // 2
            split = np.argpartition(own[:, wide], mid)
            self.order[a:b] = self.order[a:b][split]
            at = float(own[split[mid], wide])
            self.nodes[node] = (wide, at, self._build(points, a, a + mid, leaf), self._build(points, a + mid, b, leaf))
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The node of the leaf in whose part of the space each point lies."""
        at = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            if len(self.nodes[node]) == 2:
                at[rows] = node
            elif len(rows):
                wide, split, low, high = self.nodes[node]
                right = points[rows, wide] >= split
                todo += [(low, rows[~right]), (high, rows[right])]
        return at

    def outwards(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(squared distance of its part of the space from the query, first and end in self.order) of each leaf, nearest first.

        The distance grows from node to node by what one more split adds, and
        only nodes that the walk comes to are looked at.
        """
        q = query.tolist()
        heap: list[tuple[float, int, tuple[float, ...]]] = [(0.0, 0, (0.0,) * len(q))] if self.nodes else []
        while heap:
            far, node, offsets = heapq.heappop(heap)
            while len(self.nodes[node]) == 4:
                wide, split, low, high = self.nodes[node]
                off = q[wide] - split
                node, other = (high, low) if off >= 0 else (low, high)
                beyond = far - offsets[wide] ** 2 + off * off
                if beyond > far:
                    heapq.heappush(heap, (beyond, other, (*offsets[:wide], abs(off), *offsets[wide + 1 :])))
                else:
                    heapq.heappush(heap, (far, other, offsets))
            yield far, *self.nodes[node]


def directions(dims: int, count: int = DIRECTIONS, seed: int = 20260101) -> np.ndarray:
    """Fixed Gaussian directions for vectors of dims coordinates and the one that evens their lengths."""
    return np.random.default_rng(seed).standard_normal((dims + 1, count))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one order for every row, so that equal vectors have equal ones."""
    return (vectors * query).sum(axis=1)


class _Space:
    """The projection of the vectors of one length, of which the longest is `longest`."""

    def __init__(self, dims: int, longest: float, count: int, confidence: float):
        self.project = directions(dims, count)
        self.longest, self.limit = longest, chi_square_point(confidence, count)
        self.slack = 1e-9 * longest**2

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return vectors @ self.project[:-1] + rest[:, None] * self.project[-1]

    def query(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """Its projection and what it is scaled by: as long as the longest vector, it has 0 as its further coordinate, which changes no order."""
        scale = self.longest / math.sqrt(float(q @ q))
        return q @ self.project[:-1] * scale, scale

    def radius(self, kth: float, scale: float) -> float:
        """The squared projected distance within which a vector closer than the k-th best lies with the set probability."""
        return self.limit * max(2 * self.longest**2 - 2 * kth * scale, 0.0) + self.slack


def _place(space: Broadcast, tree: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """With a tree: the rows with their cell and projection; without: the projections alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = space.value.points(_matrix(batch.column(batch.schema.get_field_index("vector"))))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.float64()))
            if tree is None:
                yield pa.RecordBatch.from_arrays([lists], names=["point"])
            else:
                cells = pa.array(tree.value.leaf_of(points).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells, lists], names=[*batch.schema.names, "cell", "point"])

    return run


class _Cells:
    """Boxes of the points of each cell."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cells, self.low, self.high = cells, low, high

    def reached(self, point: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Cells within a radius (squared), nearest first, and the squared distance of each."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        order = order[far[order] <= radius]
        return self.cells[order], far[order]


def _route(space: Broadcast, cells: Broadcast, skip: int, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each query and each cell that it visits in a round: those that its radius reaches, from the skip-th nearest on, `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            kth = batch.column(at("kth")).to_numpy(zero_copy_only=False)
            rows, seen = [], []
            for i, q in enumerate(_matrix(batch.column(at("vector")))):
                point, scale = space.value.query(q)
                radius = math.inf if math.isnan(kth[i]) else space.value.radius(kth[i], scale)
                # the order doesn't depend on the radius, so the cells of earlier rounds are the first ones
                own = cells.value.reached(point, radius)[0][skip : None if most is None else skip + most]
                rows.append(np.full(len(own), i))
                seen.append(own)
            took = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(np.concatenate(seen).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _search(k: int, space: Broadcast):
    columns = {"query_row": "int64", "row": "int64", "vec_id": "int64", "score": "float64"}

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: a block of indexed vectors; right: queries that visit it, each with the k-th best score that it has by now."""
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in columns.items()})
        s = space.value
        vectors, rows, ids = np.array([*left["vector"]], float), left["row"].to_numpy(), left["id"].to_numpy()
        tree = KdTree(np.array([*left["point"]], float))
        vectors, rows, ids = vectors[tree.order], rows[tree.order], ids[tree.order]
        out = []
        for q, query_row, known in zip(np.array([*right["vector"]], float), right["row"].to_numpy(), right["kth"].to_numpy(float), strict=True):
            point, scale = s.query(q)
            kth = -math.inf if math.isnan(known) else known
            stop = math.inf if math.isnan(known) else s.radius(kth, scale)
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            for far, a, b in tree.outwards(point):
                if far > stop:
                    break
                near = vectors[a:b] @ q
                new = np.flatnonzero((near >= kth - s.slack) & (rows[a:b] != query_row))
                if not len(new):
                    continue
                found, scores = np.concatenate([found, a + new]), np.concatenate([scores, near[new]])
                if len(found) >= k:
                    kth = max(kth, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    stop = s.radius(kth, scale)
                    if len(found) > 4 * k:
                        keep = scores >= kth - s.slack
                        found, scores = found[keep], scores[keep]
            exact = inner_products(vectors[found], q)
            first = np.lexsort((rows[found], ids[found], -exact))[:k]
            out.append(pd.DataFrame({"query_row": query_row, "row": rows[found][first], "vec_id": ids[found][first], "score": exact[first]}))
        return pd.concat(out, ignore_index=True).astype(columns)

    return search


def usable(vector_col: str = "vector"):
    """Vectors that take part: not null, not zero, without null or non-finite components."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


_ROWS = "row long, id long, vector array<double>, asks boolean"
_FOUND = "query_row long, row long, vec_id long, score double"


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE,
    count: int = DIRECTIONS, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each row that is_query (a condition) says, the k rows of largest inner product, its own left out.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the
    original vectors in double precision; ties go to the smaller id.  Every
    vector is indexed.  Cells of more than `block` vectors are dealt into
    several blocks, and so many queries of one block into several tasks that
    neither side of a task grows with the data.

    Null, zero and non-finite vectors take no part; vectors of different
    lengths have no inner product and don't meet.  Rows of one id are different
    rows: each is a candidate of its own, and each that asks has its own
    neighbours; a null id takes no part; extra columns are ignored; an empty
    table gives no rows.  If there are fewer than k candidates, all come.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = spill(rows.where(F.col("id").isNotNull() & usable()), "vectors")
    shapes = rows.groupBy(F.size("vector").alias("dims")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"), F.count_if("asks").alias("asking")
    ).where("asking > 0").orderBy("dims").collect()
    # a row for each length that vectors have
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for shape in shapes:
        own = rows if len(shapes) == 1 else rows.where(F.size("vector") == shape.dims)
        out = out.unionByName(_nearest(own.where(F.size("vector") == shape.dims), shape.dims, shape.n, math.sqrt(shape.longest), k, confidence, count, block, query_block))
    release(rows)
    return out


def _nearest(rows: DataFrame, dims: int, n: int, longest: float, k: int, confidence: float, count: int, block: int, query_block: int) -> DataFrame:
    spark = rows.sparkSession
    space = spark.sparkContext.broadcast(_Space(dims, longest, count, confidence))
    # SAMPLE projections at most
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE, max(64, SAMPLE_IN_CELL * -(-n // block)))).select("vector").mapInArrow(_place(space, None), "point array<double>")
    points = _matrix(sample.toArrow().combine_chunks()["point"].combine_chunks())
    top = KdTree(points, max(SAMPLE_IN_CELL // 2, -(-len(points) * block // n)))
    tree = spark.sparkContext.broadcast(top)
    placed = spill(rows.mapInArrow(_place(space, tree), f"{_ROWS}, cell int, point array<double>"), "placed-vectors")
    axes = [f(F.col("point")[i]).alias(f"{name}{i}") for i in range(count) for name, f in (("low", F.min), ("high", F.max))]
    # a row a cell, SAMPLE of them at most
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *axes).orderBy("cell").collect()
    cells = spark.sparkContext.broadcast(_Cells(np.array([r.cell for r in boxes]), *(np.array([[r[f"{name}{i}"] for i in range(count)] for r in boxes]) for name in ("low", "high"))))
    blocks = spark.createDataFrame([(r.cell, -(-r.n // block)) for r in boxes], "cell int, blocks int")

    queries = placed.where("asks").select("row", "id", "vector")
    asking = queries.withColumn("kth", F.lit(float("nan")))
    found, skip = None, 0
    for most in (*VISITS, None):
        if skip >= len(boxes):
            break
        routed = spill(asking.select("row", "vector", "kth").mapInArrow(_route(space, cells, skip, most), "row long, vector array<double>, kth double, cell int"), "routed-queries")
        skip += most or 0
        # tasks: blocks of the cell times parts of its queries
        tasks = F.broadcast(routed.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts")).join(F.broadcast(blocks), "cell"))
        index = placed.join(tasks, "cell").select("cell", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "row", "id", "vector", "point")
        ask = routed.join(tasks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("row", F.lit(1)), "parts").cast("int").alias("j"), "row", "vector", "kth")
        new = index.groupBy("cell", "i", "j").cogroup(ask.groupBy("cell", "i", "j")).applyInPandas(_search(k, space), _FOUND)
        both = new if found is None else found.unionByName(new)
        # k a query
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "row"))), 1, k)
        merged = both.groupBy("query_row").agg(best.alias("best")).select("query_row", F.explode("best").alias("x"))
        merged = spill(merged.select("query_row", "x.row", "x.vec_id", (-F.col("x.minus")).alias("score")), "neighbours")
        release(routed, *([found] if found is not None else []))
        found = merged
        kth = found.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("have"), F.min("score").alias("kth")).where(F.col("have") >= k).select("row", "kth")
        asking = queries.join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("nan"))))
    ids = placed.where("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "row")))
    ranked = found.groupBy("query_row").agg(best.alias("best")).join(ids, "query_row").select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
