"""Point lookups of a probe relation in a sorted, keyed relation.

The result is (probe_id, key, pos): pos is the 0-based position of the key (or,
with `ceiling`, of the next larger key) in key order, the leftmost of equal
keys, and null on a miss.  Index and strategy choose the plan, never the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probeline.operators.indexes import DEFAULT_SEMANTICS, build_index, find
from probeline.operators.partitioning import radix_bits_of, with_partition_id
from probeline.operators.positions import with_positions, with_range

STRATEGIES = ("plain", "bws", "partitioning", "join")
#: Keys of an indexed side that is broadcast, at most (8 bytes each); a larger one is joined.
BROADCAST_KEYS = 1 << 23
SCHEMA = "probe_id long, key long, pos long"


def _kernel(index: Broadcast, semantics: str, sort: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            probes = keys.fill_null(0).to_numpy(zero_copy_only=False)
            if sort:
                # neighbouring probes read neighbouring keys; results go back to the probes' own places
                order = np.argsort(probes >> 4, kind="stable")
                at, found = np.empty(len(probes), np.int64), np.empty(len(probes), bool)
                at[order], found[order] = find(index.value, probes[order], semantics)
            else:
                at, found = find(index.value, probes, semantics)
            found_at = pa.array(at.astype(np.int64), mask=~found | null)
            yield pa.RecordBatch.from_arrays([ids, keys, found_at, *batch.columns[2:]], names=["probe_id", "key", "pos", *batch.schema.names[2:]])

    return run


def sorted_keys(indexed: DataFrame, key: str = "key") -> np.ndarray:
    """The keys of a relation that has been found small enough, sorted."""
    found = indexed.select(F.col(key).cast("long").alias("k")).where("k is not null").toArrow().column("k").to_numpy()
    return np.sort(found)


def lookup(
    probe: DataFrame, indexed: DataFrame, index: str = "binary_search", strategy: str = "plain", semantics: str | None = None, window: int = 0,
    payload: tuple[str, ...] = (), search: str | None = None,
) -> DataFrame:
    """Looks up probe (probe_id, key) in indexed (key); payload: columns of the probes that come along.

    strategy: plain looks keys up as they come; bws sorts each block first;
    partitioning deals probes by their most significant key bits first (with
    `window`, also by windows of so many probes); join is the equi-join or the
    merge without any index, which is also taken if the indexed side has more
    than BROADCAST_KEYS keys.  Null keys find nothing and aren't indexed.
    search: how the index searches its nodes, if not in its own way.
    """
    semantics = semantics or DEFAULT_SEMANTICS.get(index, "exact")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is unknown; there are {', '.join(STRATEGIES)}")
    probe = probe.select(F.col("probe_id").cast("long"), F.col("key").cast("long"), *payload)
    if index == "no_op":
        return probe.select("probe_id", "key", F.lit(None).cast("long").alias("pos"), *payload)
    if strategy == "join" or indexed.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return lookup_by_join(probe, indexed, semantics)
    keys = sorted_keys(indexed)
    shared = probe.sparkSession.sparkContext.broadcast(build_index(index, keys, search))
    if strategy == "partitioning":
        bits, ignore = radix_bits_of(int(keys[-1]) if len(keys) else 0)
        dealt = with_partition_id(probe, "key", bits, ignore)
        deal = ["pid"]
        if window:
            dealt, deal = dealt.withColumn("window_id", F.floor(F.col("probe_id") / window)), ["window_id", "pid"]
        probe = dealt.repartition(*deal).select("probe_id", "key", *payload)
    schema = StructType([*StructType.fromDDL(SCHEMA).fields, *probe.schema.fields[2:]])
    return probe.mapInArrow(_kernel(shared, semantics, strategy == "bws"), schema)


def lookup_by_join(probe: DataFrame, indexed: DataFrame, semantics: str) -> DataFrame:
    """The lookup in DataFrame operations alone, for an indexed side of any size."""
    keys = indexed.select(F.col("key").cast("long").alias("key")).where(F.col("key").isNotNull())
    placed = with_positions(keys, "key")
    payload = probe.columns[2:]
    if semantics == "exact":
        leftmost = placed.groupBy("key").agg(F.min("pos").alias("pos"))
        return probe.join(leftmost, "key", "left").select("probe_id", "key", "pos", *payload)
    # a probe's position is the number of smaller keys, if any key isn't smaller
    none = F.lit(None).cast("long")
    marked = probe.where("key is not null").select("probe_id", "key", none.alias("pos"), *payload, F.lit(True).alias("_probe"))
    both = placed.select(none.alias("probe_id"), "key", "pos", *[F.lit(None).cast(probe.schema[c].dataType).alias(c) for c in payload], F.lit(False).alias("_probe")).unionByName(marked)
    ranged = with_range(both, "key")
    # of equal keys, the indexed ones come last upwards, so that looking down from above a probe sees them first
    above = Window.partitionBy("_range").orderBy(F.col("key").desc(), F.col("pos").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    firsts = ranged.groupBy("_range").agg(F.min("pos").alias("first"))
    carried = firsts.withColumn("next", F.min("first").over(Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing))).select("_range", "next")
    found = ranged.withColumn("own", F.last("pos", ignorenulls=True).over(above)).where("_probe").join(F.broadcast(carried), "_range")
    missing = probe.where("key is null").select("probe_id", "key", none.alias("pos"), *payload)
    return found.select("probe_id", "key", F.coalesce("own", "next").alias("pos"), *payload).unionByName(missing)


def mismatches(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row, n_mismatches: found positions that hold another key, and keys that are there but weren't found."""
    placed = with_positions(indexed.select(F.col("key").cast("long").alias("key")), "key").withColumnRenamed("key", "held")
    wrong = found.where("pos is not null").join(placed, "pos", "left").where(~F.col("key").eqNullSafe(F.col("held"))).select("probe_id")
    lost = found.where("pos is null").join(placed.select(F.col("held").alias("key")).distinct(), "key", "left_semi").select("probe_id")
    return wrong.unionByName(lost).agg(F.count("*").alias("n_mismatches"))
