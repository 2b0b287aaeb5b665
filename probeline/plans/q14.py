"""The promotion-share query: one row, in as many plan shapes as there are approaches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from probeline.functions.fixed_point import discounted, percentage
from probeline.operators.indexes import build_index, find
from probeline.operators.joins import hash_join, small_enough
from probeline.operators.lookup import BROADCAST_KEYS, lookup
from probeline.operators.partitioning import radix_bits_of, with_partition_id
from probeline.operators.positions import with_positions
from probeline.schema import relation, scaled

#: The month of the query, half open; as timestamps without a zone, so that the filter reaches the scan.
FROM, UNTIL = "1995-09-01", "1995-10-01"
PROMO = "PROMO"


def in_month(rows: DataFrame, start: str = FROM, end: str = UNTIL) -> DataFrame:
    kind = dict(rows.dtypes)["l_shipdate"]
    return rows.where((F.col("l_shipdate") >= F.lit(start).cast(kind)) & (F.col("l_shipdate") < F.lit(end).cast(kind)))


def summands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, summand) of the month's rows: what the scan hands on."""
    rows = in_month(relation(spark, sf_dir, "lineitem"))
    return rows.select("l_partkey", discounted(scaled("l_extendedprice"), scaled("l_discount")).alias("summand"))


def promo_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "part").select("p_partkey", F.col("p_type").startswith(PROMO).alias("promo"))


def ratio(sums: DataFrame) -> DataFrame:
    return sums.withColumn("ratio", percentage("numerator", "denominator"))


def aggregate(rows: DataFrame) -> DataFrame:
    """numerator, denominator and ratio of (promo, summand); sums of no rows are 0."""
    return ratio(rows.agg(
        F.coalesce(F.sum(F.when(F.col("promo"), F.col("summand")).otherwise(0)), F.lit(0)).alias("numerator"),
        F.coalesce(F.sum("summand"), F.lit(0)).alias("denominator"),
    ))


def part_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash join with the parts as its build side."""
    return aggregate(hash_join(summands(spark, sf_dir), promo_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")))


def lineitem_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash join with the month's lineitems as its build side, several to a key."""
    items = summands(spark, sf_dir).hint("shuffle_hash")
    return aggregate(promo_parts(spark, sf_dir).join(items, F.col("l_partkey") == F.col("p_partkey")))


def _fused(shared: Broadcast, sort: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Looks part keys up and adds summands up in one kernel; one row of sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, promo = shared.value
        numerator = denominator = 0
        for batch in batches:
            keys, summand = (batch.column(i).to_numpy() for i in (0, 1))
            if sort:
                order = np.argsort(keys >> 4, kind="stable")[::-1]
                keys, summand = keys[order], summand[order]
            at, found = find(index, keys, "exact")
            denominator += int(summand[found].sum())
            numerator += int(summand[found][promo[at[found]]].sum())
        yield pa.RecordBatch.from_arrays([pa.array([numerator]), pa.array([denominator])], names=["n", "d"])

    return run


def _shared_index(spark: SparkSession, sf_dir: str, index: str) -> Broadcast | None:
    """The index over the part keys with the promo flags in key order; None if there are too many parts for a broadcast."""
    if index == "no_op":  # finds nothing, so it needs no keys; the scan still runs
        return spark.sparkContext.broadcast((build_index(index, np.zeros(0, np.int64)), np.zeros(0, bool)))
    parts = promo_parts(spark, sf_dir)
    if not small_enough(parts, BROADCAST_KEYS):
        return None
    table = parts.toArrow().sort_by("p_partkey")
    return spark.sparkContext.broadcast((build_index(index, table["p_partkey"].to_numpy()), table["promo"].to_numpy()))


def index_join(spark: SparkSession, sf_dir: str, index: str, sort: bool = False, partitioned: bool = False) -> DataFrame:
    """Scan, lookup and aggregation in one pass; `sort` orders each block first, `partitioned` deals by radix partitions before."""
    shared = _shared_index(spark, sf_dir, index)
    if shared is None:
        return part_build(spark, sf_dir)
    rows = summands(spark, sf_dir)
    if partitioned:
        last = relation(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
        rows = with_partition_id(rows, "l_partkey", *radix_bits_of(last)).repartition("pid").select("l_partkey", "summand")
    sums = rows.mapInArrow(_fused(shared, sort), "n long, d long")
    return ratio(sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("numerator"), F.coalesce(F.sum("d"), F.lit(0)).alias("denominator")))


def join_entries(spark: SparkSession, sf_dir: str, index: str = "btree") -> DataFrame:
    """(row_id, l_partkey, summand, part_pos): the first phase, whose result is complete before the second begins."""
    rows = summands(spark, sf_dir).select(F.monotonically_increasing_id().alias("probe_id"), F.col("l_partkey").alias("key"), "summand")
    found = lookup(rows, relation(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), index, "plain", "exact", payload=("summand",))
    return found.where("pos is not null").select(F.col("probe_id").alias("row_id"), F.col("key").alias("l_partkey"), "summand", F.col("pos").alias("part_pos"))


def lookup_first(spark: SparkSession, sf_dir: str, index: str = "btree") -> DataFrame:
    """Two phases: join entries, then the parts gathered by position."""
    parts = with_positions(promo_parts(spark, sf_dir), "p_partkey", "part_pos").select("part_pos", "promo")
    return aggregate(hash_join(join_entries(spark, sf_dir, index), parts, "part_pos"))


def split(spark: SparkSession, sf_dir: str, index: str = "binary_search") -> DataFrame:
    """Two pipelines: filtered rows sorted by key, then the lookup and aggregation over them."""
    shared = _shared_index(spark, sf_dir, index)
    if shared is None:
        return part_build(spark, sf_dir)
    left = summands(spark, sf_dir).repartitionByRange("l_partkey").sortWithinPartitions("l_partkey")
    sums = left.mapInArrow(_fused(shared, False), "n long, d long")
    return ratio(sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("numerator"), F.coalesce(F.sum("d"), F.lit(0)).alias("denominator")))


# The ratio (in millionths of a per cent) by the number of lineitems of the standard tables.
KNOWN_RATIOS = {6001215: 16380778, 59986052: 16647594, 59986050: 16647594}


def known_ratio(n_lineitem: Column) -> Column:
    """The ratio that a table of so many lineitems must give, null if none is known."""
    out = F.lit(None).cast("long")
    for n, ratio_ in KNOWN_RATIOS.items():
        out = F.when(n_lineitem == n, F.lit(ratio_)).otherwise(out)
    return out


def validate(spark: SparkSession, sf_dir: str, result: DataFrame | None = None) -> DataFrame:
    """(n_lineitem, ratio, known, valid): a result, of the hash join by default, against the known ones; valid is null where none is."""
    n = relation(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_lineitem"))
    # one row each
    both = (part_build(spark, sf_dir) if result is None else result).select("ratio").crossJoin(F.broadcast(n))
    return both.select("n_lineitem", "ratio", known_ratio(F.col("n_lineitem")).alias("known")).withColumn("valid", F.col("ratio") == F.col("known"))


def phases(spark: SparkSession, sf_dir: str, index: str = "btree") -> tuple[DataFrame, dict[str, Observation]]:
    """The two-phase plan, and what passes through its phases (rows of scan and lookup; key range), counted while it runs."""
    seen = {name: Observation(name) for name in ("scan", "lookup")}
    scan = summands(spark, sf_dir).observe(seen["scan"], F.count("*").alias("rows"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"))
    rows = scan.select(F.monotonically_increasing_id().alias("probe_id"), F.col("l_partkey").alias("key"), "summand")
    parts = with_positions(promo_parts(spark, sf_dir), "p_partkey", "part_pos").select("part_pos", "promo")
    found = lookup(rows, relation(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), index, "plain", "exact", payload=("summand",)).where("pos is not null")
    found = found.observe(seen["lookup"], F.count("*").alias("rows"), F.sum("summand").alias("summand"))
    return aggregate(hash_join(found.select(F.col("pos").alias("part_pos"), "summand"), parts, "part_pos")), seen


#: By name, as the command line takes them; lane refill has no plan of its own and is the two-phase one.
APPROACHES: dict[str, Callable[..., DataFrame]] = {
    "hj": lambda spark, d, index="btree": part_build(spark, d),
    "hj_lineitem_build": lambda spark, d, index="btree": lineitem_build(spark, d),
    "ij_plain": index_join,
    "ij_p_bws": lambda spark, d, index="btree": index_join(spark, d, index, sort=True),
    "ij_np_lf_plain": lookup_first,
    "ij_np_lf_lr_plain": lookup_first,
    "ij_partitioning": lambda spark, d, index="btree": index_join(spark, d, index, partitioned=True),
    "split": split,
}

ORACLE = """
SELECT CAST(n AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator,
       CAST((100 * (n * 1000)) // nullif(d // 1000, 0) AS BIGINT) AS ratio
FROM (SELECT coalesce(sum(CASE WHEN p_type LIKE 'PROMO%' THEN s ELSE 0 END), 0) AS n, coalesce(sum(s), 0) AS d
      FROM (SELECT l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS s
            FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01') l
      JOIN part ON l_partkey = p_partkey)
"""
