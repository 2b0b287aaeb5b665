"""Hash joins by key, and the comparison of two join results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

#: A build side is broadcast up to this many rows and bytes of values; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 22, 1 << 28
#: Rows of both results that one task compares, and copies of a row that are made at once.
DIFFERENCE_ROWS, COPIES = 1 << 18, 1 << 12


def _bytes(df: DataFrame) -> Column:
    """The bytes of a row's values: 8 each, and the text of those that vary in length."""
    varying = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema if not isinstance(f.dataType, (NumericType, DateType, TimestampType, TimestampNTZType, BooleanType))]
    return sum((F.coalesce(x, F.lit(0)) for x in varying), F.lit(8 * len(df.columns)))


def small_enough(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether a relation has no more than so many rows and bytes; counting stops at the rows."""
    rows, size = rows or BROADCAST_ROWS, size or BROADCAST_BYTES
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("bytes")).first()
    return seen.n <= rows and seen.bytes <= size


def hash_join(probe: DataFrame, build: DataFrame, on, how: str = "inner") -> DataFrame:
    """Broadcasts the build side if its checked size allows; else both sides are shuffled."""
    return probe.join(F.broadcast(build) if small_enough(build) else build.hint("shuffle_hash"), on, how)


def keep_one(build: DataFrame, key: str) -> DataFrame:
    """A build side with one row a key, the smallest: the defined form of "some writer wins"."""
    value = F.min(F.struct(*[c for c in build.columns if c != key])).alias("row")
    return build.groupBy(key).agg(value).select(key, "row.*")


def build_side(r_rows: Column | int, s_rows: Column | int) -> Column:
    """The side of fewer rows is built: `lookups` (r) or `indexed` (s, also if they are as many)."""
    r, s = (x if isinstance(x, Column) else F.lit(x) for x in (r_rows, s_rows))
    return F.when(r < s, "lookups").otherwise("indexed")


def scatter_keys(lookups: DataFrame, indexed: DataFrame, build: str = "lookups") -> DataFrame:
    """(build_tid, key): each matched lookup with its key.

    build: the side whose hash table is made, lookups or indexed; auto counts
    both and takes the smaller one.  It changes the plan, not the rows.
    """
    keys = indexed.select("key").distinct()
    if build == "auto":
        build = lookups.sparkSession.range(1).select(build_side(lookups.count(), keys.count())).first()[0]
    if build not in ("lookups", "indexed"):
        raise ValueError(f"build side {build!r} is neither lookups nor indexed nor auto")
    left, right = (keys, lookups.hint("shuffle_hash")) if build == "lookups" else (lookups, keys.hint("shuffle_hash"))
    return left.join(right, "key").select(F.col("probe_id").alias("build_tid"), "key")


def sum_of_matches(lookups: DataFrame, indexed: DataFrame) -> DataFrame:
    """(key_sum, n): only the aggregate of the join."""
    return scatter_keys(lookups, indexed).agg(F.coalesce(F.sum("key"), F.lit(0)).alias("key_sum"), F.count("*").alias("n"))


def difference(a: DataFrame, b: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows that one result has more often than the other, with the side that has them.

    rows: how many both have together; without it they are counted, and so read
    once more.  It only sets the number of tasks: each gets about DIFFERENCE_ROWS
    rows, dealt by a hash of the whole row before anything is grouped, so that
    the memory in which they are compared doesn't grow with the results.
    """
    rows = a.count() + b.count() if rows is None else rows
    names = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*names).withColumn("n", F.lit(1)).union(b.toDF(*names).withColumn("n", F.lit(-1)))
    dealt = both.repartition(max(1, -(-rows // DIFFERENCE_ROWS)), *names)
    left = dealt.groupBy(*names).agg(F.sum("n").alias("n")).where("n != 0").withColumn("side", F.when(F.col("n") > 0, "left").otherwise("right"))
    firsts = left.withColumn("n", F.abs("n")).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(COPIES).cast("long"))))
    copies = firsts.select(*names, "side", F.explode(F.sequence("first", F.least("n", F.col("first") + COPIES - 1))))
    return copies.select(*names, "side").toDF(*a.columns, "side")
