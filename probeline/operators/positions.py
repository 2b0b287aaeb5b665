"""Positions in key order and prefix sums, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges into which an ordered relation is cut: at least, at most, and the rows of one between these bounds.
RANGES, MOST_RANGES, RANGE_ROWS = 64, 1024, 1 << 20


def _cuts(df: DataFrame, key: str, ranges: int | None) -> list:
    """Approximate quantiles of the key, as many as its rows need; a key with many rows comes several times."""
    most = ranges or MOST_RANGES
    seen = df.agg(F.percentile_approx(key, [i / most for i in range(1, most)], 10_000).alias("c"), F.count("*").alias("n")).first()
    step = 1 if ranges else max(1, most // min(most, max(RANGES, -(-seen.n // RANGE_ROWS))))
    return (seen.c or [])[step - 1 :: step]


def _range_of(key: str, cuts: list) -> Column:
    """How many of the sorted cuts are smaller than the key; one nested comparison a level, as a balanced tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) > F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def with_range(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Adds `_range`, the number of approximate quantiles below the key: ranges are in key order, and equal keys share one."""
    return df.withColumn("_range", _range_of(key, sorted(set(_cuts(df, key, ranges)))))


def with_positions(df: DataFrame, key: str, name: str = "pos", ranges: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row in key order; equal keys have neighbouring places.

    Rows are numbered within their range; how many stand in the ranges before
    comes from one small table (a row a range).  A key that fills several
    ranges is dealt over as many parts, by a hash of the row, behind the rest
    of its range.
    """
    cuts = _cuts(df, key, ranges)
    times = {c: n for c in cuts if (n := cuts.count(c)) > 1}
    part = F.lit(0)
    for c, n in sorted(times.items(), reverse=True):
        part = F.when(F.col(key) == F.lit(c), 1 + F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")).otherwise(part)
    ranged = df.withColumn("_range", F.struct(_range_of(key, sorted(set(cuts))).alias("r"), part.alias("p")))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_row", own).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_row") - 1).cast("long").alias(name))


def exclusive_prefix(counts: DataFrame, order: str, value: str, name: str = "offset") -> DataFrame:
    """Adds the sum of `value` in the rows before; for small tables such as histograms."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))
