"""Radix partitions, their histograms and offsets, tasks, and windows of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeline.operators.positions import exclusive_prefix

#: Partitions are told apart by so many bits.
RADIX_BITS = 11


def radix_bits_of(max_key: int, radix_bits: int = RADIX_BITS) -> tuple[int, int]:
    """(bits, low bits to ignore) so that partitions follow the most significant bits of keys up to max_key."""
    width = max(max_key, 1).bit_length()
    return radix_bits, max(0, width - radix_bits)


def dataset_bits(df: DataFrame, key: str = "key") -> DataFrame:
    """floor(log2(largest key)), 0 for none or 0."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).select(F.when(F.col("m") > 0, F.length(F.bin("m")) - 1).otherwise(0).cast("int").alias("max_bits"))


def with_partition_id(df: DataFrame, key: str = "key", radix_bits: int = RADIX_BITS, ignore_bits: int = 0, name: str = "pid") -> DataFrame:
    """Adds (key >> ignore_bits) & (2 ** radix_bits - 1)."""
    return df.withColumn(name, F.shiftright(F.col(key), ignore_bits).bitwiseAND(F.lit((1 << radix_bits) - 1)).cast("int"))


def histogram(df: DataFrame, key: str = "key", radix_bits: int = RADIX_BITS, ignore_bits: int = 0) -> DataFrame:
    """(pid, n) of the partitions that have rows."""
    return with_partition_id(df, key, radix_bits, ignore_bits).groupBy("pid").agg(F.count("*").alias("n"))


def offsets(df: DataFrame, key: str = "key", radix_bits: int = RADIX_BITS, ignore_bits: int = 0) -> DataFrame:
    """(pid, n, offset): where each partition begins if they lie one after the other."""
    return exclusive_prefix(histogram(df, key, radix_bits, ignore_bits), "pid", "n")


def assign_tasks(sizes: DataFrame, workers: int) -> DataFrame:
    """(pid, n, task): neighbouring partitions packed greedily, a task closing once it has the average or more.

    One row a partition (2 ** radix_bits at most) goes through one ordered
    aggregate, whose state is the open task and its rows.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("pid", "n"))).alias("parts"))
    least = F.greatest(F.ceil(F.col("total") / workers), F.lit(1))
    start = F.struct(F.lit(0).alias("task"), F.lit(0).cast("long").alias("full"), F.array().cast("array<struct<pid:int,n:bigint,task:int>>").alias("out"))

    def step(state, part):
        full = state["full"] + part["n"]
        closes = full >= F.col("least")
        return F.struct(
            F.when(closes, state["task"] + 1).otherwise(state["task"]).alias("task"), F.when(closes, F.lit(0).cast("long")).otherwise(full).alias("full"),
            F.concat(state["out"], F.array(F.struct(part["pid"].alias("pid"), part["n"].alias("n"), state["task"].alias("task")))).alias("out"),
        )

    return total.withColumn("least", least).select(F.explode(F.aggregate("parts", start, step, lambda s: s["out"])).alias("p")).select("p.pid", "p.n", F.least("p.task", F.lit(workers - 1)).alias("task"))


def with_window_id(df: DataFrame, window: int = 10_000, probe_id: str = "probe_id") -> DataFrame:
    """Adds the number of the window of `window` probes; any number of windows."""
    if window < 1:
        raise ValueError("a window has one probe at least")
    return df.withColumn("window_id", F.floor(F.col(probe_id) / window))


def distribute(df: DataFrame, key: str = "key", radix_bits: int = RADIX_BITS, ignore_bits: int = 0) -> DataFrame:
    """The rows dealt to Spark's partitions by their radix partition."""
    return with_partition_id(df, key, radix_bits, ignore_bits).repartition("pid")


def running_offsets(df: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """Adds each row's 0-based place within its group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("long"))
