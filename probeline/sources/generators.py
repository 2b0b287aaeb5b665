"""Seeded generators of sorted key relations and of lookups that hit them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.operators.positions import with_positions

DATASETS = ("dense", "sparse")
PATTERNS = ("uniform", "uniform_unique", "zipf")


def dense_keys(spark: SparkSession, n: int) -> DataFrame:
    """0 to n - 1: a key is its position."""
    return spark.range(n).select(F.col("id").alias("key"))


def uniform(spark: SparkSession, n: int, limit: int, seed: int = 0) -> DataFrame:
    """n whole numbers from [0, limit), with replacement."""
    return spark.range(n).select(F.least(F.floor(F.rand(seed) * limit), F.lit(limit - 1)).cast("long").alias("key"))


def unique_uniform(spark: SparkSession, n: int, limit: int, seed: int = 0) -> DataFrame:
    """n different whole numbers from [0, limit).

    A dense draw (more than half of the range) keeps the n smallest of a hash
    order of the range; a sparse one draws more than it needs and keeps n of
    the different values.
    """
    if n > limit:
        raise ValueError(f"{n} different numbers don't fit into [0, {limit})")
    if limit <= 2 * n:
        drawn = spark.range(limit).select(F.col("id").alias("key"))
    else:
        # a share of about n / limit is taken twice; the surplus makes a shortfall all but impossible
        surplus = n + int(n * n / limit) + 8 * int(math.sqrt(n)) + 16
        drawn = uniform(spark, surplus, limit, seed).distinct()
    return sample_distinct(drawn, n, seed)


def sparse_keys(spark: SparkSession, n: int, max_bits: int = 0, seed: int = 0) -> DataFrame:
    """n different sorted keys from [0, 2 ** (max_bits - 1)); 0 derives max_bits from n."""
    bits = max_bits or max(2, math.ceil(math.log2(max(n, 1))) + 2)
    if 2 ** (bits - 1) < n:
        raise ValueError(f"{n} keys aren't sparse in {bits} bits")
    return unique_uniform(spark, n, 2 ** (bits - 1), seed).orderBy("key")


def zipf_ranks(rng: np.random.Generator, n: int, limit: int, exponent: float) -> np.ndarray:
    """n draws from 1 .. limit with probability proportional to k ** -exponent, without a table of all ranks.

    The envelope x ** -exponent is drawn by inversion and rounded to a rank,
    which is accepted by its true probability over the envelope's mass there.
    """
    out = np.empty(0, np.int64)

    def area(x: np.ndarray | float):
        return np.log(x) if exponent == 1 else (np.power(x, 1 - exponent) - 1) / (1 - exponent)

    lo, hi = area(0.5) if exponent != 1 else math.log(0.5), area(limit + 0.5)
    while len(out) < n:
        u = lo + rng.random(2 * (n - len(out)) + 16) * (hi - lo)
        x = np.exp(u) if exponent == 1 else np.power(1 + u * (1 - exponent), 1 / (1 - exponent))
        k = np.clip(np.rint(x), 1, limit).astype(np.int64)
        # the envelope x ** -exponent has at least the mass of k over [k - 0.5, k + 0.5]
        mass = area(k + 0.5) - area(k - 0.5)
        out = np.concatenate([out, k[rng.random(len(k)) * mass <= np.power(k.astype(float), -exponent)]])
    return out[:n]


def zipf(spark: SparkSession, n: int, limit: int, exponent: float = 1.25, seed: int = 0) -> DataFrame:
    """n positions from [1, limit), position 0 never, the smallest most often; every block of rows has its own seed."""
    block = 1 << 16

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"]:
                rng = np.random.default_rng([seed, int(b)])
                yield pd.DataFrame({"key": zipf_ranks(rng, min(block, n - int(b) * block), limit - 1, exponent)})

    return spark.range(-(-n // block)).mapInPandas(draw, "key long")


def datasets(
    spark: SparkSession, dataset: str, pattern: str, n_keys: int, n_lookups: int, max_bits: int = 0, exponent: float = 1.25, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(indexed: key; lookups: probe_id, key): positions are drawn and mapped to keys, so every lookup hits."""
    if dataset not in DATASETS or pattern not in PATTERNS:
        raise ValueError(f"dataset {dataset!r} or pattern {pattern!r} is unknown")
    indexed = dense_keys(spark, n_keys) if dataset == "dense" else sparse_keys(spark, n_keys, max_bits, seed)
    if pattern == "uniform_unique" and n_lookups > n_keys:
        raise ValueError("more unique lookups than keys")
    drawn = {"uniform": lambda: uniform(spark, n_lookups, n_keys, seed + 1), "uniform_unique": lambda: unique_uniform(spark, n_lookups, n_keys, seed + 1), "zipf": lambda: zipf(spark, n_lookups, n_keys, exponent, seed + 1)}[pattern]()
    positions = drawn.withColumnRenamed("key", "pos").withColumn("probe_id", F.monotonically_increasing_id())
    if dataset == "dense":
        return indexed, positions.select("probe_id", F.col("pos").alias("key"))
    return indexed, positions.join(with_positions(indexed, "key"), "pos").select("probe_id", "key")


def sample_distinct(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows of df, each at most once, the first in a random order, which is numbered range by range; for the same seed the same ones, but for equal rows."""
    return shuffled(df, seed).where(F.col("place") < n).drop("place")


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """df with a place for each row in a random order, numbered range by range of a hash."""
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns, F.lit(seed)))
    return with_positions(hashed, "_hash", "place").drop("_hash")
