"""The pricing summary: eight aggregates by return flag and line status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.functions.fixed_point import charged, discounted, truncated_average
from probeline.schema import relation, scaled

UNTIL = "1998-09-02"


def shipped_until(rows: DataFrame, until: str = UNTIL) -> DataFrame:
    return rows.where(F.col("l_shipdate") <= F.lit(until).cast(dict(rows.dtypes)["l_shipdate"]))


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in whole units of their scale (2, 2, 4 and 6 decimals) and averages cut to two decimals, in group order."""
    rows = shipped_until(relation(spark, sf_dir, "lineitem"))
    quantity, price, discount, tax = (scaled(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))
    rows = rows.select("l_returnflag", "l_linestatus", quantity.alias("q"), price.alias("p"), discount.alias("d"), tax.alias("t"))
    sums = rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("q").alias("sum_qty"), F.sum("p").alias("sum_base_price"), F.sum(discounted(F.col("p"), F.col("d"))).alias("sum_disc_price"),
        F.sum(charged(F.col("p"), F.col("d"), F.col("t"))).alias("sum_charge"), F.sum("d").alias("sum_disc"), F.count("*").alias("count_order"),
    )
    averages = [truncated_average(total, "count_order").alias(name) for total, name in (("sum_qty", "avg_qty"), ("sum_base_price", "avg_price"), ("sum_disc", "avg_disc"))]
    return sums.select("l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", *averages, "count_order").orderBy("l_returnflag", "l_linestatus")


def q1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q1(spark, sf_dir).select("l_returnflag", "l_linestatus", "count_order")
