"""Order priorities: orders of a quarter with a late lineitem, by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.schema import relation


def q4(spark: SparkSession, sf_dir: str, start: str = "1995-07-01", end: str = "1995-10-01", early: str = "o_orderdate", late: str = "l_shipdate") -> DataFrame:
    """A semi-join: each order counts once, however many late lineitems it has.

    A lineitem is late if `late` is after `early`; with the commit and receipt
    dates of a full lineitem table these are l_commitdate and l_receiptdate.
    """
    orders, items = relation(spark, sf_dir, "orders"), relation(spark, sf_dir, "lineitem")
    kind = dict(orders.dtypes)["o_orderdate"]
    orders = orders.where((F.col("o_orderdate") >= F.lit(start).cast(kind)) & (F.col("o_orderdate") < F.lit(end).cast(kind)))
    late_ones = orders.join(items, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col(late) > F.col(early)), "left_semi")
    return late_ones.groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")
