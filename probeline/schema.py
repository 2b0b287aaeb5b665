"""Schemas of the relations, and the fixed-point forms of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONEY = T.DecimalType(15, 2)


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


LINEITEM = _fields(
    ("l_orderkey", T.LongType()), ("l_partkey", T.LongType()), ("l_suppkey", T.LongType()), ("l_linenumber", T.LongType()),
    ("l_quantity", _MONEY), ("l_extendedprice", _MONEY), ("l_discount", _MONEY), ("l_tax", _MONEY),
    ("l_returnflag", T.StringType()), ("l_linestatus", T.StringType()),
    ("l_shipdate", T.DateType()), ("l_commitdate", T.DateType()), ("l_receiptdate", T.DateType()),
    ("l_shipinstruct", T.StringType()), ("l_shipmode", T.StringType()), ("l_comment", T.StringType()),
)
PART = _fields(
    ("p_partkey", T.LongType()), ("p_name", T.StringType()), ("p_mfgr", T.StringType()), ("p_brand", T.StringType()), ("p_type", T.StringType()),
    ("p_size", T.IntegerType()), ("p_container", T.StringType()), ("p_retailprice", _MONEY), ("p_comment", T.StringType()),
)


def scaled(column: str, factor: int = 100):
    """A two-decimal amount as a whole number of hundredths: exact sums, in any order, and no negative zero."""
    return F.round(F.col(column) * factor).cast("long")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("lineitem", "part", "orders")) -> None:
    """The tables of a folder as temporary views."""
    for name in names:
        relation(spark, sf_dir, name).createOrReplaceTempView(name)
