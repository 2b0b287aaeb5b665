"""`|`-delimited text tables, and the measurement sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.schema import LINEITEM, PART

#: What a trailing delimiter leaves behind the last column.
TAIL = "_tail"
CORRUPT = "_corrupt"


def read_tbl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """Reads a table whose lines end in a delimiter.

    FAILFAST stops at a malformed line, DROPMALFORMED passes it over and
    PERMISSIVE keeps it, whole, in the column `_corrupt`; no row is ever
    dropped in silence.  A missing last newline or last delimiter is fine.  With
    DROPMALFORMED a bare count(), which reads no column, sees short lines only.
    """
    full = T.StructType([*schema.fields, T.StructField(TAIL, T.StringType())])
    if mode == "PERMISSIVE":
        full = full.add(CORRUPT, T.StringType())
    reader = spark.read.schema(full).option("sep", "|").option("mode", mode).option("dateFormat", "yyyy-MM-dd")
    return reader.option("columnPruning", "false").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true").csv(path).drop(TAIL)


def load_database(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """lineitem and part of a folder of `.tbl` files, registered as views."""
    tables = {"lineitem": read_tbl(spark, f"{folder}/lineitem.tbl", LINEITEM), "part": read_tbl(spark, f"{folder}/part.tbl", PART)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def write_tbl(df: DataFrame, path: str) -> None:
    """Writes a table so that read_tbl() reads it back, with the trailing delimiter."""
    df.withColumn(TAIL, F.lit("")).write.mode("overwrite").option("sep", "|").option("emptyValue", "").option("dateFormat", "yyyy-MM-dd").csv(path)


def line_width(spark: SparkSession, path: str) -> DataFrame:
    """The average line length of a text file and the number of its lines."""
    return spark.read.text(path).agg(F.avg(F.length("value")).alias("avg_width"), F.count("*").alias("n_lines"))


def append_measurement(spark: SparkSession, path: str, record: dict) -> None:
    """Appends one measurement as JSON."""
    spark.createDataFrame([{k: str(v) for k, v in record.items()}]).coalesce(1).write.mode("append").json(path)
