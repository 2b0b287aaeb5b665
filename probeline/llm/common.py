"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.session import hadoop_path, shared_path

#: Garbage is collected no more often; jobs that are shorter leave little.
GC_SECONDS = 8.0
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
_collected = 0.0


#: Spark's own clean-up of what a command has shuffled, at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no recomputation of what
    stands above.  release() deletes the table; what isn't released goes when
    the driver ends, even if the session was stopped before.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    del df
    free_memory(spark)
    out = spark.read.schema(schema).parquet(path)
    out._spilled_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the tables of frames that spill() gave; nothing may read them after. Other frames are passed over."""
    for df in tables:
        if path := df.__dict__.pop("_spilled_to", None):
            where, files = hadoop_path(df.sparkSession, path)
            files.delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers get texts in Arrow batches of ARROW_BYTES at most, unless the session asks for fewer; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        have = spark.conf.get(name, "")
        asked = int(have) if have.isdigit() else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(have)
    except Exception:  # a Spark without this setting
        return
    if not 0 < asked <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def free_memory(spark: SparkSession) -> None:
    """Lets Spark drop broadcasts and shuffles that nothing refers to any more, at most once in GC_SECONDS."""
    global _collected
    if time.monotonic() - _collected >= GC_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def bucketed(df: DataFrame, name: str, column: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write df as a table of the warehouse in buckets of column, so that joins on it don't move df again.

    Also returns what deletes the table once nothing needs it any more.
    """
    spark = df.sparkSession
    made = f"probeline_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").bucketBy(buckets, column).saveAsTable(made)
    del df
    free_memory(spark)
    out = spark.table(made)
    where, files = hadoop_path(spark, os.path.dirname(out.inputFiles()[0])) if out.inputFiles() else (None, None)
    if where is not None:
        files.deleteOnExit(where)
    return out, lambda: spark.sql(f"DROP TABLE IF EXISTS {made}") and None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)
