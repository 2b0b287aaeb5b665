"""Lookups of a stream of probes against a static indexed side, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probeline.operators.lookup import SCHEMA, lookup
from probeline.session import shared_path


def lookup_stream(
    spark: SparkSession, path: str, to_probe: Callable[[DataFrame], DataFrame], indexed: DataFrame, index: str = "binary_search", semantics: str = "exact", files: int = 1
) -> DataFrame:
    """Reads the Parquet files of path as a stream, `files` of them a batch, and looks each batch up.

    to_probe makes (probe_id, key) of the rows.  Each batch is written under
    its number, so one that is repeated after a failure replaces itself and
    every probe comes out once.
    """
    base = shared_path(spark, "probeline-stream")
    schema = spark.read.parquet(path).schema

    def one_batch(batch: DataFrame, number: int) -> None:
        lookup(to_probe(batch), indexed, index, "plain", semantics).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder)
    query = source.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{base}/out/*")
