"""Balanced contiguous shards from prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import spill


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds each row's place and the bytes before it, within its partition."""
    row = done = 0
    for pdf in batches:
        before = pdf["size"].cumsum()
        yield pdf.assign(part_row=range(row, row + len(pdf)), part_bytes=before - pdf["size"] + done)
        row += len(pdf)
        done += int(before.iloc[-1]) if len(pdf) else 0


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of `shards` contiguous shards of nearly equal bytes.

    Rows are taken in the order of id (nulls first, equal ids by content).
    Each range partition sums its own sizes; the totals, one row a partition,
    are added up, and that gives the bytes before each row in the whole table.
    A row goes to the shard in whose equal slice of all bytes its middle lies,
    so a shard misses its target by less than the two rows at its ends.

    Returns id, size, text_crc32, shard, slot.  A null text has no bytes and
    counts 1 for its end, as an empty one does.  Only these narrow columns are
    moved, never texts.  Extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("tie")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = "id {}, size long, text_crc32 long, part int, part_row long, part_bytes long".format(narrow.schema["id"].dataType.simpleString())
    rows = spill(ranged.drop("tie").mapInPandas(_running, schema), "sharding")

    # one row a partition: as many as there are tasks, not as there are rows
    totals = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("part").collect()
    before, n_all, b_all = [], 0, 0
    for t in totals:
        before.append((t.part, n_all, b_all))
        n_all, b_all = n_all + t.n, b_all + t.b
    spark = docs.sparkSession
    offsets = spark.createDataFrame(before, "part int, rows_before long, bytes_before long")
    middle = "(2 * (part_bytes + bytes_before) + size)"  # twice the middle byte of a row
    placed = rows.join(F.broadcast(offsets), "part").select(
        "id", "size", "text_crc32",
        (F.col("part_row") + F.col("rows_before")).alias("row"),
        F.expr(f"cast({middle} * {shards} div {max(2 * b_all, 1)} as int)").alias("shard"),
    )
    # one row a shard
    firsts = spark.createDataFrame([(r.shard, r.first) for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()], "shard int, first long")
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"),
    )
