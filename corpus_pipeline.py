"""The training-corpus pipeline: filter, dedup twice, decontaminate and pack documents.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; run()
writes each one's result as Parquet into the shared folder and gives the next
what it reads back.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.llm import contamination, line_dedup, ngram_join, packing, toxicity
from probeline.llm.common import bucket_of, shared_path, spill, table
from probeline.llm.queries import tokenizer_path

#: Documents that score as much or more are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC; the model learns from the labels of documents that op2's query learns from."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable=bucket_of("doc_id", 3) != 1)
    return toxicity.score(docs, model, score_col="_toxicity").where(F.col("_toxicity") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are in an earlier document, or higher up, up to THRESHOLD edits.

    A document of which nothing but blanks is left goes; one that was empty
    before stays as it is.  n_chars follows the text.
    """
    cut = line_dedup.dedup_lines(docs, copy_chars=line_dedup.COPY_CHARS, words_per_edit=line_dedup.WORDS_PER_EDIT)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")
    return _measured(cut.where(~emptied), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id (null ids last; of rows with equal ids, that of the smallest hash of id and text).

    Of rows equal in id and text one stays; texts without words are linked
    with nothing and all stay, repeated or not.
    """
    own = F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text")
    rows = docs.withColumn("_row", own)
    groups = ngram_join.jaccard_components(rows.select("_row", "text"), id_col="_row").where("n_shingles > 0").distinct()
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), "_row").alias("place")).distinct()
    kept = groups.join(ids, "_row").groupBy("component_id").agg(F.min("place").alias("place")).select("place._row")
    kept = spill(kept, "kept-rows")
    # a blank text has a number of its own, so that repeated ones stay apart
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = rows.withColumn("_blank", F.when(blank, F.monotonically_increasing_id())).join(kept.withColumn("_kept", F.lit(True)), "_row", "left")
    return marked.where(F.col("_kept") | F.col("_blank").isNotNull()).dropDuplicates(["_row", "_blank"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the passages of benchmark items are cut out."""
    return _measured(contamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row a piece."""
    return packing.pack(docs, tokenizer_path())


def _measured(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, n_chars counted anew where the text isn't null."""
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(like.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*like.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Packing needs a tokenizer, which SQL doesn't have; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
