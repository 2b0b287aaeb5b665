"""The thin queries opN_<name> over the production tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.llm import ann, chat, contamination, lattice_lm, line_dedup, ngram_join, oracles, packing, sharding, suffix_dedup, toxicity
from probeline.llm.common import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A file of the installed vocabularies; the `.tiktoken` file has the ranks of `byte_bpe_50k.json`."""
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ 2


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable=bucket_of("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


# ------------------------------------------------------------------ 5


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), contamination.contaminated().alias("contaminated"),
    )


# ------------------------------------------------------------------ 6


@_query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


# ------------------------------------------------------------------ 9


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# ------------------------------------------------------------------ 10


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of each conversation, from its formatted chunks (in order) alone."""
    rows = ((c, (t, s)) for pdf in batches for c, t, s in zip(pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None), pdf["formatted"], pdf["loss_spans"], strict=True))
    guard = chat.ControlStrings(chat.CONTROL)
    out: list[tuple] = []
    for conv, chunks in chat._runs(rows):
        loss, n_loss, n_chars = hashlib.sha256(), 0, 0

        def texts(chunks=chunks, loss=loss) -> Iterator[str]:
            nonlocal n_loss, n_chars
            for text, spans in chunks:
                n_chars += len(text)
                for s in spans:
                    own = guard.unescape(text[s["start"] : s["stop"]])
                    n_loss += len(own)
                    loss.update(own.encode())
                yield text

        turns, n = hashlib.sha256(), 0
        for role, text in chat.read_turns(texts()):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
        if len(out) >= 5000:
            yield _digests(out)
            out = []
    yield _digests(out)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat.format_conversations(turns.unionByName(probe))
    return formatted.mapInPandas(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


# ------------------------------------------------------------------ 1


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, copy_chars=line_dedup.COPY_CHARS, words_per_edit=line_dedup.WORDS_PER_EDIT).select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 7


@_query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 8


@_query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# ------------------------------------------------------------------ 3


@_query
def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), bucket_of("doc_id", 7) != 2, tokenizer_path())


# ------------------------------------------------------------------ 4


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES.update(oracles.ORACLES)
