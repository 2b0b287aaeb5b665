"""Harmonic packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import small_batches, spill

#: A piece may leave so much of its place in a bin empty (as a part of the bin); else a part is cut off.
SLACK = 1 / 32
#: So many partitions hand their open bins to one task of the next round.
FAN_IN = 64
#: The special string of the vocabulary; its id follows the ranks.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Encodes as the byte-level BPE vocabulary at path does; the special string in a text is its one id.

    A `.json` file is read by `tokenizers`; a `.tiktoken` file (ranks of the
    same vocabulary) by `tiktoken`, which gives the same ids several times faster.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_file(path)
        return lambda text: bpe.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: bpe.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else bpe.encode_ordinary(text)


def pieces_of(n: int, capacity: int, slack: float = SLACK) -> list[int]:
    """Lengths into which n tokens are cut: whole bins, then parts that fill reciprocal places.

    A rest r belongs to the class k = capacity // r, whose bins take k pieces.
    Where k such pieces would leave more than `slack` of the bin empty, the
    place of the next class, capacity // (k + 1) tokens, is cut off first; at
    least half of r goes each time, so few pieces come of it.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


_COLUMNS = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "class", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


class _Bins:
    """One open bin a class; a bin that has its count of pieces is closed and numbered."""

    def __init__(self, first_id: int):
        self.open: dict[int, list[list]] = defaultdict(list)
        self.next, self.done = first_id, []

    def add(self, row: list) -> None:
        k = row[5]
        bin_ = self.open[k]
        bin_.append(row)
        if len(bin_) == k:
            self.close(bin_)
            self.open[k] = []

    def close(self, bin_: list[list]) -> None:
        offset = 0
        for row in bin_:
            row[6], row[7] = self.next, offset
            offset += row[3]
        self.done += bin_
        self.next += 1

    def rest(self) -> list[list]:
        return [row for bin_ in self.open.values() for row in bin_]


def _number(round_: int, group: int) -> int:
    """Where a task's sequence ids begin: rounds and tasks don't meet."""
    return (round_ << 58) | (group << 34)


def _pack_partition(path: str, capacity: int, end_id: int, keep_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        part = TaskContext.get().partitionId()
        bins = _Bins(_number(0, part))

        def out(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[r[:8] for r in rows], strict=True)) or [[]] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            arrays.append(pa.array([part] * len(rows), pa.int32()))
            if keep_ids:
                arrays.append(pa.array([r[8] for r in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[*_COLUMNS, "part", *["ids"] * keep_ids])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start = 0
                for n in pieces_of(len(ids), capacity):
                    own = ids[start : start + n]
                    bins.add([doc_id, len(ids), start, n, zlib.crc32(own.tobytes()), capacity // n, None, None, *([own.astype(np.int32)] if keep_ids else [])])
                    start += n
                if len(bins.done) >= 20_000 >> (3 * keep_ids):
                    yield out(bins.done)
                    bins.done = []
        yield out(bins.done + bins.rest())

    return pack


def _merge_class(round_: int, width: int):
    """Fills the bins of one class from the open bins of some partitions."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        k, group = int(pdf["class"].iloc[0]), int(pdf["group"].iloc[0])
        pdf = pdf.sort_values(["part", "doc_id", "start", "length", "ids_crc32"]).reset_index(drop=True)
        full = len(pdf) // k * k
        place = np.arange(len(pdf))
        # a class has its own numbers within its group
        ids = _number(round_, 0) + ((group * width + k) << 20) + place // k
        sums = pdf["length"].cumsum() - pdf["length"]
        offset = sums - sums.to_numpy()[place // k * k]
        pdf["sequence_id"] = pd.Series(ids).where(place < full).astype("Int64")
        pdf["offset"] = pd.Series(offset).where(place < full).astype("Int64")
        pdf["part"] = group
        return pdf.drop(columns="group")

    return merge


def _first_fit(round_: int, capacity: int):
    """Packs the last open bins, fewer than the class number of pieces from each class, longest pieces first."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        used: list[int] = []
        ids, offsets = [], []
        for n in pdf["length"].tolist():
            b = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if b == len(used):
                used.append(0)
            ids.append(_number(round_, 0) + b)
            offsets.append(used[b])
            used[b] += n
        pdf["sequence_id"], pdf["offset"] = ids, offsets
        return pdf.drop(columns="group")

    return fit


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    A document is the ids of its text and then `end_id`; a null text is empty.
    It is cut as `pieces_of` says.  Each worker fills, for every class k, bins
    of k pieces on its own, in the task that makes the ids, so that no ids
    move.  Open bins (fewer than k pieces a class and task) meet in rounds of
    FAN_IN tasks, class by class; the last ones, whose number doesn't depend
    on the input, are packed first fit.

    Returns one row a piece: the id column, start, length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    class, and with keep_ids the ids.  Sequence ids are unique, not gapless.
    Null ids and repeated rows are packed as they stand; an empty table gives
    no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, class int, sequence_id long, offset long, part int" + ", ids array<int>" * keep_ids
    packed = spill(rows.mapInArrow(_pack_partition(tokenizer, capacity, end_id, keep_ids), schema), "packing")
    done, rest = packed.where(F.col("sequence_id").isNotNull()), packed.where(F.col("sequence_id").isNull())
    parts, round_ = (rest.agg(F.max("part")).first()[0] or 0) + 1, 0
    while parts > 1 or round_ == 0:
        round_ += 1
        rest = rest.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int"))
        merged = spill(rest.groupBy("class", "group").applyInPandas(_merge_class(round_, capacity + 1), schema), "packing-merge")
        done = done.unionByName(merged.where(F.col("sequence_id").isNotNull()))
        rest = merged.where(F.col("sequence_id").isNull())
        parts = -(-parts // FAN_IN)
    rest = rest.withColumn("group", F.lit(0)).groupBy("group").applyInPandas(_first_fit(round_ + 1, capacity), schema)
    done = done.unionByName(rest)
    return done.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", *["ids"] * keep_ids)
