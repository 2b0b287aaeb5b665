"""Benchmark decontamination: hashed test n-grams, scanned token windows, verified hits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import release, small_batches, spill
from probeline.llm.wordcore import NON_ALNUM, Words, slices, window_hashes

#: Bytes of benchmark text in one broadcast index; a larger benchmark goes in several blocks.
BLOCK_BYTES = 16 << 20
#: Blocks that one pass over the documents has in memory; after each but the last pass they are written.
BLOCKS_AT_ONCE = 4


class _Index:
    """All windows of a block of benchmark items: sorted hashes for each window length, the words of each window, its items."""

    def __init__(self, items: list[tuple[int | None, str | None]], length: int):
        texts = pa.array([t or "" for _, t in items], pa.string())
        words = Words(texts, NON_ALNUM)
        hashes = words.hashes()
        # the windows of each hash, which may be several, with their items
        self.windows: dict[int, dict[bytes, set]] = defaultdict(dict)
        by_length: dict[int, set] = defaultdict(set)
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if a == b:
                continue
            n = min(length, b - a)
            for j, h in enumerate(window_hashes(hashes[a:b], n).tolist()):
                own = self.windows[h].setdefault(b" ".join(words.word(x) for x in range(a + j, a + j + n)), set())
                by_length[n].add(h)
                if item is not None:
                    own.add(item)
        self.sorted = {n: np.array(sorted(x), np.uint64) for n, x in by_length.items()}
        self.bits = {}
        for n, x in self.sorted.items():
            self.bits[n] = np.zeros(1 << 20, bool)
            self.bits[n][(x & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, set]]:
        """(first word, length, items) of each window of the texts that is one of the index, its words compared."""
        hashes, doc = words.hashes(), words.documents()
        for n, known in self.sorted.items():
            w = window_hashes(hashes, n)
            at = np.flatnonzero(self.bits[n][(w & np.uint64((1 << 20) - 1)).astype(np.int64)] & (doc[: len(w)] == doc[n - 1 :][: len(w)]))
            place = np.minimum(np.searchsorted(known, w[at]), len(known) - 1)
            for i in at[known[place] == w[at]].tolist():
                own = self.windows[int(w[i])].get(b" ".join(words.word(x) for x in range(i, i + n)))
                if own is not None:
                    yield i, n, own


def _scan(index: Broadcast, text_col: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for whole in batches:
            for batch in slices(whole, text_col):
                at = batch.schema.get_field_index
                words = Words(batch.column(at(text_col)), NON_ALNUM)
                spans = [list(map(tuple, x or ())) for x in _pairs(batch.column(at("hit_spans")))]
                items = [set(x or ()) for x in batch.column(at("hit_items")).to_pylist()]
                edges = np.zeros(len(words) + 1, np.int64)
                owner = words.documents()
                for i, n, own in found.hits(words):
                    edges[i] += 1
                    edges[i + n] -= 1
                    items[owner[i]].update(own)
                hit = np.cumsum(edges)[:-1] > 0
                at_hit = np.flatnonzero(hit)
                if len(at_hit):
                    breaks = np.flatnonzero((np.diff(at_hit) > 1) | (np.diff(owner[at_hit]) > 0))
                    for a, b in zip(at_hit[np.r_[0, breaks + 1]].tolist(), at_hit[np.r_[breaks, len(at_hit) - 1]].tolist(), strict=True):
                        d = int(owner[a])
                        spans[d].append((a - int(words.first[d]), b + 1 - int(words.first[d])))
                out = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                out["hit_spans"] = pa.array([[{"first": a, "stop": b} for a, b in _merged(x)] for x in spans], _SPANS)
                out["hit_items"] = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
                out["n_words"] = pa.array(np.diff(words.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return scan if then is None else lambda batches: then(scan(batches))


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _pairs(column: pa.Array) -> list[list[tuple[int, int]] | None]:
    return [None if x is None else [(y["first"], y["stop"]) for y in x] for x in column.to_pylist()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, length: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    cut: bool = False,
) -> DataFrame:
    """Adds to each document what it shares with the benchmark.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all
    non-ASCII characters.  A window is `length` consecutive words of an item;
    an item of fewer words, but not none, is one window.  New columns:
    n_words long, hit_spans array<struct<first,stop>> (maximal runs of word
    places inside any occurrence of a window), hit_items array<long> (items
    with occurring windows), n_hit long.

    The windows of at most `block_bytes` of benchmark text are broadcast at a
    time; a larger benchmark is dealt into blocks by hash, BLOCKS_AT_ONCE of
    which pass over the documents in one stage, without a shuffle.  A null text has
    no words; items without words mark nothing; items with a null id mark words
    but are in no list; repeated items and documents count as they stand.
    Columns of docs named like the new ones are replaced.  With `cut`, the
    texts that come back are without the hit runs of words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.drop("n_words", "hit_spans", "hit_items", "n_hit").select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:bigint,stop:bigint>>").alias("hit_spans"),
        F.array().cast("array<bigint>").alias("hit_items"),
    )
    held, before = [], out
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        index = _Index([(r["item"], r["text"]) for r in part.distinct().collect()], length)
        held.append(spark.sparkContext.broadcast(index))
        # the last pass cuts too, in the same worker
        out = out.mapInArrow(_scan(held[-1], text_col, _cut(text_col) if cut and b + 1 == blocks else None), out.schema)
        if len(held) == BLOCKS_AT_ONCE and b + 1 < blocks:
            out = spill(out, "scanned")
            for x in held:
                x.destroy()
            release(before)
            before, held = out, []
    return out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"]))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule by which a whole document goes: a twentieth of its words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def _cut(text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = batch.column(at(text_col)).to_pylist()
            for i, spans in enumerate(_pairs(batch.column(at("hit_spans")))):
                if spans:
                    column = pa.array([texts[i]], pa.string())
                    words = Words(column, NON_ALNUM)
                    raw, kept, done = texts[i].encode(), [], 0
                    for a, b in spans:
                        kept.append(raw[done : int(words.starts[a])])
                        done = int(words.ends[b - 1])
                    texts[i] = b"".join([*kept, raw[done:]]).decode()
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[at(text_col)] = pa.array(texts, batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents without benchmark passages, in the columns of docs.

    A document with a twentieth of its words hit goes; of any other, the hit
    runs of words are cut out of the text and the rest stays byte for byte.
    """
    return find_contamination(docs, benchmark, text_col=text_col, cut=True, **options).where(~contaminated()).select(*docs.columns)
