"""Document likelihood under a subword lattice.

The units are the pieces of an existing byte-level vocabulary (a leading space
marks the start of a word) with unigram scores, and the words of the training
corpus.  A word's probability is the sum over all its segmentations, by the
forward recursion in log space; no piece crosses the start of a word, so a
document's marginal probability is the product over its words and its end.

Word units have discounted corpus counts; the mass that the discount frees
goes to paths of pieces.  The pieces' scores start from their ranks in the
vocabulary and are re-estimated on all words of the training corpus by
expectation maximisation over the same lattice.
"""

from __future__ import annotations

import base64
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import small_batches, spill
from probeline.llm.wordcore import SPACE, _BASE, _INVERSE, Words, _power, buffer_of, mix, slices

#: Taken from the count of each word unit.
DISCOUNT = 0.75
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Pieces of the vocabulary may have so many bytes: all are used.
PIECE_BYTES = sys.maxsize
#: Share of the freed mass that a document's end has.
END_SHARE = 0.01
#: Words whose counts and scores are broadcast, at most (24 bytes each); the others are joined.
FREQUENT = 1 << 19
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 1_500_000
#: Bytes of words whose lattices are worked on together.
LATTICE_BYTES = 1 << 18

_U = np.uint64
_LN10 = math.log(10)


# ---------------------------------------------------------------- the lattice


def vocabulary_pieces(path: str) -> list[bytes]:
    """The pieces of a `.tiktoken` vocabulary, by rank."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    return [token for _, token in rows]


def usable_pieces(pieces: list[bytes]) -> list[tuple[bytes, float]]:
    """(piece, first score) of the pieces that lower-cased words can have, and all single bytes.

    The first score is by Zipf's law from the rank; the scores of all sum to 1.
    """
    inner = [p for p in pieces if p and not any(SPACE[b] or 65 <= b <= 90 for b in p[1:]) and (p[0] == 0x20 or not (SPACE[p[0]] or 65 <= p[0] <= 90))]
    known = set(inner)
    inner += [bytes([b]) for b in range(256) if bytes([b]) not in known and (b == 0x20 or not SPACE[b])]
    total = sum(1 / (r + 10) for r in range(len(inner)))
    return [(p, 1 / (r + 10) / total) for r, p in enumerate(inner)]


@dataclass
class Lattice:
    """Pieces with log probabilities, ready to find all of them in a stretch of bytes."""

    pieces: list[bytes]
    logp: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        lengths = np.array([len(p) for p in self.pieces])
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join(self.pieces[i] for i in own), np.uint8)
            h = _hash_runs(data, np.arange(len(own)) * n, n)
            order = np.argsort(h)
            bits = np.zeros(1 << 20, bool)
            bits[(h & _U((1 << 20) - 1)).astype(np.int64)] = True
            self.by_length[n] = (h[order], own[order], bits)

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of each occurrence of a piece that doesn't pass the end of its word; ends: by byte."""
        at = np.arange(len(data))
        sources, targets, pieces = [], [], []
        sums = _sums(data)
        for n, (known, ids, bits) in self.by_length.items():
            start = at = at[at + n <= ends[at]]  # lengths ascend
            h = mix((sums[start + n] - sums[start]) * _power(_INVERSE, len(data) + 1)[start])
            keep = bits[(h & _U((1 << 20) - 1)).astype(np.int64)]
            start, h = start[keep], h[keep]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            sources.append(start[hit])
            targets.append(start[hit] + n)
            pieces.append(ids[place[hit]])
        return np.concatenate(sources), np.concatenate(targets), np.concatenate(pieces)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=out[1:])
    return out


def _hash_runs(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    sums = _sums(data)
    return mix((sums[starts + n] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def _marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each after its mark, and where each begins (with the end)."""
    raw, offs = buffer_of(words)
    starts = offs + np.arange(len(offs))
    data = np.full(starts[-1], 0x20, np.uint8)
    inside = np.ones(starts[-1], bool)
    inside[starts[:-1]] = False
    data[inside] = raw
    return data, starts


def _pass(order_by: np.ndarray, step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges by step and then by node: (edges, where each node's begin) for each step."""
    order = np.lexsort((order_by, step))
    cuts = np.flatnonzero(np.diff(step[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield own, np.flatnonzero(np.r_[True, np.diff(order_by[own]) > 0])


def forward(lattice: Lattice, words: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The log probability of each word over all segmentations; with weights also the expected counts of the pieces."""
    data, starts = _marked(words)
    n_words = len(starts) - 1
    if not n_words:
        return np.zeros(0), None if weights is None else np.zeros(len(lattice.pieces))
    owner = np.repeat(np.arange(n_words), np.diff(starts))
    src, dst, piece = lattice.edges(data, starts[1:][owner])
    word = owner[src]
    # node: a place before a byte of a word, or its end; a word of n bytes has n + 1
    node_src, node_dst = src + word, dst + word
    first, last = starts[:-1] + np.arange(n_words), starts[1:] + np.arange(n_words)
    logp = lattice.logp[piece]
    alpha = np.full(starts[-1] + n_words, -np.inf)
    alpha[first] = 0
    for own, begin in _pass(node_dst, dst - starts[word]):
        alpha[node_dst[own[begin]]] = np.logaddexp.reduceat(alpha[node_src[own]] + logp[own], begin)
    total = alpha[last]
    if weights is None:
        return total, None
    beta = np.full(len(alpha), -np.inf)
    beta[last] = 0
    for own, begin in _pass(node_src, starts[word + 1] - src):
        beta[node_src[own[begin]]] = np.logaddexp.reduceat(beta[node_dst[own]] + logp[own], begin)
    with np.errstate(invalid="ignore"):
        share = np.exp(alpha[node_src] + logp + beta[node_dst] - total[word])
    return total, np.bincount(piece, np.nan_to_num(share) * weights[word], len(lattice.pieces))


def reestimated(lattice: Lattice, expected: np.ndarray) -> Lattice:
    """The lattice with the expected counts as scores; single bytes keep a little, so that every text has a path."""
    counts = expected + np.array([1e-2 if len(p) == 1 else 0.0 for p in lattice.pieces])
    keep = np.flatnonzero(counts > 1e-9)
    return Lattice([lattice.pieces[i] for i in keep], np.log(counts[keep] / counts[keep].sum()))


# --------------------------------------------------------------- over a corpus

_COUNTS = pa.schema([("hash", pa.int64()), ("word", pa.binary()), ("count", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, word, count) of the words of a task; only learning rows count, but the words of all rows come."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        hashes, index, inverse = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([c for _, c, _ in held])).astype(np.int64)
        return hashes, counts, pa.concat_arrays([w for _, _, w in held]).take(pa.array(index))

    def out(part: tuple[np.ndarray, np.ndarray, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), part[2], pa.array(part[1])], schema=_COUNTS)

    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(batch.column(batch.schema.get_field_index("text")), SPACE)
            if not len(words):
                continue
            learn = batch.column(batch.schema.get_field_index("learn")).to_numpy(zero_copy_only=False).astype(bool)
            hashes, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            counts = np.bincount(inverse, learn[words.documents()]).astype(np.int64)
            a, n = words.starts[index], words.ends[index] - words.starts[index]
            offs = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offs[1:])
            data = words.data[np.repeat(a - offs[:-1], n) + np.arange(offs[-1])]
            held.append((hashes, counts, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(data)])))
            size += len(n)
            if size >= HELD_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size >= HELD_WORDS // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(merged())


def _batches_of(words: pa.Array) -> Iterator[slice]:
    _, offs = buffer_of(words)
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + LATTICE_BYTES, "right")) - 1)
        yield slice(start, min(stop, len(words)))
        start = min(stop, len(words))


def _expect(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            words, counts = batch.column(0), batch.column(1).to_numpy()
            for s in _batches_of(words):
                total += forward(lattice, words[s], (counts[s] > 0).astype(float))[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "expected"])

    return run


@dataclass
class Corpus:
    """Counts of the training tokens: of all, of different ones, of ends (one a document)."""

    tokens: int
    distinct: int
    ends: int

    @property
    def freed(self) -> float:
        """Share of the mass that paths of pieces and unseen ends have."""
        return (DISCOUNT * self.distinct + 1) / (self.tokens + 1)

    def log10_word(self, counts: np.ndarray, lattice_ln: np.ndarray) -> np.ndarray:
        unit = np.maximum(counts - DISCOUNT, 0) / (self.tokens + 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(unit), math.log(self.freed * (1 - END_SHARE)) + lattice_ln) / _LN10

    def log10_end(self) -> float:
        return math.log10(max(self.ends - DISCOUNT, 0) / (self.tokens + 1) + self.freed * END_SHARE)

    def log10_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


def _score_words(shared: Broadcast, corpus: Corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for batch in batches:
            words, counts = batch.column(1), batch.column(2).to_numpy()
            ln = np.concatenate([forward(lattice, words[s])[0] for s in _batches_of(words)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(corpus.log10_word(counts, ln))], names=["hash", "count", "score"])

    return run


@dataclass
class _Frequent:
    hashes: np.ndarray
    counts: np.ndarray
    scores: np.ndarray


_PARTS = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("held_out", pa.bool_()), ("hash", pa.int64()), ("times", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _score_documents(shared: Broadcast, corpus: Corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document with what its frequent words give, and one for each of its other words (doc null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                at = batch.schema.get_field_index
                words = Words(batch.column(at("text")), SPACE)
                n = batch.num_rows
                hashes, doc = words.hashes(), words.documents()
                place = np.minimum(np.searchsorted(known.hashes, hashes), max(len(known.hashes) - 1, 0))
                often = known.hashes[place] == hashes if len(known.hashes) else np.zeros(len(hashes), bool)
                counts, scores = known.counts[place[often]], known.scores[place[often]]
                total = lambda values: np.bincount(doc[often], values, n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), batch.column(at("doc")), pa.array(~batch.column(at("learn")).to_numpy(zero_copy_only=False).astype(bool)), pa.nulls(n, pa.int64()),
                    pa.array(np.diff(words.first).astype(np.int64)), pa.array(total(counts > 0).astype(np.int64)), pa.array(total(corpus.log10_base(counts))), pa.array(total(scores)),
                ], schema=_PARTS)
                rare, owner = hashes[~often], doc[~often]
                if len(rare):
                    order = np.lexsort((rare, owner))
                    rare, owner = rare[order], owner[order]
                    begin = np.flatnonzero(np.r_[True, (np.diff(owner) > 0) | (rare[1:] != rare[:-1])])
                    m = len(begin)
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row + owner[begin]), none, pa.nulls(m, pa.bool_()), pa.array(rare[begin].view(np.int64)), pa.array(np.diff(np.r_[begin, len(rare)]).astype(np.int64)),
                        none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
                    ], schema=_PARTS)
                row += n

    return run


def score_documents(docs: DataFrame, learn: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Learns from the rows that `learn` says and scores every whole text.

    Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end.  Returns
    the id column, held_out (not learnt from), n_tokens, n_known, train_tokens,
    base_score (add-one word unigrams) and score: log10 of the text's marginal
    probability.  `vocabulary` is the path of a `.tiktoken` file.

    All words of all rows are counted; each different word's lattice is worked
    through once; counts and scores of the FREQUENT most frequent words are
    broadcast and the others joined, so the vocabulary may be of any size.  A
    null or empty text is its end alone.  With nothing to learn from, pieces
    alone score, by their ranks.  Repeated rows and null ids stay as they are;
    extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counted = rows.select("text", "learn").mapInArrow(_count, "hash long, word binary, count long")
    words = spill(counted.groupBy("hash", "word").agg(F.sum("count").alias("count")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    ends = rows.agg(F.count_if("learn")).first()[0]
    corpus = Corpus(tokens + ends, distinct + (ends > 0), ends)

    start = usable_pieces(vocabulary_pieces(vocabulary))
    lattice = Lattice([p for p, _ in start], np.log([x for _, x in start]))
    if distinct:
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(lattice)
            expected = words.where("count > 0").select("word", "count").mapInArrow(_expect(shared), "piece int, expected double")
            # one row a piece of the vocabulary
            sums = expected.groupBy("piece").agg(F.sum("expected").alias("expected")).toPandas()
            whole = np.zeros(len(lattice.pieces))
            whole[sums["piece"].to_numpy()] = sums["expected"].to_numpy()
            lattice = reestimated(lattice, whole)
    shared = spark.sparkContext.broadcast(lattice)
    scored = spill(words.mapInArrow(_score_words(shared, corpus), "hash long, count long, score double"), "word-scores")

    # the least count that no more than FREQUENT words reach, from counts by powers of 2 and then by count
    by_size = {r.size: r.n for r in scored.groupBy(F.floor(F.log2(F.col("count") + 1)).alias("size")).agg(F.count("*").alias("n")).collect()}
    room, least = FREQUENT, 0
    for size in sorted(by_size, reverse=True):
        if by_size[size] > room:
            least = 2 ** (size + 1) - 1
            break
        room -= by_size[size]
    often = scored.where(F.col("count") >= least).toPandas()
    order = np.argsort(often["hash"].to_numpy(np.int64).view(_U))
    frequent = _Frequent(often["hash"].to_numpy(np.int64).view(_U)[order], often["count"].to_numpy(np.int64)[order], often["score"].to_numpy(float)[order])
    parts = rows.mapInArrow(_score_documents(spark.sparkContext.broadcast(frequent), corpus), "row long, doc long, held_out boolean, hash long, times long, known long, base double, score double")
    parts = spill(parts, "document-scores")

    base = F.log10((F.col("count") + 1) / F.lit(float(corpus.tokens + corpus.distinct + 1)))
    rest = parts.where("hash is not null").select("row", "hash", "times").join(scored, "hash").select(
        "row", F.when(F.col("count") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * base).alias("base"), (F.col("times") * F.col("score")).alias("score")
    )
    rest = rest.groupBy("row").agg(F.sum("known").alias("rest_known"), F.sum("base").alias("rest_base"), F.sum("score").alias("rest_score"))
    end_base = float(corpus.log10_base(np.array([corpus.ends]))[0])
    zero = F.lit(0.0)
    return parts.where("hash is null").join(rest, "row", "left").select(
        F.col("doc").alias(id_col), "held_out", (F.col("times") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + int(corpus.ends > 0)).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero) + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", zero) + corpus.log10_end()).alias("score"),
    )
