"""Exact-substring dedup by suffix sorting, shard by shard, with external induced sorting.

A repeated string of `length` bytes has the same minimiser (the smallest hash of
its k-grams) wherever it occurs.  So texts are cut into runs of neighbouring
windows that share a minimiser, a run and all its copies go to one shard, and
no match is lost between shards.  Runs whose minimiser no other document has
can't repeat and never leave their document.  In a shard, the different runs
are suffix-sorted by induction: leftmost S-suffixes are sorted (recursively, if
their substrings repeat), L- and then S-suffixes follow from them through one
queue a first symbol, which holds suffix tuples and spills to disk.  Suffixes
that have `length` bytes in common with their neighbour form groups, and the
smallest document of a group is the first to have that string.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import release, small_batches, spill
from probeline.llm.wordcore import _BASE, _INVERSE, _power, buffer_of, mix, slices

#: Bytes of a k-gram; a window of `length` bytes has length - K + 1 of them.
K = 16
#: Bytes of queue entries that a sort holds in memory; more go to disk.
QUEUE_BYTES = 64 << 20
#: Bytes of text in one suffix sort, about; a shard is sorted in groups of whole minimisers.
SORT_BYTES = 1 << 20
#: A minimiser that more documents have is sorted by its different strings alone.
HOT_DOCS = 50_000
#: Rows that tell which texts are copies are broadcast up to so many.
BROADCAST_COPIES = 400_000

_U = np.uint64

# ------------------------------------------------------- external induced sort


class BucketQueues:
    """A priority queue of suffixes whose priority is their first symbol, as one queue a symbol.

    Entries come in blocks and leave in the order in which they came (or its
    reverse); blocks beyond the memory limit are kept in a temporary file of
    the task, which only this task reads.
    """

    def __init__(self, limit: int = QUEUE_BYTES):
        self.blocks: dict[int, list] = {}
        self.limit, self.held, self.file = limit, 0, None

    def push(self, symbols: np.ndarray, entries: np.ndarray) -> None:
        """Appends each entry to the queue of its symbol; the order within a symbol stays."""
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, entries = symbols[order], entries[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        starts = np.r_[0, cuts]
        for c, block in zip(symbols[starts].tolist(), np.split(entries, cuts), strict=True):
            self.held += block.nbytes
            if self.held > self.limit:
                self.file = self.file or tempfile.TemporaryFile()
                at = self.file.seek(0, 2)
                self.file.write(block.tobytes())
                self.blocks.setdefault(c, []).append((at, len(block)))
                self.held -= block.nbytes
            else:
                self.blocks.setdefault(c, []).append(block)

    def take(self, symbol: int) -> np.ndarray:
        """All entries of a symbol that have come and not been taken."""
        out = []
        for block in self.blocks.pop(symbol, ()):
            if isinstance(block, tuple):
                self.file.seek(block[0])
                block = np.frombuffer(self.file.read(8 * block[1]), np.int64)
            else:
                self.held -= block.nbytes
            out.append(block)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def symbols(self) -> list[int]:
        return sorted(self.blocks)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last symbol is the only smallest one."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if n > 1:
        step = np.sign(text[1:].astype(np.int64) - text[:-1])
        # a run of equal symbols has the type of what follows it
        at = np.where(step != 0, np.arange(n - 1), n - 2)
        smaller[:-1] = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes in order, from the leftmost S ones in order: first L upwards, then S downwards."""
    symbols = np.unique(text)
    large: dict[int, np.ndarray] = {}
    up = BucketQueues(limit)
    seed_queues = BucketQueues(limit)
    seed_queues.push(text[seeds], seeds)
    for c in symbols.tolist():
        done = []
        now = up.take(c)
        while len(now):  # a predecessor with the same symbol joins the queue that is being read
            done.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            same = text[before] == c
            up.push(text[before[~same]], before[~same])
            now = before[same]
        large[c] = np.concatenate(done) if done else np.zeros(0, np.int64)
        star = seed_queues.take(c)
        before = star[star > 0] - 1
        before = before[~smaller[before]]
        up.push(text[before], before)
    up.close()
    seed_queues.close()
    small: dict[int, np.ndarray] = {}
    down = BucketQueues(limit)
    for c in symbols.tolist()[::-1]:
        done = []
        now = down.take(c)
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            same = text[before] == c
            down.push(text[before[~same]], before[~same])
            now = before[same]
        small[c] = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
        falling = large[c][::-1]
        before = falling[falling > 0] - 1
        before = before[smaller[before]]
        down.push(text[before], before)
        if c == symbols[0]:  # the end of the text is smaller than all and follows from nothing
            small[c] = np.r_[len(text) - 1, small[c][small[c] != len(text) - 1]]
    down.close()
    return np.concatenate([x for c in symbols.tolist() for x in (large[c], small[c])])


def _doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling: the base of the recursion, for few or all but different symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        changed = np.r_[0, np.diff(key[order]) > 0]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changed)
        step *= 2
    return order


def suffix_array(text: np.ndarray, limit: int = QUEUE_BYTES, most_symbols: int = 4096) -> np.ndarray:
    """The suffixes of a text (of whole numbers, whose last one is smaller than all others) in order."""
    text = text.astype(np.int64)
    n = len(text)
    if n < 64 or len(np.unique(text)) > most_symbols:
        return _doubling(text)
    smaller = _types(text)
    star = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(star) < 2:
        return _induce(text, smaller, star, limit)
    # a first induction from unsorted seeds sorts the substrings between leftmost S suffixes
    rough = _induce(text, smaller, star, limit)
    is_star = np.zeros(n, bool)
    is_star[star] = True
    stars = rough[is_star[rough]]
    ends = np.full(n, n, np.int64)
    ends[star[:-1]] = star[1:]
    ends[star[-1]] = n - 1
    names = np.cumsum(np.r_[0, _differ(text, stars, ends[stars] - stars + 1)])
    name = np.zeros(n, np.int64)
    name[stars] = names
    if names[-1] < len(stars) - 1:
        reduced = name[star]
        inner = suffix_array(np.r_[reduced + 1, 0], limit, most_symbols)[1:]
        stars = star[inner]
    return _induce(text, smaller, stars, limit)


def _differ(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each substring differs from the one before it."""
    out = lengths[1:] != lengths[:-1]
    open_ = np.flatnonzero(~out)
    step = 0
    while len(open_):
        open_ = open_[lengths[open_] > step]
        apart = text[starts[open_] + step] != text[starts[open_ + 1] + step]
        out[open_[apart]] = True
        open_ = open_[~apart]
        step += 1
    return out


def long_common(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at each place in order (but the first) are those at the place before; all lie within data."""
    words = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        words[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
    same = np.ones(max(len(order) - 1, 0), bool)
    open_ = np.arange(len(same))
    for step in [*range(0, length - 7, 8), *([max(length - 8, 0)] if length % 8 else [])]:
        alike = words[order[open_] + step] == words[order[open_ + 1] + step]
        same[open_[~alike]] = False
        open_ = open_[alike]
    return same


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] numbers, for each i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def first_owners(data: np.ndarray, offs: np.ndarray, owners: np.ndarray, length: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """For each whole place of each string (of a buffer), the smallest owner of the `length` (8 at least) bytes there, in any of the strings."""
    sizes = np.diff(offs)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    # bytes become 2 to 257; 1 parts the strings and 0 ends the text
    text = np.ones(starts[-1] + 1, np.int64)
    text[_spread(starts[:-1], sizes)] = data[offs[0] : offs[-1]].astype(np.int64) + 2
    text[-1] = 0
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(starts[-1]) + length < starts[1:][string]
    order = suffix_array(text, limit)
    order = order[order < starts[-1]]
    order = order[whole[order]]
    result = np.zeros(starts[-1], np.int64)
    if len(order):
        new = np.r_[True, ~long_common(np.maximum(text - 2, 0).astype(np.uint8), order, length)]
        least = np.minimum.reduceat(owners[string[order]], np.flatnonzero(new))
        result[order] = least[np.cumsum(new) - 1]
    return result[whole]


def owner_runs(data: np.ndarray, offs: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, first place, places, owner): runs of places of each string whose `length` bytes have one first owner among all strings.

    Only stretches whose windows may occur elsewhere, by a hash of each window, are sorted.
    """
    windows = np.maximum(np.diff(offs) - length + 1, 0)
    string = np.repeat(np.arange(len(windows)), windows)
    place = _spread(offs[:-1], windows)
    result = owners[string]
    hashes = _window_hashes(data, place, length)
    order = np.argsort(hashes)
    ranked = hashes[order]
    alike = np.zeros(len(order) + 1, bool)
    alike[1:-1] = ranked[1:] == ranked[:-1]
    often = np.zeros(len(order), bool)
    often[order] = alike[:-1] | alike[1:]
    at = np.flatnonzero(often)
    if len(at):
        begin = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(string[at]) > 0)])
        sizes = np.diff(np.r_[begin, len(at)]) + length - 1
        part = data[_spread(place[at[begin]], sizes)]
        result[at] = first_owners(part, np.r_[0, np.cumsum(sizes)], owners[string[at[begin]]], length)
    begin = np.flatnonzero(np.r_[True, (np.diff(string) > 0) | (np.diff(result) != 0)]) if len(string) else np.zeros(0, np.int64)
    return string[begin], place[begin] - offs[:-1][string[begin]], np.diff(np.r_[begin, len(string)]), result[begin]


# -------------------------------------------------------------------- minimisers


def _window_hashes(data: np.ndarray, places: np.ndarray | slice, length: int) -> np.ndarray:
    """A hash of the `length` bytes at each place, or at all places of a slice."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=sums[1:])
    ends = slice(places.start + length, places.stop + length) if isinstance(places, slice) else places + length
    return (sums[ends] - sums[places]) * _power(_INVERSE, len(data) + 1)[places]


#: Minimisers are told apart by 48 bits, which shuffle in less; two that have the same share a shard.
_SHORT = _U((1 << 48) - 1)


def runs(data: np.ndarray, offs: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, windows, minimiser) of each run of neighbouring windows with one minimiser, in each text of a buffer."""
    window = length - k + 1
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(_U)
    grams = mix(_window_hashes(data, slice(0, len(data) - k + 1), k))
    # the smallest of each `window` neighbours, by doubling
    least, width = grams, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: n], least[window - width :][:n])
    least = least[:n]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    place = np.arange(n)
    whole = place + length <= offs[text[:n] + 1]
    place = place[whole]
    least, owner = least[whole], text[place]
    new = np.ones(len(place), bool)
    new[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], place[at] - offs[owner[at]], np.diff(np.r_[at, len(place)]), least[at] & _SHORT


def _minimisers(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(m, doc) of each different minimiser of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                data, offs = buffer_of(batch.column(batch.schema.get_field_index("text")))
                text, _, _, least = runs(data, offs, length)
                docs = batch.column(batch.schema.get_field_index("doc")).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(docs[text])], names=["m", "doc"])

    return run


def _shared_minimisers(hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by minimiser: those of minimisers that several documents have, once a document; and one without document for each that over `hot` have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shown, count = None, False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m, doc = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                m, doc = np.r_[last[0], m], np.r_[last[1], doc]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
            m, doc = m[new], doc[new]
            alike = np.zeros(len(m) + 1, bool)
            alike[1:-1] = m[1:] == m[:-1]
            here = alike[:-1] | alike[1:]
            # how many documents each minimiser has up to here; the last one may go on
            begin = np.flatnonzero(~alike[:-1])
            counts = np.diff(np.r_[begin, len(m)])
            counts[0] += count - (last is not None) if last is not None else 0
            over = m[begin[:-1]][counts[:-1] > hot]
            count = int(counts[-1])
            if last is not None and shown:
                here[0] = False
            last, shown = (int(m[-1]), int(doc[-1])), bool(here[-1]) or (len(m) == 1 and shown)
            if here.any() or len(over):
                docs = pa.concat_arrays([pa.array(doc[here]), pa.nulls(len(over), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[m[here], over]), docs], names=["m", "doc"])
        if count > hot:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.nulls(1, pa.int64())], names=["m", "doc"])

    return run


_STRINGS = pa.schema([("m", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("string", pa.binary())])


def _list_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _strings(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs of each document whose minimisers are shared: where they begin and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                at = batch.schema.get_field_index
                data, offs = buffer_of(batch.column(at("text")))
                text, first, windows, least = runs(data, offs, length)
                shared, row = _list_of(batch.column(at("ms")))
                own = mix(shared.astype(np.int64).view(_U) + row.astype(_U) * _U(_BASE))
                wanted = np.isin(mix(least + text.astype(_U) * _U(_BASE)), own)
                text, first, windows, least = text[wanted], first[wanted], windows[wanted], least[wanted]
                docs, keys = batch.column(at("doc")).to_numpy(), batch.column(at("key")).to_numpy()
                sizes = windows + length - 1
                ends = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=ends[1:])
                taken = data[_spread(offs[text] + first, sizes)]
                strings = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(taken)])
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(docs[text]), pa.array(keys[text]), pa.array(first), strings], schema=_STRINGS)

    return run


class _Shard:
    """Rows of whole minimisers, in the order of minimiser, string and document; each different string is held once."""

    def __init__(self) -> None:
        self.bytes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.rows: list[tuple[np.ndarray, ...]] = []  # (string, doc, key, first), or (m, hash) of each string
        self.strings = self.size = 0

    def add(self, batch: pa.RecordBatch, last: tuple[int, int] | None, placed: bool) -> tuple[int, int]:
        """Adds rows after a row of minimiser and hash `last`; returns those of the last row."""
        m, h, doc = (batch.column(i).to_numpy() for i in (0, 1, 3))
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
        new[0] = not self.strings or (int(m[0]), int(h[0])) != last
        raw, offs = buffer_of(batch.column(2))
        sizes = np.diff(offs)
        if placed:
            self.rows.append((self.strings - 1 + np.cumsum(new), doc, batch.column(4).to_numpy(), batch.column(5).to_numpy()))
        else:
            self.rows.append((m[new], h[new]))
        self.bytes.append(raw[_spread(offs[:-1][new], sizes[new])])
        self.sizes.append(sizes[new])
        self.owners.append(doc[new])
        self.strings += int(new.sum())
        self.size += int(sizes[new].sum())
        return int(m[-1]), int(h[-1])

    def spans(self, length: int, placed: bool) -> pa.RecordBatch:
        """placed: (doc, key, start, stop) of what has a smaller first owner; else (m, hash, start, stop, owner), places of each string by first owner."""
        sizes = np.concatenate(self.sizes)
        string, start, places, owner = owner_runs(np.concatenate(self.bytes), np.r_[0, np.cumsum(sizes)], np.concatenate(self.owners), length)
        rows = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
        stop = start + places + length - 1
        if not placed:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0][string], rows[1][string], start, stop, owner)], names=["m", "hash", "start", "stop", "owner"])
        begin = np.searchsorted(string, np.arange(self.strings + 1))
        own, doc, key, first = rows
        run = _spread(begin[own], np.diff(begin)[own])
        row = np.repeat(np.arange(len(own)), np.diff(begin)[own])
        hit = owner[run] < doc[row]
        run, row = run[hit], row[hit]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], key[row], first[row] + start[run], first[row] + stop[run])], names=["doc", "key", "start", "stop"])


def _sort_shard(length: int, placed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The spans of rows (m, hash, string, doc, key, first) that are sorted by minimiser, hash and document.

    Whole minimisers gather up to SORT_BYTES of different strings and are sorted together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = _Shard(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0).to_numpy()
            # pieces of whole minimisers, but the first and the last, which go on before and behind
            cuts = np.flatnonzero(np.diff(m)) + 1
            _, offs = buffer_of(batch.column(2))
            a = 0
            if last is not None and shard.size > SORT_BYTES and int(m[0]) != last[0]:
                yield shard.spans(length, placed)
                shard = _Shard()
            while a < len(m):
                # up to the first cut behind what fills the shard
                full = int(np.searchsorted(offs, offs[a] + SORT_BYTES - shard.size, "left"))
                later = cuts[cuts >= max(full, a + 1)]
                b = int(later[0]) if len(later) else len(m)
                last = shard.add(batch.slice(a, b - a), last, placed)
                if b < len(m) and shard.size > SORT_BYTES:
                    yield shard.spans(length, placed)
                    shard = _Shard()
                a = b
        if shard.strings:
            yield shard.spans(length, placed)

    return run


def _key_of(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents without their spans: what stays, how many bytes went, in how many runs."""
    for batch in batches:
        at = batch.schema.get_field_index
        data, offs = buffer_of(batch.column(at("text")))
        spans = batch.column(at("spans")).to_pylist()
        kept, removed, counts = [], [], []
        for i, own in enumerate(spans):
            raw = data[offs[i] : offs[i + 1]].tobytes()
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in own or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            parts, done = [], 0
            for a, b in merged:
                parts.append(raw[done:a])
                done = b
            kept.append(b"".join([*parts, raw[done:]]))
            removed.append(sum(b - a for a, b in merged))
            counts.append(len(merged))
        yield pa.RecordBatch.from_arrays(
            [batch.column(at("doc")), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts out each byte that a string of `length` bytes covers which also starts in a document with a smaller id.

    Texts are UTF-8 bytes; matches never cross documents; overlaps count; all
    is judged on the input, not on what is left.  Returns the id column,
    n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the
    remaining bytes, which a cut may part within a character).

    A null text is empty; a text shorter than `length` stays.  A null id is
    before all others and its rows lose nothing; rows of one id don't count
    for each other; extra columns are ignored; an empty table gives no rows.
    """
    if length <= K:
        raise ValueError(f"strings have more than {K} bytes")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(_key_of(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("key"))
    # copies of a whole text lose all of it, and stand for nothing that the first one doesn't
    brief = spill(rows.select("doc", "key", F.crc32("text").alias("crc"), F.octet_length("text").cast("long").alias("size")), "texts")
    firsts = brief.groupBy("key", "crc", "size").agg(F.min("doc").alias("first_doc"))
    copies = brief.join(firsts, ["key", "crc", "size"]).where((F.col("doc") > F.col("first_doc")) & (F.col("size") >= length)).select("doc", "key", "size").distinct()
    copies = spill(copies, "copies")
    release(brief)
    taken = copies.select("doc", "key")
    originals = rows.join(F.broadcast(taken) if copies.count() <= BROADCAST_COPIES else taken, ["doc", "key"], "left_anti")
    # minimisers that several documents have
    grams = originals.select("doc", "text").mapInArrow(_minimisers(length), "m long, doc long").repartition("m").sortWithinPartitions("m", "doc")
    shared = spill(grams.mapInArrow(_shared_minimisers(HOT_DOCS), "m long, doc long"), "minimisers")
    hot = shared.where("doc is null").select("m")
    some_hot = hot.limit(1).count() > 0
    by_doc = shared.where("doc is not null").groupBy("doc").agg(F.collect_list("m").alias("ms"))  # as many as the document's own runs
    strings = originals.join(by_doc, "doc").select("doc", "text", "key", "ms").mapInArrow(_strings(length), "m long, doc long, key long, first long, string binary")
    strings = strings.withColumn("hash", F.xxhash64("string"))
    # a minimiser that very many documents have: only its different strings meet, and what is found goes back to where they are
    hot_spans = None
    if some_hot:
        strings = spill(strings, "strings")
        often = strings.join(hot, "m", "left_semi")
        different = often.groupBy("m", "hash").agg(F.any_value("string").alias("string"), F.min("doc").alias("doc"))
        different = different.repartition("m").sortWithinPartitions("m", "hash", "doc")
        owners = spill(different.mapInArrow(_sort_shard(length, placed=False), "m long, hash long, start long, stop long, owner long"), "owners")
        met = often.select("m", "hash", "doc", "key", "first").join(owners, ["m", "hash"]).where("owner < doc")
        hot_spans = met.select("doc", "key", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))
    thin = strings.join(hot, "m", "left_anti") if some_hot else strings
    ordered = thin.select("m", "hash", "string", "doc", "key", "first").repartition("m").sortWithinPartitions("m", "hash", "doc")
    spans = ordered.mapInArrow(_sort_shard(length, placed=True), "doc long, key long, start long, stop long")
    spans = spans.unionByName(copies.select("doc", "key", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop")))
    if some_hot:
        spans = spans.unionByName(hot_spans)
    gathered = spill(spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    release(copies, shared, *([strings, owners] if some_hot else []))
    out = rows.join(gathered, ["doc", "key"], "left").mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    null = F.lit(-(2**63)).cast("long")
    return out.select(F.when(F.col("doc") != null, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
