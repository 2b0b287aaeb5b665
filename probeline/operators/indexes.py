"""Index structures over a sorted array of keys, with vectorised lower bounds.

Every index answers the same question for a block of probes: at which position
the first key that isn't smaller stands (the number of keys, if none).
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np


class Index(Protocol):
    name: str
    keys: np.ndarray

    def lower_bound(self, probes: np.ndarray) -> np.ndarray: ...

    @property
    def nbytes(self) -> int: ...


# ------------------------------------------------------------ search in bounds


def bounded_search(keys: np.ndarray, probes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The lower bound of each probe within its own [lo, hi), all probes a step at a time."""
    lo, hi = lo.copy(), hi.copy()
    if not len(keys):
        return lo
    for _ in range(int(max((hi - lo).max(initial=0), 1)).bit_length()):
        mid = (lo + hi) >> 1
        open_ = lo < hi
        less = open_ & (keys[np.minimum(mid, len(keys) - 1)] < probes)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def linear_search(keys: np.ndarray, probes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The same by counting smaller keys, one place of the window after the other."""
    out = lo.copy()
    for step in range(int((hi - lo).max(initial=0))):
        at = lo + step
        out += (at < hi) & (keys[np.minimum(at, len(keys) - 1)] < probes)
    return out


def galloping_search(keys: np.ndarray, probes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The same by doubling steps from lo, then halving."""
    if not len(keys):
        return lo.copy()
    step, begin, open_ = 1, lo.copy(), np.ones(len(lo), bool)
    end = hi.copy()
    while open_.any() and step <= 2 * len(keys):
        at = lo + step - 1
        inside = open_ & (at < hi)
        less = inside & (keys[np.minimum(at, len(keys) - 1)] < probes)
        begin = np.where(less, at + 1, begin)
        end = np.where(inside & ~less, at, end)
        open_ = less
        step *= 2
    return bounded_search(keys, probes, begin, np.maximum(begin, end))


def hinted_search(keys: np.ndarray, probes: np.ndarray, lo: np.ndarray, hi: np.ndarray, hint: np.ndarray | None = None) -> np.ndarray:
    """The same by doubling steps from a hint (without one, the middle), to the side where the bound lies, then halving."""
    if not len(keys):
        return lo.copy()
    last = np.maximum(hi - 1, lo)
    at = np.clip((lo + hi) >> 1 if hint is None else hint, lo, last)
    open_ = lo < hi
    up = open_ & (keys[np.minimum(at, len(keys) - 1)] < probes)
    begin, end = np.where(up, at + 1, lo), np.where(up | ~open_, hi, at)
    step, moving = 1, open_.copy()
    while moving.any() and step <= 2 * len(keys):
        next_ = np.where(up, at + step, at - step)
        inside = moving & (next_ >= lo) & (next_ < hi)
        less = keys[np.clip(next_, 0, len(keys) - 1)] < probes
        begin = np.where(inside & less, np.maximum(begin, next_ + 1), begin)
        end = np.where(inside & ~less, np.minimum(end, next_), end)
        moving = inside & (less == up)
        step *= 2
    return bounded_search(keys, probes, begin, np.maximum(begin, end))


SEARCHES = {"binary": bounded_search, "linear": linear_search, "galloping": galloping_search, "hinted": hinted_search}


# ---------------------------------------------------------------------- indexes


class BinarySearch:
    """No structure at all; the whole array is searched."""

    name = "binary_search"

    def __init__(self, keys: np.ndarray, search: str | None = None):
        self.keys, self.search = keys, search

    def lower_bound(self, probes: np.ndarray) -> np.ndarray:
        if self.search in (None, "binary"):
            return np.searchsorted(self.keys, probes, "left")
        return SEARCHES[self.search](self.keys, probes, np.zeros(len(probes), np.int64), np.full(len(probes), len(self.keys), np.int64))

    @property
    def nbytes(self) -> int:
        return 0


class _Levels:
    """A static search tree as one array a level: entry i of a level is the largest key of child i below."""

    fanout: int
    search: str

    def __init__(self, keys: np.ndarray, search: str | None = None):
        self.keys = keys
        self.search = search or self.search
        self.levels: list[np.ndarray] = []
        below = keys
        while len(below) > self.fanout:
            ends = np.minimum(np.arange(self.fanout, len(below) + self.fanout, self.fanout), len(below)) - 1
            below = below[ends]
            self.levels.insert(0, below)

    def lower_bound(self, probes: np.ndarray) -> np.ndarray:
        find = SEARCHES[self.search]
        node = np.zeros(len(probes), np.int64)
        for level in [*self.levels, self.keys]:
            lo = np.minimum(node * self.fanout, len(level))
            node = find(level, probes, lo, np.minimum(lo + self.fanout, len(level)))
        return node

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)


# Bytes of a page, of its header and of a key; keys of a small node.
PAGE_BYTES, HEADER_BYTES, KEY_BYTES = 4096, 128, 8
NODE_KEYS = 32


class BTree(_Levels):
    """Full pages; leaves are slices of the key column."""

    name, fanout, search = "btree", (PAGE_BYTES - HEADER_BYTES) // KEY_BYTES, "binary"


class Harmonia(_Levels):
    """Breadth-first levels of small nodes, searched one key after the other; any number of keys."""

    name, fanout, search = "harmonia", NODE_KEYS, "linear"


class RadixSpline:
    """A learned index: a radix table finds a spline segment, which says the position up to an error."""

    name = "radix_spline"

    def __init__(self, keys: np.ndarray, search: str | None = None, error: int = 16, radix_bits: int = 12):
        self.keys, self.error, self.search = keys, error, search or "binary"
        self.knots, self.places = self._fit(*np.unique(keys, return_index=True), error)
        span = int(self.knots[-1] - self.knots[0]) if len(self.knots) else 0
        self.shift = max(0, span.bit_length() - radix_bits)
        cells = (span >> self.shift) + 2 if len(self.knots) else 1
        prefixes = (self.knots - (self.knots[0] if len(self.knots) else 0)) >> self.shift
        self.table = np.searchsorted(prefixes, np.arange(cells + 1), "left")

    @staticmethod
    def _fit(xs: np.ndarray, ys: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy spline corridor: the fewest knots among the points such that interpolation misses by `error` at most."""
        if len(xs) < 2:
            return xs.copy(), ys.copy()
        knots, n = [0], len(xs)
        while knots[-1] < n - 1:
            base, i = knots[-1], knots[-1] + 1
            top, bottom, step = math.inf, -math.inf, 64
            while i < n:  # a block of points at a time, each twice as long, until one leaves the corridor
                dx, dy = (xs[i : i + step] - xs[base]).astype(float), (ys[i : i + step] - ys[base]).astype(float)
                tops = np.minimum.accumulate(np.r_[top, (dy + error) / dx])
                bottoms = np.maximum.accumulate(np.r_[bottom, (dy - error) / dx])
                out = np.flatnonzero((dy / dx > tops[:-1]) | (dy / dx < bottoms[:-1]))
                if len(out):
                    i += int(out[0])
                    break
                top, bottom, i, step = tops[-1], bottoms[-1], i + len(dx), min(2 * step, 1 << 16)
            knots.append(i - 1)
        return xs[knots], ys[knots]

    def lower_bound(self, probes: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        if not n:
            return np.zeros(len(probes), np.int64)
        inner = np.clip(probes, self.knots[0], self.knots[-1])
        cell = (inner - self.knots[0]) >> self.shift
        right = bounded_search(self.knots, inner, self.table[cell], np.minimum(self.table[cell + 1] + 1, len(self.knots)))
        right = np.clip(right, 1, max(len(self.knots) - 1, 1)) if len(self.knots) > 1 else np.zeros(len(probes), np.int64)
        left = np.maximum(right - 1, 0)
        run = np.maximum(self.knots[right] - self.knots[left], 1).astype(float)
        guess = self.places[left] + (inner - self.knots[left]) / run * (self.places[right] - self.places[left])
        lo = np.clip(np.floor(guess).astype(np.int64) - self.error - 1, 0, n)
        hi = np.clip(np.ceil(guess).astype(np.int64) + self.error + 2, 0, n)
        if self.search == "hinted":
            found = hinted_search(self.keys, probes, lo, hi, np.rint(guess).astype(np.int64))
        else:
            found = SEARCHES[self.search](self.keys, probes, lo, hi)
        # a probe between keys, or equal keys in a long run, may lie outside the window: these are searched whole
        wrong = ((found > 0) & (self.keys[np.maximum(found - 1, 0)] >= probes)) | ((found < n) & (self.keys[np.minimum(found, n - 1)] < probes))
        if wrong.any():
            found[wrong] = np.searchsorted(self.keys, probes[wrong], "left")
        return found

    @property
    def nbytes(self) -> int:
        return self.knots.nbytes + self.places.nbytes + self.table.nbytes


class NoOp:
    """Finds nothing: what a query costs without its lookups."""

    name = "no_op"

    def __init__(self, keys: np.ndarray, search: str | None = None):
        self.keys, self.search = keys, search

    def lower_bound(self, probes: np.ndarray) -> np.ndarray:
        return np.full(len(probes), len(self.keys), np.int64)

    @property
    def nbytes(self) -> int:
        return 0


INDEXES: dict[str, type] = {x.name: x for x in (BTree, Harmonia, BinarySearch, RadixSpline, NoOp)}
#: What a miss gives by default: the next larger key's position, or nothing.
DEFAULT_SEMANTICS = {"btree": "exact", "harmonia": "exact", "binary_search": "ceiling", "radix_spline": "ceiling", "no_op": "exact"}


def build_index(name: str, keys: np.ndarray, search: str | None = None) -> Index:
    """keys: a sorted array of whole numbers in [0, 2 ** 63); search: one of SEARCHES within nodes and windows, else the index's own."""
    if name not in INDEXES:
        raise ValueError(f"index {name!r} is unknown; there are {', '.join(INDEXES)}")
    if search is not None and search not in SEARCHES:
        raise ValueError(f"search {search!r} is unknown; there are {', '.join(SEARCHES)}")
    if len(keys) and keys[0] < 0:
        raise ValueError("keys must not be negative")
    return INDEXES[name](keys, search)


def find(index: Index, probes: np.ndarray, semantics: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, found) of a block of probes."""
    at = index.lower_bound(probes)
    found = at < len(index.keys)
    if semantics == "exact":
        found &= index.keys[np.minimum(at, max(len(index.keys) - 1, 0))] == probes if len(index.keys) else False
    elif semantics != "ceiling":
        raise ValueError(f"semantics {semantics!r} is neither exact nor ceiling")
    return at, found
