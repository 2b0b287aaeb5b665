"""Indexes and searches against searchsorted."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probeline.operators import indexes

NAMES = [n for n in indexes.INDEXES if n != "no_op"]
KEYS = st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**62)), max_size=300)


@settings(max_examples=150, deadline=None)
@given(KEYS, st.lists(st.one_of(st.integers(0, 42), st.integers(0, 2**62)), min_size=1, max_size=60))
def test_lower_bounds(keys, probes):
    keys, probes = np.sort(np.array(keys, np.int64)), np.array(probes, np.int64)
    want = np.searchsorted(keys, probes, "left")
    for name in NAMES:
        assert indexes.build_index(name, keys).lower_bound(probes).tolist() == want.tolist(), name
    whole = np.zeros(len(probes), np.int64), np.full(len(probes), len(keys), np.int64)
    for name, search in indexes.SEARCHES.items():
        assert search(keys, probes, *whole).tolist() == want.tolist(), name


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("n", [0, 1, 7, 15, 144, 280, 2000])
def test_dense_keys_are_their_positions(name, n):
    index = indexes.build_index(name, np.arange(n))
    at, found = indexes.find(index, np.arange(n + 3), "exact")
    assert at[:n].tolist() == list(range(n)) and found.tolist() == [True] * n + [False] * 3


def test_textbook_array():
    keys, needles = np.array([1, 2, 4, 5, 5, 6, 8, 12, 20, 20, 21, 23]), np.arange(24)
    for name in NAMES:
        assert indexes.build_index(name, keys).lower_bound(needles).tolist() == np.searchsorted(keys, needles).tolist()


def test_spline_keeps_its_error():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**40, 20_000))
    spline = indexes.RadixSpline(keys, error=8)
    xs, ys = np.unique(keys, return_index=True)
    assert np.abs(np.interp(xs.astype(float), spline.knots.astype(float), spline.places) - ys).max() <= 8.01
    assert len(spline.knots) < len(keys) / 8


def test_semantics_and_errors():
    index = indexes.build_index("btree", np.array([0, 10, 20]))
    at, found = indexes.find(index, np.array([5, 20, 21]), "ceiling")
    assert at[:2].tolist() == [1, 2] and found.tolist() == [True, True, False]
    with pytest.raises(ValueError):
        indexes.build_index("hash", np.array([1]))
    with pytest.raises(ValueError):
        indexes.build_index("btree", np.array([-1]))
    with pytest.raises(ValueError):
        indexes.find(index, np.array([1]), "floor")
    assert not indexes.find(indexes.build_index("no_op", np.array([1])), np.array([1]), "exact")[1].any()


@pytest.mark.parametrize("search", [*indexes.SEARCHES])
@pytest.mark.parametrize("name", NAMES)
def test_every_search_in_every_index(name, search):
    rng = np.random.default_rng(4)
    for keys in (np.arange(3000) * 7, np.sort(rng.integers(0, 2**40, 3000)), np.sort(rng.integers(0, 50, 3000)), np.zeros(0, np.int64)):
        index = indexes.build_index(name, keys, search)
        probes = np.r_[rng.integers(0, 2**41, 300), rng.integers(0, 60, 300), keys[::50]]
        assert index.search == search and index.lower_bound(probes).tolist() == np.searchsorted(keys, probes).tolist()
    with pytest.raises(ValueError):
        indexes.build_index(name, np.array([1]), "nope")


def test_hinted_search_from_any_hint():
    keys = np.sort(np.random.default_rng(5).integers(0, 500, 400))
    probes = np.arange(-1, 502)
    lo, hi = np.zeros(len(probes), np.int64), np.full(len(probes), len(keys), np.int64)
    for hint in (0, 57, 399, 1000):
        assert indexes.hinted_search(keys, probes, lo, hi, np.full(len(probes), hint)).tolist() == np.searchsorted(keys, probes).tolist()
