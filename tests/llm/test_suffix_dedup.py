"""The induced suffix sort and the dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probeline.llm import queries, suffix_dedup


def plain_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=200), st.sampled_from([8, 1 << 20]), st.sampled_from([3, 4096]))
def test_suffix_array(symbols, limit, most_symbols):
    text = [*symbols, 0]
    assert suffix_dedup.suffix_array(np.array(text), limit, most_symbols).tolist() == plain_order(text)


@pytest.mark.parametrize("text", ["mississippi" * 20, "a" * 300, "ab" * 200, "abcabcab" * 30 + "z", "".join(random.Random(3).choices("ab", k=3000))])
def test_suffix_array_of_repeats(text):
    symbols = [*text.encode(), 0]
    assert suffix_dedup.suffix_array(np.array(symbols), 64).tolist() == plain_order(symbols)


def test_first_owners():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(5, 60))) for _ in range(60)] + [b"", b"\0" * 20, b"\0" * 9]
    owners = np.array([rng.randrange(20) for _ in strings])
    least = {}
    for s, o in zip(strings, owners.tolist(), strict=True):
        for i in range(len(s) - 8):
            least[s[i : i + 9]] = min(o, least.get(s[i : i + 9], o))
    want = [[least[s[i : i + 9]] for i in range(len(s) - 8)] for s in strings]
    data, offs = np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum([len(s) for s in strings])]
    assert suffix_dedup.first_owners(data, offs, owners, 9).tolist() == sum(want, [])
    got = [[] for _ in strings]
    for s, start, n, owner in zip(*(x.tolist() for x in suffix_dedup.owner_runs(data, offs, owners, 9)), strict=True):
        assert start == len(got[s])
        got[s] += [owner] * n
    assert got == want


def plain(docs, length=50):
    first = {}
    for doc, text in docs:
        raw = (text or "").encode()
        at = -(2**63) if doc is None else doc
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(at, first.get(w, at))
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (-(2**63) if doc is None else doc):
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_documents_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op4_suffix_dedup(spark, small).collect()), key=str)
    assert got == plain(docs) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_small_alphabet(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    rng = random.Random(9)
    base = "".join(rng.choices("ab é", k=600))
    docs = [(i, "".join(rng.choices("ab", k=rng.randrange(0, 40))) + base[(a := rng.randrange(500)) : a + rng.randrange(0, 120)] + "c" * rng.randrange(0, 70)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(suffix_dedup.remove_repeats(df)) == plain(docs)
    assert result(suffix_dedup.remove_repeats(df, 20)) == plain(docs, 20)


def test_odd_rows(spark, odd, odd_rows, empty):
    assert result(suffix_dedup.remove_repeats(odd)) == plain([(r[0], r[1]) for r in odd_rows])
    assert suffix_dedup.remove_repeats(empty).count() == 0
