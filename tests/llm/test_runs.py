import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import runs as R


def plain_runs(w, exponent=4, least=6):
    """By definition: stretches that keep period q and can't be extended, q the smallest."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = (None,) * 4
    if found:
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
        top = (s, m, q, 1000 * m // q)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found(texts, **more):
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    made = R.runs(np.array([x for t in texts for x in t], np.int64), bounds.astype(np.int64), **more)
    out = [[] for _ in texts]
    for d, s, m, q in zip(*(x.tolist() for x in made), strict=True):
        out[d].append((s, m, q))
    return [sorted(x) for x in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(2, 5))
def test_runs_equal_their_definition(texts, exponent):
    assert found(texts, exponent=exponent, least=2) == [plain_runs(t, exponent, 2) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)), min_size=1, max_size=5))
def test_planted_periods(parts):
    text = [x for root, times in parts for x in root * times]
    assert found([text, text[::-1]]) == [plain_runs(text), plain_runs(text[::-1])]


def test_suffix_and_lcp_arrays():
    rng = np.random.default_rng(2)
    for size in (1, 2, 50):
        s = np.append(rng.integers(1, 3, size), 0)
        made = R.Suffixes.of(s)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert made.rank[order].tolist() == list(range(len(s)))
        for r in range(1, len(s)):
            a, b = s[order[r - 1]:].tolist(), s[order[r]:].tolist()
            assert made.lcp[r] == next(k for k in range(len(a)) if k >= min(len(a), len(b)) or a[k] != b[k])


def test_next_smaller_values():
    rng = np.random.default_rng(3)
    for v in (rng.permutation(300), np.arange(300), np.arange(300)[::-1], np.append(-1, np.arange(300)[::-1]), np.zeros(0, int)):
        got = R.next_smaller(v)
        assert got.tolist() == [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]


def test_documents_equal_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(tuple(r) for r in R.periodic_runs(documents).collect())
    assert got == sorted(brute(i, t) for i, t in rows) and sum(r[1] > 0 for r in got) > 10


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sorted((tuple(r) for r in R.periodic_runs(awkward).collect()), key=str)
    assert [r for r in got if r[0] != 6] == sorted((brute(i, t) for i, t in rows if i != 6), key=str)
    long = R.periodic_runs(awkward.where("doc_id = 6"), planted=False).first()
    assert tuple(long)[1:6] == (1, 0, 60_000, 5003, 11_992)
    assert len(got) == len(rows) and R.periodic_runs(nothing).count() == 0


@pytest.mark.parametrize("period", [1, 3, 70_000])
def test_long_periodic_text(period):
    n = 300_000
    text = np.arange(n) % period
    assert found([text.tolist()]) == [[(0, n, period)]]
