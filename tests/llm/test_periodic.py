"""Periodic runs against their definition, with edge cases, and the query against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.oracle import SF
from tidemark.llm import periodic, queries


def slow_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k - p] for k in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def check(w):
    assert periodic.find_runs(np.array(w, np.int64)) == slow_runs(w), w


def test_short_words_of_small_alphabets():
    r = random.Random(5)
    for _ in range(3000):
        check([r.randrange(r.choice((1, 2, 2, 3, 5))) for _ in range(r.randrange(60))])


def test_nested_and_touching_runs():
    r = random.Random(6)
    for _ in range(1500):
        w = [r.randrange(4) for _ in range(r.randrange(1, 5))]
        for _ in range(r.randrange(1, 5)):
            w = w * r.randrange(1, 6) + [r.randrange(4) for _ in range(r.randrange(3))]
            w = w[r.randrange(3) :][:220]
        check(w)
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    check(b)
    check(([0] * 12 + [1]) * 9 + [0] * 40 + [2] + list(range(9)) * 5)


def test_long_periodic_texts_are_quick():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    w = np.tile(np.arange(7_001), 20)
    assert periodic.find_runs(w) == [(0, len(w), 7_001)]
    w = np.tile(np.array([0] * 50 + [1]), 4_000)
    assert len(periodic.find_runs(w)) == 4_001
    w = np.random.default_rng(1).integers(0, 2, 200_000)
    assert all(length >= max(6, 4 * q) for _, length, q in periodic.find_runs(w))


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "one", "a " * 6, "a\x0bb\x0ca b\ra b\ta b\na b", "é É é É é É é É", "x " * 5, "go go go go go go"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts * 2)], "doc_id long, text string, start string")
    for r in periodic.find(docs).collect():
        words = (r.text or "").split() if r.doc_id % 9 != 5 else ["a", "b"] * 5
        runs = slow_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words) and r.start == "s"
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
    assert periodic.find(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(docs.withColumnRenamed("start", "Runs"))


def slow_planted(i, t):
    w = (t or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def quick_runs(w):
    """As ``slow_runs``, by whole diagonals."""
    x, out = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if w else np.zeros(0, int), []
    for q in range(1, len(x) // 4 + 1):
        same = np.flatnonzero(np.concatenate(([False], x[q:] == x[:-q], [False])) != np.concatenate(([False, False], x[q:] == x[:-q])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            start, length = a - 1, b - a + q
            if length >= max(6, 4 * q) and not any(q % p == 0 and (x[start + p : start + length] == x[start : start + length - p]).all() for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query(spark):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in queries.queries()["op13_periodic_runs"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        w = slow_planted(i, t)
        runs = quick_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join("%d,%d,%d\n" % x for x in runs).encode())
        assert r.collapsed_sha256 == digest(b" ".join(x for k, x in enumerate(w) if k not in gone))
    assert sum(r.n_runs > 0 for r in got.values()) >= 10
