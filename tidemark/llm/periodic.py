"""Runs: stretches of a text whose words repeat with a period.

A run is a stretch of words with smallest period q and at least max(6, 4 q)
words that no neighbouring word extends.  It lies on the diagonal of lag q of
the matrix of equal words: every word but its first q equals the word q before.

The words pass in order; the earlier occurrences of each increment the match
lengths of the active lags, and a lag that is not met again ends, emitting its
run at once if it was long enough.  Lags are taken by powers of two: lags from
l to 2 l - 1 are met by *grams* of the l words that end at a word rather than by
single words, because a run of such a lag repeats whole grams.  Thereby words
that are frequent without repeating in order open no diagonals.  Exact bounds
keep the diagonals sparse:

- a gram that occurs less than three times is in no run of its or a longer lag;
- a gram and its earlier occurrence that both lie within a run of a smaller
  period are apart by a multiple of that period, so they start no run;
- a diagonal needs so many words in a row that each have an earlier occurrence.

What is kept is bounded by the words of one text.  Nothing is shuffled.

Edge cases: a null, empty or blank text has no words and no runs; repeated rows
are searched one by one; an empty table gives an empty result; other columns
stay, and new columns whose name is taken are refused (see ``find``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def least_matches(lag: int) -> int:
    """Matches on the diagonal of a lag that make a run of max(6, 4 lag) words."""
    return max(6 - lag, 3 * lag)


def stretches(at: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive numbers in a sorted array, ``least`` of them or more."""
    if len(at) < least:
        return
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(at)]))
    for k in np.flatnonzero(ends - starts >= least):
        yield int(starts[k]), int(ends[k])


def diagonals(positions: list[int], earlier: Iterable[list[int]], gram: int) -> Iterator[tuple[int, int, int]]:
    """Runs of the diagonals met at consecutive positions: (start, length, period)."""
    active: dict[int, int] = {}

    def ended(lag: int, matches: int, last: int) -> Iterator[tuple[int, int, int]]:
        matches += gram - 1
        if matches >= least_matches(lag):
            yield last - matches - lag + 1, matches + lag, lag

    for i, before in zip(positions, earlier):
        met = {i - j: active.get(i - j, 0) + 1 for j in before}
        for lag, matches in active.items():
            if lag not in met:
                yield from ended(lag, matches, i - 1)
        active = met
    for lag, matches in active.items():
        yield from ended(lag, matches, positions[-1])


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of word numbers as (start, length, period), by start and period."""
    n, found, gram = len(words), [], 1
    at, ids = np.arange(n), words.astype(np.int64)
    reach = np.arange(n)  # where the run of a smaller period around a word starts, if there is one
    while 4 * gram <= n and len(at):
        order = np.argsort(ids, kind="stable")
        g, p = ids[order], at[order]
        new = np.concatenate(([True], g[1:] != g[:-1]))
        near = np.zeros(len(p), bool)
        near[1:] = ~new[1:] & (p[1:] - p[:-1] < 2 * gram)
        if near.any():
            key = np.cumsum(new) * (4 * n) + p
            some = np.flatnonzero(near)
            nearest = np.maximum(gram, p[some] - gram + 2 - reach[p[some]])
            low = np.searchsorted(key, key[some] - (2 * gram - 1), "left")
            high = np.searchsorted(key, key[some] - nearest, "right")
            met = high > low
            some, low, high = some[met], low[met], high[met]
            by_place = np.argsort(p[some])
            places, low, high = p[some][by_place], low[by_place], high[by_place]
            fresh = []
            for a, b in stretches(places, least_matches(gram) - gram + 1):
                earlier = (p[x:y].tolist() for x, y in zip(low[a:b].tolist(), high[a:b].tolist()))
                fresh += diagonals(places[a:b].tolist(), earlier, gram)
            for start, length, _ in fresh:
                inside = reach[start : start + length]
                np.minimum(inside, start, out=inside)
            found += fresh
        edges = np.append(np.flatnonzero(new), len(p))
        often = np.repeat(np.diff(edges) >= 3, np.diff(edges))
        kept = np.sort(order[often])
        at, ids = at[kept], ids[kept]
        here = np.full(n, -1, np.int64)
        here[at] = ids
        at = at[at >= gram]
        at = at[here[at - gram] >= 0]
        pairs = here[at - gram] * (int(ids.max()) + 1 if len(ids) else 1) + here[at]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        gram *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stays)]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``runs`` and ``collapsed``.

    Words are split at space and U+0009 to U+000D.  ``collapsed`` is the text
    without the repeats of its runs, words joined by a space; it is never null.
    A kept column of one of these names is an error.
    """
    kept = docs.columns if keep is None else keep
    taken = {c.lower() for c in kept} & {"n_words", "runs", "collapsed"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be replaced; rename them or leave them out of keep")

    def make():
        def work(texts):
            for t in texts:
                words = (t or b"").split()
                runs = find_runs(numbered(words))
                yield len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(without_repeats(words, runs))

        return work

    return map_rows(docs, [text], FIELDS, make, kept)
