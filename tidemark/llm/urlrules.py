"""URL rules by a sort-merge range join over reversed hosts.

Host and rule keys are the host's labels in reverse, each closed by a dot, so
that a rule's host and all its subdomains are one interval of keys.  Addresses
and rule starts are sorted together; a sweep keeps the stack of rules whose
interval is still open, which are nested, and tries their paths on each
address.  The longest rule text that fits wins (of equal ones the first by
text, and block over allow); without one the default verdict holds.

The sort key goes on with path and id, so that one host's rows spread over many
partitions.  What is open where a partition begins comes from a first sweep
that returns only the open stack at each partition's end: at most the number of
labels in a host for each partition, whatever the data.

Edge cases: a null address or one without ``://`` has an empty host and path
and gets the default verdict; repeated rows are judged one by one; rules with
the same text are joined into one (block wins); no rules: all default.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reverse_key(host: Column) -> Column:
    """``a.example.com`` to ``com.example.a.``; the empty host to the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


class HostRules:
    """The rules of a host by path; a URL's path meets them by its prefixes of the lengths that occur."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()):
        self.by_path: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []
        for r in rules:
            self.add(*r)

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.by_path:
            at = bisect_left(self.lengths, len(path))
            if self.lengths[at : at + 1] != [len(path)]:
                self.lengths.insert(at, len(path))
        self.by_path[path] = rule, verdict

    def longest(self, path: str) -> tuple[str, str] | None:
        for k in range(bisect_right(self.lengths, len(path)) - 1, -1, -1):
            if found := self.by_path.get(path[: self.lengths[k]]):
                return found
        return None

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        return ((p, *r) for p, r in self.by_path.items())


class Sweep:
    """The stack of open rules along ascending keys."""

    def __init__(self, stack: Iterable[tuple[str, Iterable[tuple[str, str, str]]]] = ()):
        #: (host key, its rules), outermost first
        self.stack = [(k, HostRules(r)) for k, r in stack]

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, HostRules()))
        self.stack[-1][1].add(path, rule, verdict)

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        self.move(key)
        fits = [(-len(r[0]), r[0], r[1] != "block", r[1]) for _, rules in self.stack if (r := rules.longest(path))]
        if not fits:
            return None
        _, rule, _, verdict = min(fits)
        return rule, verdict


def judge(urls: DataFrame, rules: DataFrame, row_id: str, url: str, default: str = "allow") -> DataFrame:
    """row_id, host, path, rule and verdict for every row of ``urls``.

    ``rules`` has host, path and verdict (allow or block).
    """
    host, path = parts(F.col(f"`{url}`"))
    rows = urls.select(F.col(f"`{row_id}`").alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select(reverse_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "id", "host", F.lit(None).cast("string").alias("verdict"))
    starts = rules.groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    starts = starts.select(
        reverse_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "path", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "host", "verdict"
    )
    order = ["key", "kind", "path", "id"]
    sorted_rows = checkpointed(starts.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order))

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep, last = Sweep(), None
        for f in frames:
            if len(f):
                last = f["key"].iloc[-1]
            r = f[f["kind"] == 0]
            for key, path, host, verdict in zip(r["key"], r["path"], r["host"], r["verdict"], strict=True):
                sweep.open(key, path, host + path, verdict)
        if last is not None:
            sweep.move(last)
            n = TaskContext.get().partitionId()
            out = [(n, last, k, p, t, v) for k, rs in sweep.stack for p, t, v in rs] or [(n, last, None, None, None, None)]
            yield pd.DataFrame(out, columns=["n", "last", "key", "path", "rule", "verdict"])

    open_at_end = sorted_rows.select("key", "kind", "path", "host", "verdict").mapInPandas(
        ends, "n int, last string, key string, path string, rule string, verdict string"
    )
    carried: dict[int, list] = {}
    sweep, now = Sweep(), None
    for r in sorted(open_at_end.collect(), key=lambda r: (r["n"], r["key"] or "")):  # partitions x open rules
        if r["n"] != now:
            now = r["n"]
            carried[now] = [(k, list(x)) for k, x in sweep.stack]
            sweep.move(r["last"])
        if r["key"] is not None:
            sweep.open(r["key"], r["path"], r["rule"], r["verdict"])

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep(carried.get(TaskContext.get().partitionId(), ()))
        for f in frames:
            out = []
            for key, kind, path, host, verdict in zip(f["key"], f["kind"], f["path"], f["host"], f["verdict"], strict=True):
                if kind == 0:
                    sweep.open(key, path, host + path, verdict)
                    out.append((None, None))
                else:
                    out.append(sweep.find(key, path) or (None, default))
            f["rule"], f["verdict"] = [o[0] for o in out], [o[1] for o in out]
            yield f.loc[f["kind"] == 1, ["id", "host", "path", "rule", "verdict"]]

    id_type = rows.schema["id"].dataType.simpleString()
    done = sorted_rows.mapInPandas(judged, f"id {id_type}, host string, path string, rule string, verdict string")
    return done.withColumnRenamed("id", row_id)
