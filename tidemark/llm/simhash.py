"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint of its 4-word shingles.  Two fingerprints
within the radius r collide in at least one of 2**(r+1) - 1 tables: each bit
position i is given a vector m(i) of r+1 bits, and table v (a non-zero vector)
keeps the bits with an odd product of m(i) and v.  The positions where two
fingerprints differ span at most r dimensions, so some v is orthogonal to all
of them and its table sees equal masked bits.

Only distinct fingerprints are hashed, so copies of a text never meet in pairs.
Buckets return a spanning forest of their links, never all pairs.  A bucket
over ``split_over`` members is divided again, without loss: members agree on
the masked bits, and of r+1 blocks of the free bits one must agree as well.

Joins on fingerprints, components and hubs of the graph go through
``join_hot``, so that a group with a third of all rows stays spread.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any other; fewer than four words form one shingle; repeated rows share
their fingerprint; rows of one id with different texts are linked by their
texts only; rows without an id don't count for the least id; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_rows, written

SEED = 42
BITS = 64


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set.

    Vertical counters: full adders turn three words of one weight into a word
    of that weight and one of the next, until one word of each weight is left.
    """
    total, weight, level = np.zeros(BITS, np.int64), 1, hashes
    while len(level):
        carries = []
        while len(level) > 2:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, level[3 * k :]])
        for word in level:
            total += weight * np.unpackbits(np.frombuffer(word.tobytes(), np.uint8), bitorder="little").astype(np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return total


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """Unsigned fingerprint; a bit is set if over half of the shingles set it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    over = bit_counts(np.array(hashes, np.uint64)) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the fingerprint as a signed long in ``fp``."""

    def make():
        def work(texts):
            for t in texts:
                f = fingerprint(t)
                yield (f - (1 << BITS) if f >> (BITS - 1) else f,)

        return work

    return map_rows(df, [text], "fp long", make, keep=keep)


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The bit masks of the covering tables; all vectors m(i) are used evenly."""
    kinds = (1 << (radius + 1)) - 1
    # a fixed shuffle of the vectors, so that neighbouring bits differ
    vectors = [1 + (i * 11 + 5) % kinds for i in range(bits)]
    tables = []
    for v in range(1, kinds + 1):
        mask = 0
        for i, m in enumerate(vectors):
            mask |= (bin(m & v).count("1") & 1) << i
        tables.append(mask)
    return tables


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between distinct fingerprints.

    The nearest unvisited members of each visited one join its tree; a member
    is compared with the unvisited ones only.
    """
    left, right = [], []
    rest = values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    if not left:
        return values[:0], values[:0]
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int = 4, split_over: int = 20_000, fp: str = "fp") -> DataFrame:
    """Edges (a, b) whose components are those of all links within ``radius``.

    ``fps`` has distinct fingerprints in a signed column.
    """
    tables = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in masks(radius)])
    keyed = fps.select(F.col(fp).alias("fp"), F.posexplode(tables).alias("t", "mask"))
    keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    buckets = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
    large = buckets.filter(F.col("n") > split_over).select("mask", "key")
    schema = "a long, b long"

    def in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may span batches."""
        held: list[np.ndarray] = []

        def edges(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(block[0]) != 0) | (np.diff(block[1]) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [block.shape[1]]])
            sizes = np.diff(bounds)
            a, b = [], []
            two = bounds[:-1][sizes == 2]
            if len(two):
                x, y = block[2][two], block[2][two + 1]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
                a.append(x[near])
                b.append(y[near])
            for i in np.flatnonzero(sizes > 2):
                p, q = forest(block[2][bounds[i] : bounds[i + 1]].view(np.uint64), radius)
                a.append(p.view(np.int64))
                b.append(q.view(np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            block = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if held:
                block = np.concatenate([*held, block], axis=1)
            last = (block[0] == block[0][-1]) & (block[1] == block[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield from edges(np.ascontiguousarray(block[:, :cut]))
            held = [np.ascontiguousarray(block[:, cut:])]
        if held:
            yield from edges(held[0])

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp").mapInArrow(in_partition, schema)

    # Buckets over the limit: r+1 blocks of the free bits; one of them must agree.
    large = written(large, "large-buckets")
    if large.isEmpty():
        found = by_bucket(keyed)
    else:
        deep = keyed.join(large, ["mask", "key"], "left_semi")
        found = by_bucket(keyed.join(large, ["mask", "key"], "left_anti"))
        width = BITS
        while width:
            blocks = radius + 1

            def parts(frame: pd.DataFrame) -> pd.DataFrame:
                out = []
                for mask, group in frame.groupby("mask", sort=False):
                    m = int(mask) & ((1 << BITS) - 1)
                    free = [i for i in range(BITS) if not m >> i & 1]
                    for k in range(blocks):
                        more = m | sum(1 << i for i in free[k::blocks])
                        g = group[["fp"]].copy()
                        g["mask"] = np.uint64(more).astype(np.int64)
                        out.append(g)
                return pd.concat(out) if out else frame[["fp", "mask"]]

            deeper = deep.select("fp", "mask").mapInPandas(
                lambda frames, parts=parts: (parts(f) for f in frames), "fp long, mask long"
            )
            deeper = written(
                deeper.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct(), "split-buckets"
            )
            over = written(
                deeper.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_over).select("mask", "key"),
                "large-buckets",
            )
            if over.isEmpty():
                found = found.unionByName(by_bucket(deeper))
                break
            found = found.unionByName(by_bucket(deeper.join(over, ["mask", "key"], "left_anti")))
            deep = deeper.join(over, ["mask", "key"], "left_semi")
            width -= 1
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node.

    Alternating large-star and small-star steps; each halves the height of the
    trees at least, and each round is written to the shared folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        total = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both, least, ["a"], "n", total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            join_hot(down, root, ["a"], "n", total)
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        small = written(small, "edges")
        # done when every edge points at a root: no node is both a child and a parent
        inner = small.select("b").distinct().join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        many = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        edges = small
        if inner.isEmpty() and many.isEmpty():
            break
    else:
        raise RuntimeError("the components have not settled")
    children = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return children.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, ``keep``, fp, root, component_id.

    ``root`` is the component's least fingerprint, ``component_id`` the least
    id of its rows (null if none has an id).
    """
    prints = written(fingerprints(df, [doc_id, *(keep or [])], text), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("_first"), F.count(F.lit(1)).alias("_n"))
    least = written(least, "distinct-fingerprints")
    roots = components(links(least.select("fp"), radius))
    # fingerprints alone in their component keep their own
    tagged = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    tagged = written(tagged.select("fp", "_first", "_n", F.coalesce("root", "fp").alias("root")), "tagged-fingerprints")
    ids = tagged.groupBy("root").agg(F.min("_first").alias("component_id"), F.count(F.lit(1)).alias("_prints"))
    named = join_hot(tagged.select("fp", "_n", "root"), ids, ["root"], "_prints", tagged.count())
    named = written(named, "named-fingerprints")
    return join_hot(prints, named, ["fp"], "_n", prints.count()).select(*[f"`{c}`" for c in (doc_id, *(keep or []))], "fp", "root", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each group, all its columns untouched.

    The row with the least id stays; of different texts with that id in one
    group the one with the least fingerprint and digest stays, and of rows
    that are equal in id and text one.  Two texts of one id that are in no
    common group both stay.  Rows with a null id are kept apart and all stay.
    """
    digest = F.coalesce(F.sha2(F.col(f"`{text}`").cast("binary"), 256), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("_id"), digest.alias("_digest"))
    ids = rows.filter("_id is not null").select("_id", "_digest", F.col(f"row.`{text}`").alias("text"))
    grouped = groups(ids, "_id", radius=radius, keep=["_digest"])
    same = grouped.groupBy("root", "_id", "fp", "_digest").agg(F.count(F.lit(1)).alias("_n"))
    first = same.groupBy("root").agg(F.min(F.struct("_id", "fp", "_digest", "_n")).alias("k"))
    first = written(first.select("k._id", "k._digest", "k._n"), "first-of-groups")
    stay = join_hot(rows, first, ["_id", "_digest"], "_n", ids.count(), "left_semi")
    return stay.dropDuplicates(["_id", "_digest"]).select("row.*").unionByName(rows.filter("_id is null").select("row.*"))
