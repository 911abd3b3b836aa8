"""Alignment of two tokenizers, and how many documents link each pair of their tokens.

Byte offsets at which tokens of both end cut the tokens of a text into groups;
a token of A is linked with each token of B in its group.

1. Texts are encoded once; the ids are written, in two or four bytes each.
2. Every task aligns its documents and gives, for each pair of ids, how many of
   them link it.  The distinct pairs are dealt to shards, and each shard gets a
   minimal perfect hash of its pairs.  Counts become dense vectors indexed by the
   hash, which are summed as a tree, shard by shard.
3. The documents are aligned again and look their pairs up.  Stored keys verify
   each lookup.

Bounds: a shard has about ``SHARD`` pairs.  At most ``RESIDENT`` pairs (24 bytes
each) are sent to all tasks; if there are more pairs, these are the most
frequent, and the links of the others meet their counts by a join.  The highest
count of each id of A goes to all tasks too; it is bounded by the vocabulary.
Distinct pairs are at most as many as the product of the vocabularies, and
partial counts leave a task whenever ``FLUSH`` pairs are gathered.  Groups that
never end (in broken texts) are expanded by ``BLOCK`` links at a time.

Edge cases: texts that are null or empty, or whose tokens of A or B don't join to
a space and the text, have no tokens, zeros and the empty string; a text's
repeats, also under one id, are documents of their own; an empty table gives an
empty result; other columns stay, and a kept column with a result's name is an
error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SLICE, map_rows, small_batches, written
from .mphf import CountTable, PerfectHash, shard_of

SHARD = 1 << 18
RESIDENT = 1 << 20
FLUSH = 1 << 20
BLOCK = 1 << 22
#: Partial counts that one task turns into a vector, and vectors that it adds.
PARTIALS, FAN = 1 << 21, 16
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
#: Runs of white space of this length overflow tiktoken's pattern.
LONG_SPACE = re.compile(r"\s{1000}")


def byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file; texts get a space before them.

    tiktoken encodes where the file is a plain one, with ids in order of the
    merges (it gives the same ids several times as fast); else the tokenizers
    library does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        order = [ids.get(m, -1) for m in merged]
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = (
            spec["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split["add_prefix_space"]
            and not (model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout"))
            and order == sorted(order)
            and len(ids) == 256 + len(set(order))
        )
        self.quick = None
        if plain:
            import public_tokenizers
            import tiktoken

            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        text = " " + text
        if self.quick is None or LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


class Pieces:
    """A sentencepiece file, which adds a space before texts itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {i: self._bytes(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())}

    @staticmethod
    def _bytes(piece: str) -> bytes:
        one = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, text: str, keep: list[str], files: tuple[str, str]) -> DataFrame:
    """Columns ``keep`` and the binaries ``a_`` and ``b_``: ids as little-endian numbers of four bytes (two, if all fit)."""

    def make():
        a, b = ByteLevel(files[0]), Pieces(files[1])
        kinds = [np.dtype("<u2" if max(x.bytes) < 1 << 16 else "<u4") for x in (a, b)]

        def work(texts):
            for raw in texts:
                whole = b" " + (raw or b"")
                ids = [], []
                if raw:
                    t = raw.decode("utf-8", "replace")
                    ids = a.encode(t), b.encode(t)
                    if any(b"".join(map(x.bytes.get, i, [b""] * len(i))) != whole for x, i in zip((a, b), ids)):
                        ids = [], []
                yield tuple(np.array(i, k).tobytes() for i, k in zip(ids, kinds))

        return work

    return map_rows(docs, [text], "a_ binary, b_ binary", make, keep)


class Aligned:
    """Groups and links of a few documents, one after another."""

    def __init__(self, a: list[bytes], b: list[bytes], kinds: tuple[str, str], lengths: tuple[np.ndarray, np.ndarray]):
        self.a, self.b = (np.frombuffer(b"".join(x), k).astype(np.int64) for x, k in zip((a, b), kinds))
        self.n_a, self.n_b = (np.array([len(x) // np.dtype(k).itemsize for x in side], np.int64) for side, k in zip((a, b), kinds))
        ends_a, ends_b = np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        cut_a, cut_b = at_b[ends_a], at_a[ends_b]
        self.last_a, self.last_b = cut_a, cut_b
        self.group_a, self.group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        self.groups = int(cut_a.sum())
        self.size_a, self.size_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        self.doc_a = np.repeat(np.arange(len(a)), self.n_a)
        self.n_groups = np.bincount(self.doc_a[cut_a], minlength=len(a))
        self.links = self.size_b[self.group_a]  # of each token of A
        self.n_links = np.bincount(self.doc_a, weights=self.links, minlength=len(a)).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document number, pair of ids and number of links, each document's pairs once."""
        starts = np.cumsum(self.size_b) - self.size_b
        sums, keys, times, low = np.cumsum(self.links), [], [], 0
        while low < len(self.a):
            before = int(sums[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(sums, before + BLOCK, "right")))
            reps = self.links[low:high]
            inner = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            b = self.b[np.repeat(starts[self.group_a[low:high]], reps) + inner]
            key = np.repeat((self.doc_a[low:high] << 2 * ID_BITS) | (self.a[low:high] << ID_BITS), reps) | b
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n)
            low = high
        if len(keys) > 1:
            key, n = summed(np.concatenate(keys), np.concatenate(times))
        elif keys:
            key, n = keys[0], times[0]
        else:
            key = n = np.zeros(0, np.int64)
        return key >> 2 * ID_BITS, key & ((1 << 2 * ID_BITS) - 1), n

    def told(self, words_a: list[bytes], words_b: list[bytes]) -> Iterator[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2``; ``words``: an id with ``,`` at twice its number, its group's last after it."""
        order_a = np.arange(len(self.a)) + (np.cumsum(self.size_b) - self.size_b)[self.group_a]
        order_b = np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]
        merged = np.empty(len(self.a) + len(self.b), np.int64)
        merged[order_a] = 2 * self.a + self.last_a
        merged[order_b] = 2 * self.b + self.last_b + len(words_a)
        words, merged = words_a + words_b, merged.tolist()
        at = 0
        for n in (self.n_a + self.n_b).tolist():
            yield b"".join([words[k] for k in merged[at : at + n]])[:-1]
            at += n


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Vocabularies:
    """What alignment needs of both files; made once in each task."""

    def __init__(self, files: tuple[str, str]):
        sides = ByteLevel(files[0]).bytes, Pieces(files[1]).bytes
        if max(map(max, sides)) > ID_MASK:
            raise ValueError("ids of more than 24 bits")
        self.kinds = tuple("<u2" if max(s) < 1 << 16 else "<u4" for s in sides)
        self.lengths = tuple(np.array([len(s.get(i, b"")) for i in range(max(s) + 1)], np.int64) for s in sides)
        self.words = tuple([b"%d%c" % (i, c) for i in range(len(n)) for c in (b",", e)] for n, e in zip(self.lengths, (b"|", b";")))

    def align(self, a: list[bytes], b: list[bytes]) -> Aligned:
        return Aligned(a, b, self.kinds, self.lengths)


def partial_counts(ids: DataFrame, files: tuple[str, str]) -> DataFrame:
    """``pair, n, part``: documents that link a pair, as far as one task counted them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        both, keys, counts, flushed = Vocabularies(files), [], [], 0

        def rows(k, n):
            for low in range(0, len(k), 1 << 16):
                part = np.full(len(k[low : low + (1 << 16)]), task + 1_000_003 * flushed, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[low : low + (1 << 16)]), pa.array(n[low : low + (1 << 16)]), pa.array(part)], names=["pair", "n", "part"])

        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                _, pair, _ = both.align(batch.column(0).to_pylist(), batch.column(1).to_pylist()).pairs()
                key, n = np.unique(pair, return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 2 * FLUSH:
                    key, n = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [key], [n]
                    if len(key) > FLUSH:
                        yield from rows(key, n)
                        keys, counts, flushed = [], [], flushed + 1
        if keys:
            yield from rows(*summed(np.concatenate(keys), np.concatenate(counts)))

    return small_batches(ids).select("a_", "b_").mapInArrow(run, "pair long, n long, part long")


def hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """``shard, function, keys``: the perfect hash of each shard of distinct pairs, and its keys by index."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["pair"].to_numpy(np.int64)
        function = PerfectHash.build(own)
        ordered = np.empty(len(own), "<i8")
        ordered[function.index(own)] = own
        return pd.DataFrame({"shard": [key[0]], "function": [function.to_bytes()], "keys": [ordered.tobytes()]})

    return with_shard(pairs, shards).groupBy("shard").applyInPandas(build, "shard long, function binary, keys binary")


def with_shard(pairs: DataFrame, shards: int) -> DataFrame:
    schema = StructType([*pairs.schema.fields, StructField("shard", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = shard_of(b.column(b.schema.get_field_index("pair")).to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    return pairs.mapInArrow(run, schema)


def summed_vectors(partials: DataFrame, tables: DataFrame, shards: int, n_partials: int, least: int = PARTIALS) -> DataFrame:
    """``shard, counts``: each shard's counts by index, from dense vectors that are added as a tree."""
    fan = max(1, -(-n_partials // (shards * least)))
    schema = "shard long, salt long, counts binary"

    def dense(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if table.empty or rows.empty:
            return pd.DataFrame({"shard": [], "salt": [], "counts": []})
        function = PerfectHash.from_bytes(table["function"][0])
        keys, own = np.frombuffer(table["keys"][0], "<i8"), rows["pair"].to_numpy(np.int64)
        at = function.index(own)
        if not (keys[at] == own).all():
            raise ValueError("a pair isn't the one stored under its hash")
        counts = np.zeros(function.size, "<i8")
        np.add.at(counts, at, rows["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "salt": [key[1]], "counts": [counts.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in rows["counts"])
        return pd.DataFrame({"shard": [key[0]], "salt": [key[1]], "counts": [total.astype("<i8").tobytes()]})

    dealt = with_shard(partials, shards).withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(fan)))
    copies = tables.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))))
    vectors = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(dense, schema)
    while fan > 1:
        fan = -(-fan // FAN)
        vectors = vectors.withColumn("salt", F.floor(F.col("salt") / FAN)).groupBy("shard", "salt").applyInPandas(add, schema)
    return vectors.select("shard", "counts")


def counted_pairs(tables: DataFrame) -> DataFrame:
    """``pair, n`` of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (keys, counts)], names=["pair", "n"])

    return tables.select("keys", "counts").mapInArrow(run, "pair long, n long")


def count_tables(ids: DataFrame, files: tuple[str, str], shard: int = SHARD, least: int = PARTIALS) -> tuple[DataFrame, int]:
    """``shard, function, keys, counts`` over all documents (written), and the number of pairs."""
    partials = written(partial_counts(ids, files), "partials")
    pairs = written(partials.select("pair").distinct(), "pairs")
    n_pairs, n_partials = pairs.count(), partials.count()
    shards = max(1, -(-n_pairs // shard))
    tables = written(hashes(pairs, shards), "hashes")
    return written(tables.join(summed_vectors(partials, tables, shards, n_partials, least), "shard"), "tables"), n_pairs


def highest(counted: DataFrame, size: int) -> np.ndarray:
    """The highest count of each id of A; as long as its vocabulary."""
    out = np.zeros(size, np.int64)
    for a, n in counted.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n")).collect():  # a row per id of A
        out[a] = n
    return out


def resident_tables(spark: SparkSession, tables: DataFrame, n_pairs: int, most: int, shard: int) -> tuple[list, int, DataFrame | None]:
    """The tables that go to all tasks, the number of their shards, and the pairs that aren't among them (None: all are)."""
    rest = None
    if n_pairs > most:
        counted = counted_pairs(tables)
        band = F.floor(8 * F.log2("n"))
        sizes = counted.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()  # eight for each power of two
        cut, own = 1 << 62, 0
        for b, n in sizes:
            if own + n > most:
                break
            cut, own = b, own + n
        rest = counted.filter(band < cut)
        shards = max(1, -(-own // shard))
        some = written(counted.filter(band >= cut), "resident")
        functions = written(hashes(some.select("pair"), shards), "hashes")
        tables = functions.join(summed_vectors(some.withColumn("part", F.lit(0).cast("long")), functions, shards, own), "shard")
    rows = tables.select("shard", "function", "keys", "counts").collect()  # at most ``most`` pairs
    return [tuple(r) for r in rows], max(1, -(-min(n_pairs, own if rest is not None else n_pairs) // shard)), rest


def align(docs: DataFrame, text: str = "text", keep: list[str] | None = None, files: tuple[str, str] | None = None, resident: int = RESIDENT, shard: int = SHARD, least: int = PARTIALS) -> DataFrame:
    """Columns ``keep`` (all, if None) with ``COUNTED``.

    ``n_a``, ``n_b``: tokens; ``n_groups``; ``n_links``; ``n_best``: links whose
    pair has the highest count of its A id; ``count_sum``: the counts of all
    links; ``groups``: ids as ``a1,a2|b1;a3|b2``.
    """
    files = files or default_files()
    keep = docs.columns if keep is None else keep
    taken = {c.lower() for c in keep} & {*COUNTED, "a_", "b_", "_row", "_rest"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be replaced; rename them or leave them out of keep")
    spark = docs.sparkSession
    ids = written(encoded(docs, text, keep, files), "ids")
    tables, n_pairs = count_tables(ids, files, shard, least)
    size = len(Vocabularies(files).lengths[0])
    best = highest(counted_pairs(tables), size)
    rows, shards, rest = resident_tables(spark, tables, n_pairs, resident, shard)
    shared = spark.sparkContext.broadcast((rows, shards, best))
    rare = "array<struct<pair:long,times:long>>"
    out = f"n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, _rest {rare}"
    counts = map_slices(ids, out, partial(looked_up, shared, files, rest is not None))
    if rest is None:
        return counts.drop("_rest")
    counts = written(counts.withColumn("_row", F.monotonically_increasing_id()), "counts")
    links = counts.select("_row", F.inline("_rest"))
    peak = spark.createDataFrame([(i, n) for i, n in enumerate(best.tolist())], "a long, peak long")  # as long as the vocabulary
    valued = rest.join(F.broadcast(peak), F.shiftright("pair", ID_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("peak")).cast("long").alias("is_best"))
    more = links.join(valued, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("is_best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    whole = counts.join(more, "_row", "left")
    plus = {"n_best": "_best", "count_sum": "_sum"}
    return whole.select(*[F.col(f"`{c}`") for c in keep], *[(F.col(c) + F.coalesce(plus[c], F.lit(0))).alias(c) if c in plus else F.col(c) for c in COUNTED])


def looked_up(shared, files: tuple[str, str], with_rest: bool) -> Callable:
    """Made once in a task: ids of a few documents to their columns."""
    rows, shards, best = shared.value
    both, tables = Vocabularies(files), {r[0]: CountTable(*r[1:]) for r in rows}

    def find(pairs: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(pairs), np.int64), shard_of(pairs, shards)
        for s, table in tables.items():
            own = np.flatnonzero(shard == s)
            out[own] = table.find(pairs[own])
        return out

    def work(a: list[bytes], b: list[bytes]) -> list:
        own = both.align(a, b)
        doc, pair, times = own.pairs()
        pairs, back = np.unique(pair, return_inverse=True)
        n = find(pairs)[back]
        known = n > 0
        if not with_rest and not known.all():
            raise ValueError("a linked pair has no count")
        is_best = known & (n == best[pair >> ID_BITS])
        sums = [np.zeros(len(a), np.int64) for _ in range(2)]
        np.add.at(sums[0], doc, np.where(is_best, times, 0))
        np.add.at(sums[1], doc, n * times)
        rest: list[list] = [[] for _ in a]
        for d, p, t in zip(doc[~known].tolist(), pair[~known].tolist(), times[~known].tolist()):
            rest[d].append({"pair": p, "times": t})
        return [own.n_a, own.n_b, own.n_groups, own.n_links, *sums, list(own.told(*both.words)), rest]

    return work


def map_slices(ids: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """``ids`` without ``a_`` and ``b_``, with the columns that ``make()`` finds for a few rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    added = ids.sparkSession.createDataFrame([], schema).schema
    keep = [c for c in ids.columns if c not in ("a_", "b_")]
    columns, new_names, kinds = ids.columns, added.names, [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                table = dict(zip(columns, batch.columns, strict=True))
                new = work(table["a_"].to_pylist(), table["b_"].to_pylist())
                yield pa.RecordBatch.from_arrays([*[table[c] for c in keep], *[pa.array(x, k) for x, k in zip(new, kinds)]], names=[*keep, *new_names])

    return small_batches(ids).mapInArrow(run, StructType([*[ids.schema[c] for c in keep], *added.fields]))
