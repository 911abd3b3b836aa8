"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one Spark partition, bounded in words.  Its
words become symbols: words of the test items keep a symbol of their own, all
others can be part of no test phrase and act as a break.  The shard's suffix
array gives its Burrows-Wheeler transform, kept in a wavelet matrix; all test
phrases run the backward search at once, word by word through its ranks, and
the occurrences are located by walking to the next sampled suffix position.
Occurrences are merged into removal spans of whole words.

The test set is the stated query set: it is read in blocks of bounded size, each
broadcast by itself, so that the driver and a task hold one block in memory at a
time however many there are; the others lie on the executors' disks.  The
documents are read once, without a shuffle or a copy: a shard meets all blocks
before the next shard is read.  Everything a shard needs is rebuilt from its
documents if an executor is lost.

Edge cases: null and empty texts have no words and no hits; an item without
words never occurs; items of fewer words than the window are one phrase;
every row of the test set is an item of its own, also if its item_id is repeated
or null (it counts among the items found, as a null id); repeated documents are searched one by one; an empty test set leaves
every document clean; further columns pass through.  Results do not depend on
the sizes of shards and blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import small_batches

#: Bytes to the lower-cased word character, or to a space: 0-9, a-z and all above 0x7F are words.
_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
    for b in range(256)
)
WINDOW = 10
#: Words in a shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Test items in a block, and their words at most (an item is never cut).
BLOCK_WORDS = 500_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Phrases:
    """The distinct windows of a block of test items, as symbol rows by length."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        where: dict[tuple[int, ...], list[int]] = {}
        self.items: list[str | None] = []
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text)]
            if not ids:
                continue
            k = len(self.items)
            self.items.append(item)
            for i in range(max(1, len(ids) - window + 1)):
                of = where.setdefault(tuple(ids[i : i + window]), [])
                if not of or of[-1] != k:
                    of.append(k)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.shortest = min(map(len, where), default=0)
        for n in sorted({len(p) for p in where}):
            rows = [p for p in where if len(p) == n]
            owners = [where[p] for p in rows]
            self.by_length.append(
                (
                    np.array(rows, np.int32),
                    np.cumsum([0, *map(len, owners)]),
                    np.array([k for o in owners for k in o], np.int64),
                )
            )


class WaveletMatrix:
    """Ranks of symbols over a sequence, one bit vector for each bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(self.n - int(bit.sum()))
            order = np.argsort(bit, kind="stable")
            values = values[order]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(i), i
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1
            a, b = self._ones(level, start), self._ones(level, end)
            start = np.where(one == 1, self.zeros[level] + a, start - a)
            end = np.where(one == 1, self.zeros[level] + b, end - b)
        return end - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only ties are sorted again.

    Symbol 0 is a break: breaks differ from each other and order by position,
    so no comparison runs over one.
    """
    n = len(symbols)
    breaks = symbols == 0
    first = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    head = np.concatenate([[True], sorted_first[1:] != sorted_first[:-1]]) if n else np.zeros(0, bool)
    # the rank of a suffix is the place where its class begins
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else 0
    width = 1
    while True:
        single = head & np.concatenate([head[1:], [True]])
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        members = order[tied]
        follow = members + width
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        group = rank[members]
        again = np.lexsort((second, group))
        order[tied] = members[again]
        g, s = group[again], second[again]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        head[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        width *= 2


class FmIndex:
    """Backward search and locate over one shard's symbols (last one a break)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        self.n = len(symbols)
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        bits = max(1, int(n_symbols).bit_length())
        self.tree = WaveletMatrix(bwt, bits)
        self.bwt = bwt
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        # sampled: every sample-th text position, and those after a break, where walking ends
        keep = (order % sample == 0) | (bwt == 0)
        self.known = np.cumsum(keep) - 1
        self.is_known, self.positions = keep, order[keep]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases of one length."""
        last = phrases[:, -1]
        lo, hi = self.first[last].copy(), self.first[last + 1].copy()
        live = np.flatnonzero(lo < hi)
        for k in range(phrases.shape[1] - 2, -1, -1):
            if not len(live):
                break
            s = phrases[live, k].astype(np.int64)
            lo[live] = self.first[s] + self.tree.rank(s, lo[live])
            hi[live] = self.first[s] + self.tree.rank(s, hi[live])
            live = live[lo[live] < hi[live]]
        hi[hi < lo] = lo[hi < lo]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.is_known[rows])
        while len(walking):
            at = rows[walking]
            s = self.bwt[at]
            rows[walking] = self.first[s] + self.tree.rank(s, at)
            steps[walking] += 1
            walking = walking[~self.is_known[rows[walking]]]
        return self.positions[self.known[rows]] + steps


def occurrences(symbols: np.ndarray, phrases: Phrases) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, phrase rows, phrase length) of all occurrences in a shard.

    Runs between breaks that are shorter than the shortest phrase can hold none
    and are left out before the index is built.
    """
    if not phrases.by_length or not len(symbols):
        return []
    breaks = np.flatnonzero(symbols == 0)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(symbols)]])
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    sizes = ends - starts + 1  # with a break behind each run
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    text = np.where(source == np.repeat(ends, sizes), 0, symbols[np.minimum(source, len(symbols) - 1)])
    index = FmIndex(text, len(phrases.symbol))
    found = []
    for rows, _, _ in phrases.by_length:
        lo, hi = index.search(rows)
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        found.append((source[index.locate(at)], which, rows.shape[1]))
    return found


def scan_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str | None]]]:
    """For each document (as words): merged hit spans of words, and the ids of the items, one for each item."""
    get = phrases.symbol.get
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])  # a break behind each document
    symbols = np.zeros(offsets[-1], np.int64)
    for t, o in zip(texts, offsets.tolist(), strict=False):
        symbols[o : o + len(t)] = [get(w, 0) for w in t]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str | None]] = [[] for _ in texts]
    found = occurrences(symbols, phrases)
    if found:
        cover = np.zeros(len(symbols) + 1, np.int64)
        pairs = []
        for (at, which, n), (_, bounds, owners) in zip(found, phrases.by_length, strict=True):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            doc = np.searchsorted(offsets, at, side="right") - 1
            count = bounds[which + 1] - bounds[which]
            k = np.repeat(bounds[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            pairs.append(np.stack([np.repeat(doc, count), owners[k]]))
        hit = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])
        edge = np.diff(hit)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            d = int(np.searchsorted(offsets, a, side="right")) - 1
            spans[d].append((a - int(offsets[d]), b - int(offsets[d])))
        for d, k in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            items[d].append(phrases.items[k])
    return list(zip(spans, items, strict=True))


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """Test items in blocks of at most ``block_words`` words each."""
    block, held = [], 0
    rows = items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`"))
    for item, t in rows.toLocalIterator():
        t = None if t is None else t.encode()
        n = len(words(t))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((item, t))
        held += n
    if block:
        yield block


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = StructType(
    [StructField("n_words", LongType()), StructField("spans", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(StringType()))]
)


_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _keep(batch: pa.RecordBatch, found: list[dict], at: int) -> pa.RecordBatch:
    """The struct ``row`` of a batch with what was found."""
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=_FOUND_ARROW)], names=["row", "found"])


def _cut(batch: pa.RecordBatch, found: list[dict], at: int) -> pa.RecordBatch:
    """The rows of a batch without their spans in text column ``at``; what has no word left goes."""
    row = batch.column(0)
    columns = [row.field(i) for i in range(row.type.num_fields)]
    hit = [sum(b - a for a, b in f["spans"]) for f in found]
    if any(hit):
        texts = columns[at].to_pylist()
        for i, f in enumerate(found):
            if 0 < hit[i] < f["n_words"]:
                texts[i] = cut(texts[i], f["spans"])
        columns[at] = pa.array(texts, type=columns[at].type)
    out = pa.RecordBatch.from_arrays(columns, names=[f.name for f in row.type])
    return out.filter(pa.array([n == 0 or n < f["n_words"] for n, f in zip(hit, found, strict=True)], pa.bool_()))


def _opened(blocks: list[Broadcast]) -> Iterator[Phrases]:
    """The phrases of one block after another; of several, each is forgotten before the next is read from disk."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1 and vars(block).get("_path"):
            vars(block).pop("_value", None)


def _search(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, shard_words: int, block_words: int, give: Callable, schema: StructType) -> DataFrame:
    """Search each shard of ``docs`` for all blocks of items; ``give`` makes the result."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    blocks = [spark.sparkContext.broadcast(Phrases(b, window)) for b in item_blocks(items, item_id, item_text, block_words)]

    def finish(held: list[tuple[pa.RecordBatch, list[list[bytes]]]]) -> Iterator[pa.RecordBatch]:
        texts = [t for _, of in held for t in of]
        found: list[dict] = [{"n_words": len(t), "spans": [], "items": []} for t in texts]
        for phrases in _opened(blocks):
            for f, (spans, ids) in zip(found, scan_shard(texts, phrases), strict=True):
                f["spans"] = merge_spans([*f["spans"], *spans]) if f["spans"] else spans
                f["items"] += ids
        results = iter(found)
        for batch, of in held:
            yield give(batch, [next(results) for _ in of], at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start, texts = 0, []
            for i, t in enumerate(batch.column(0).field(at).cast(pa.binary())):
                t = words(t.as_py())
                if size and size + len(t) > shard_words:
                    yield from finish([*held, (batch.slice(start, i - start), texts)])
                    held, size, start, texts = [], 0, i, []
                texts.append(t)
                size += len(t)
            held.append((batch.slice(start), texts))
        yield from finish(held)

    return small_batches(docs).select(F.struct("*").alias("row")).mapInArrow(run, schema)


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Two structs for every document: ``row``, its columns, and ``found``.

    ``found`` has ``n_words``; ``spans``, the merged removal spans as word
    numbers [start, end); ``items``, the ids of the items that occur, one for
    each item.
    """
    schema = docs.select(F.struct("*").alias("row"), F.lit(None).cast(_FOUND).alias("found")).schema
    return _search(docs, items, text, item_id, item_text, window, shard_words, block_words, _keep, schema)


def n_hit(found: str = "found"):
    """Column: how many words the removal spans cover."""
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("bigint"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words, each replaced by a line break."""
    raw = text.encode()
    bounds = [m.span() for m in _WORD.finditer(raw)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : bounds[a][0]])
        at = bounds[b - 1][1]
    parts.append(raw[at:])
    return b"\n".join(parts).decode()


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the removal spans; what has no word left goes.

    Documents without a hit are returned as they are, blank ones too.
    """
    return _search(docs, items, text, item_id, item_text, window, shard_words, block_words, _cut, docs.schema)
