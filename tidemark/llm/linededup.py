"""Removal of lines that many documents share.

Lines are exploded, normalised and hashed; the documents of each hash are
counted, lines of frequent hashes are found by a join, and each text is put
together again from the positions that stay.  Only built-in functions run on
the executors.

A text's lines lie between line feeds; a line's key is the line without white
space at both ends and with A-Z lower-cased.  Keys are compared by 128 bits of
XXH64.  A document counts once for a key, however often it has it.

Edge cases: a null or empty text is one empty line, and a text that loses all
lines becomes the empty text; each row is a document of its own, also if it
repeats another or has a null id; an empty table gives an empty result; columns
of the input keep their names and values, and clashing helper names get a
trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spread, free_name, hex_digest, written

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent keys (16 bytes each) that are broadcast; of more, only the hottest are.
BROADCAST_KEYS = 1_000_000


def split_lines(text: Column) -> Column:
    """Array of lines; null and the empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    blank = F.substring(line, 1, 1).isin(*BLANK) | F.substring(line, -1, 1).isin(*BLANK)
    return F.when(blank, F.btrim(line, F.lit(BLANK))).otherwise(line)


def lowered(line: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """Array of the keys of all lines, each made once (a generator's column is made again for every use)."""
    return F.transform(F.transform(split_lines(text), stripped), lowered)


def two_hashes(*cols: Column) -> list[Column]:
    """128 bits as two longs, named ``h1`` and ``h2``."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes ``h1, h2`` of the keys in at least ``min_docs`` rows, with ``n_docs``.

    Repeats within a row are removed in the row, and counts are summed before
    the shuffle, so a line that every document has costs a row for each task.
    """
    lines = docs.select(F.explode(F.array_distinct(line_keys(F.col(f"`{text}`")))).alias("key")).filter(F.char_length("key") >= min_chars)
    counts = lines.select(*two_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.filter(F.col("n_docs") >= min_docs)


def drop_frequent_lines(docs: DataFrame, ids: list[str], text: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` without the lines whose key is in at least ``min_docs`` rows.

    ``text`` is replaced and the longs ``n_lines`` (before dropping) and
    ``n_dropped`` are added.  Rows meet their positions by a hash of ``ids`` and
    text, so texts are shuffled once at most, and rows that agree in both (and
    so in what they lose) need no numbers.
    """
    frequent = written(frequent_lines(docs, text, min_docs, min_chars), "frequent_lines")
    r1, r2, lines, n, kept, added, dropped = (free_name(docs, x) for x in ("_row1", "_row2", "_lines", "_n", "_kept", "n_lines", "n_dropped"))
    own = [F.col(f"`{c}`") for c in (*ids, text)]
    keyed = docs.withColumns({r1: F.xxhash64(F.lit("row"), *own), r2: F.xxhash64(F.lit("again"), *own)})
    places = (
        keyed.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.posexplode(line_keys(F.col(f"`{text}`"))).alias("at", "key"))
        .filter(F.char_length("key") >= min_chars)
        .select("r1", "r2", "at", *two_hashes(F.col("key")))
    )
    found = find_spread(places, frequent, ["h1", "h2"], "n_docs", broadcast_keys)
    gone = found.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.collect_set("at").alias("_gone"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    marked = keyed.join(gone, [r1, r2], "left").select(*keep, F.col("_gone").alias(kept), split_lines(F.col(f"`{text}`")).alias(lines))
    stays = F.when(F.col(kept).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(kept)))
    marked = marked.select(*keep, F.col(lines), F.size(lines).cast("long").alias(n), stays.alias(kept))
    rebuilt = F.when(F.col(kept).isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    return marked.select(
        *[rebuilt.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.col(n).alias(added),
        (F.col(n) - F.coalesce(F.size(kept), F.col(n))).cast("long").alias(dropped),
    )


def digest(text: str = "text") -> Column:
    return hex_digest(F.col(f"`{text}`"))
