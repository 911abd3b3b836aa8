"""Candle ingestion: parsing, closed bars, incremental bounds, dedup, retention."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import indicators as I
from ..functions import scalars as S
from ..schemas import TABLES

KEY = ["symbol", "interval"]
BAR = [*KEY, "open_time"]
#: Fixed layout of a raw bar: positions 0 to 6.
RAW = "symbol string, interval string, k array<string>"


def parse_klines(raw: DataFrame) -> DataFrame:
    """Raw rows (symbol, interval, k) to typed bars with millisecond times.

    Rows that don't parse come out with ``bad`` true instead of failing the job.
    """
    number = lambda i, kind: F.get("k", F.lit(i)).try_cast(kind)
    out = raw.select(
        *KEY,
        number(0, "bigint").alias("open_ms"),
        *[number(i, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)],
        number(6, "bigint").alias("close_ms"),
    )
    missing = reduce(lambda a, c: a | F.col(c).isNull(), out.columns[2:], F.lit(False))
    return out.withColumn("bad", missing)


def closed_bars(bars: DataFrame, now_ms: int | Column, close_ms: str = "close_ms") -> DataFrame:
    """Bars that are closed at ``now``; one that closes just then counts."""
    return bars.filter(F.col(close_ms) <= now_ms)


def typed(bars: DataFrame) -> DataFrame:
    """Bars with UTC times cut to the second."""
    return bars.select(
        *KEY, S.millis_to_second(F.col("open_ms")).alias("open_time"), "open", "high", "low", "close", "volume", S.millis_to_second(F.col("close_ms")).alias("close_time")
    )


def incremental(bars: DataFrame, state: DataFrame, now: Column, bootstrap: int = 250) -> DataFrame:
    """Bars beyond each key's mark; a key without one takes its newest ``bootstrap``.

    A key whose next bar would open in the future takes nothing.
    """
    joined = bars.join(state.select(*KEY, "last_open_time"), KEY, "left")
    rank = F.row_number().over(Window.partitionBy(*KEY, F.col("last_open_time").isNull()).orderBy(F.desc("open_time")))
    due = F.timestamp_diff("SECOND", "last_open_time", now) > 0
    known = joined.filter("last_open_time is not null").filter(due & (F.col("open_time") > F.col("last_open_time")))
    cold = joined.filter("last_open_time is null").withColumn("_rank", rank).filter(F.col("_rank") <= bootstrap).drop("_rank")
    return known.unionByName(cold).drop("last_open_time")


def new_bars(bars: DataFrame, existing: DataFrame, arrival: str | None = None) -> DataFrame:
    """First-wins rows of a batch that the table does not have yet.

    Of several rows of a bar the first by ``arrival`` stays; without such a
    column the least by value, so that a rerun picks the same row.
    """
    order = [arrival] if arrival else ["close_time", "open", "high", "low", "close", "volume"]
    first = F.row_number().over(Window.partitionBy(*BAR).orderBy(*order))
    batch = bars.withColumn("_n", first).filter("_n = 1").drop("_n")
    return batch.join(existing.select(*BAR), BAR, "left_anti")


def advance_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Marks move to the newest bar seen, duplicate or not; keys without rows stay."""
    newest = seen.groupBy(*KEY).agg(F.max("open_time").alias("last_open_time"))
    return state.select(*KEY, "last_open_time").unionByName(newest).groupBy(*KEY).agg(F.max("last_open_time").alias("last_open_time"))


def ingest_report(added: DataFrame) -> DataFrame:
    """New rows by symbol and interval, with the total in both null."""
    counted = added.rollup(*KEY).agg(F.count(F.lit(1)).alias("n_new"), F.grouping_id().alias("g"))
    return counted.filter("g in (0, 3)").drop("g")


def seed_symbols(symbols: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Symbols that are missing, ready to append."""
    parts = S.split_symbol(F.col("symbol"))
    missing = wanted.select("symbol").distinct().join(symbols.select("symbol"), "symbol", "left_anti")
    return missing.select("symbol", parts["base"].alias("base"), parts["quote"].alias("quote"), F.lit(True).alias("active"), now.alias("added_at"))


def active_symbols(symbols: DataFrame, reference: str | None = None) -> DataFrame:
    """Active symbols by name; a reference seeded only for the regime is left out."""
    out = symbols.filter("active")
    return (out if reference is None else out.filter(F.col("symbol") != reference)).orderBy("symbol")


def latest_bars(candles: DataFrame, n: int = 250) -> DataFrame:
    """The newest n bars of each key."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("open_time")))
    return candles.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def bar_arrays(candles: DataFrame, n: int = 250) -> DataFrame:
    """One row per symbol and interval with its newest n bars, oldest first."""
    bar = F.struct("open_time", "open", "high", "low", "close", "volume", "close_time")
    return latest_bars(candles, n).groupBy(*KEY).agg(F.array_sort(F.collect_list(bar)).alias("bars"))


def tracked_pairs(candles: DataFrame) -> DataFrame:
    """The symbols and intervals that have candles."""
    return candles.select(*KEY).distinct()


def numbered(rows: DataFrame, keys: list[str] = KEY, order: list[str] = ["open_time"]) -> DataFrame:
    """Rows with ``n``, their place in their key from 0 on, by a time and further columns; a key's months are numbered in separate tasks."""
    by_month = rows.withColumn("_month", F.date_trunc("month", order[0]))
    inside = F.row_number().over(Window.partitionBy(*keys, "_month").orderBy(*order))
    months = by_month.groupBy(*keys, "_month").agg(F.count(F.lit(1)).alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1))
    months = months.select(*keys, "_month", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return by_month.withColumn("n", inside).join(months, [*keys, "_month"]).withColumn("n", F.col("n") - 1 + F.col("_before")).drop("_month", "_before")


def in_blocks(rows: DataFrame, back: int, keys: list[str] = KEY, order: list[str] = ["open_time"], size: int = 10_000) -> DataFrame:
    """Rows with ``block`` and ``own``, for frames of up to ``back`` rows before a row.

    A block is ``size`` rows of a key and, not ``own``, the ``back`` rows before
    them.  Windows by key and block see all that frames reach, and a key's long
    history goes to many tasks.
    """
    n = F.col("n")
    more = F.when(n % size >= size - back, F.array(F.floor(n / size), F.floor(n / size) + 1)).otherwise(F.array(F.floor(n / size)))
    out = numbered(rows, keys, order).withColumn("block", F.explode(more))
    return out.withColumn("own", F.floor(n / size) == F.col("block")).drop("n")


def rsi_of_bars(candles: DataFrame, n: int = 250, period: int = 14) -> DataFrame:
    """RSI at every bar of a key, over the n bars that end with it as a scan would load them.

    Blocks of n bars overlap: each also takes the block before, so the blocks of
    a long history go to separate tasks.
    """
    block = F.floor(F.col("n") / n)
    rows = numbered(candles).select(*KEY, "n", "open_time", "close", block.alias("_own"), F.explode(F.array(block, block + 1)).alias("block"))
    bar = F.struct("n", "open_time", "close", (F.col("_own") == F.col("block")).alias("own"))
    blocks = rows.groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    blocks = blocks.select(*KEY, F.filter("bars", lambda b: b["own"]).alias("own"), I.field(F.col("bars"), "close").alias("closes")).filter(F.size("own") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # values stay in flat arrays, a few blocks at a time
                batch = whole.slice(at, 256)
                sizes = np.diff(batch.column("own").offsets.to_numpy())
                closes, ends = batch.column("closes").flatten().to_numpy(zero_copy_only=False), batch.column("closes").offsets.to_numpy()
                ends = ends - ends[0]
                found = [I.rsi_windows(closes[a:b].astype(float), b - a - own, n, period) for a, b, own in zip(ends[:-1], ends[1:], sizes)]
                values = np.concatenate(found)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                rsi = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, mask=np.isnan(values)))
                yield pa.RecordBatch.from_arrays([*batch.columns, rsi], names=[*batch.schema.names, "rsi"])

    done = blocks.mapInArrow(run, StructType([*blocks.schema.fields, StructField("rsi", ArrayType(DoubleType()))]))
    return done.select(*KEY, F.inline(F.arrays_zip(I.field(F.col("own"), "open_time").alias("open_time"), F.col("rsi"))))


def retention_split(candles: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Candles with ``keep``; intervals without a positive cap are kept whole.

    The oldest bar that a key keeps is found by a top-n per key, which Spark
    cuts down before the shuffle; candles then meet that one row.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.desc("open_time"))
    oldest = [
        candles.filter(F.col("interval") == i).select(*KEY, "open_time").withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= cap)
        for i, cap in caps.items()
        if cap > 0
    ]
    if not oldest:
        return candles.withColumn("keep", F.lit(True))
    from_time = reduce(DataFrame.unionByName, oldest).groupBy(*KEY).agg(F.min("open_time").alias("_from"))
    return candles.join(from_time, KEY, "left").withColumn("keep", F.col("_from").isNull() | (F.col("open_time") >= F.col("_from"))).drop("_from")


def retention_report(candles: DataFrame, caps: dict[str, int]) -> DataFrame:
    return retention_split(candles, caps).groupBy("interval").agg(F.count_if(~F.col("keep")).alias("n_deleted"), F.count_if("keep").alias("n_kept"))


def write_table(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Write a domain table; candles are laid out by interval and sorted by symbol and time."""
    df = df.select(*[f.split(" ")[0] for f in TABLES[name].split(", ")])
    if name == "candles":
        df.repartition("interval", "symbol").sortWithinPartitions("symbol", "open_time").write.partitionBy("interval").mode(mode).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; a local master without the setting uses /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A domain table written and read again, for tables that several reports read."""
    path = scratch(df.sparkSession)
    write_table(df, path, name)
    return df.sparkSession.read.schema(TABLES[name]).parquet(path)
