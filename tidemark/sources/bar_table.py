"""A stored table of candles, laid out by interval and month.

Operations touch the partitions that they concern: an insert reads the months
of its batch, and retention rewrites the partitions that lose some rows and
drops those that lose all.  Files of other partitions stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from . import candles as C

COLUMNS = [f.split(" ")[0] for f in TABLES["candles"].split(", ") if not f.startswith("interval ")]
LAYOUT = ["interval", "month"]
#: Partitions that a statement drops; each statement lists the table's partitions anew.
DROPPED = 1000


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a write."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def create(spark: SparkSession, table: str) -> None:
    """An empty table, if there is none of the name."""
    fields = ", ".join(f for f in TABLES["candles"].split(", ") if not f.startswith("interval "))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}, interval string, month string) USING parquet PARTITIONED BY (interval, month)")


def _laid_out(bars: DataFrame) -> DataFrame:
    """Columns in the table's order, a partition in one file unless it is large, sorted by symbol and time."""
    rows = bars.withColumn("month", F.date_format("open_time", "yyyy-MM")).select(*COLUMNS, *LAYOUT)
    return rows.hint("rebalance", *LAYOUT).sortWithinPartitions(*LAYOUT, "symbol", "open_time")


def months_of(bars: DataFrame) -> list[tuple[str, str]]:
    """The partitions (interval, month) that bars belong to; as many as a batch has months."""
    return sorted(tuple(r) for r in bars.filter("open_time is not null").select("interval", F.date_format("open_time", "yyyy-MM")).distinct().collect())


def partitions(table: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Rows of some partitions; the others are not read."""
    by: dict[str, list[str]] = {}
    for interval, month in wanted:
        by.setdefault(interval, []).append(month)
    keep = F.lit(False)
    for interval, months in by.items():
        keep = keep | ((F.col("interval") == interval) & F.col("month").isin(months))
    return table.filter(keep)


def fresh(spark: SparkSession, table: str, bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """First-wins bars of a batch that the table does not have, read from the batch's months only."""
    known = partitions(spark.table(table), months_of(bars))
    return C.new_bars(bars.filter("open_time is not null"), known, arrival)


def insert(spark: SparkSession, table: str, bars: DataFrame, arrival: str | None = None) -> None:
    """Append the bars that are new; a rerun of a batch adds nothing.  Bars without a time are left out."""
    _laid_out(fresh(spark, table, bars, arrival)).write.insertInto(table)


def retain(spark: SparkSession, table: str, caps: dict[str, int]) -> DataFrame:
    """Delete the bars beyond each interval's cap; what was done by interval and month (n_deleted, n_kept).

    Partitions that keep all their rows are not written; those that lose some
    are written aside and overwritten, and those that lose all are dropped.
    """
    split = C.retention_split(spark.table(table), caps)
    counted = split.groupBy(*LAYOUT).agg(F.count_if(~F.col("keep")).alias("n_deleted"), F.count_if("keep").alias("n_kept"))
    touched = [r for r in counted.collect() if r.n_deleted]  # a row for each interval and month
    some = [(r.interval, r.month) for r in touched if r.n_kept]
    if some:
        path = C.scratch(spark)  # a table can't be overwritten while it is read
        partitions(split, some).filter("keep").select(*COLUMNS, "interval").write.parquet(path)
        with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            _laid_out(spark.read.schema(TABLES["candles"]).parquet(path)).write.insertInto(table, overwrite=True)
    gone = [f"PARTITION (interval = '{r.interval}', month = '{r.month}')" for r in touched if not r.n_kept]
    for at in range(0, len(gone), DROPPED):
        spark.sql(f"ALTER TABLE {table} DROP {', '.join(gone[at : at + DROPPED])}")
    return spark.createDataFrame(touched, counted.schema)
