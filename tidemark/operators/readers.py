"""Filters, pages and lookups over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def signal_filter(symbol=None, severity=None, regime=None, since: Column | None = None, until: Column | None = None) -> Column:
    """All given conditions; times are half-open."""
    equal = {"symbol": symbol, "severity": severity, "regime_at_signal": regime}
    out = [F.col(k) == v for k, v in equal.items() if v is not None]
    out += [F.col("detected_at") >= since] if since is not None else []
    return _all(out + ([F.col("detected_at") < until] if until is not None else []))


def page(rows: DataFrame, time: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, of equal times the highest id first; a limit under 1 is 1, an offset under 0 is 0."""
    limit, offset = max(limit, 1), max(offset, 0)
    return rows.orderBy(F.desc(time), F.desc("id")).offset(offset).limit(limit)


def page_meta(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """total, limit, offset and the next offset (null on the last page); limit and offset as in ``page``."""
    limit, offset = max(limit, 1), max(offset, 0)
    after = F.lit(offset + limit).cast("bigint")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), F.when(after < F.col("total"), after).alias("next_offset"))


def recent(rows: DataFrame, time: str, limit: int = 10) -> DataFrame:
    return rows.limit(0) if limit <= 0 else rows.orderBy(F.desc(time), F.desc("id")).limit(limit)


def count_since(rows: DataFrame, time: str, since: Column) -> DataFrame:
    return rows.filter(F.col(time) >= since).agg(F.count(F.lit(1)).alias("n"))


def sell_filter(symbol=None, rule=None, since: Column | None = None, until: Column | None = None) -> Column:
    equal = {"symbol": symbol, "rule_triggered": rule}
    out = [F.col(k) == v for k, v in equal.items() if v is not None]
    out += [F.col("detected_at") >= since] if since is not None else []
    return _all(out + ([F.col("detected_at") < until] if until is not None else []))


def buys(rows: DataFrame, status: str = "all", symbol: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Buys in order of time and id; ``status`` is all, open or sold.

    Only a positive ``limit`` makes a page; an offset under 0 is 0.
    """
    if status not in ("all", "open", "sold"):
        raise ValueError(f"unknown status: {status}")
    out = rows if status == "all" else rows.filter(F.col("sold_at").isNull() if status == "open" else F.col("sold_at").isNotNull())
    out = out if symbol is None else out.filter(F.col("symbol") == symbol)
    out = out.orderBy("bought_at", "id")
    return out.offset(max(0, offset)).limit(limit) if limit is not None and limit > 0 else out


def count_buys(rows: DataFrame, status: str = "all", symbol: str | None = None) -> DataFrame:
    """How many buys there are of a status."""
    if status not in ("all", "open", "sold"):
        raise ValueError(f"unknown status: {status}")
    out = rows if status == "all" else rows.filter(F.col("sold_at").isNull() if status == "open" else F.col("sold_at").isNotNull())
    return (out if symbol is None else out.filter(F.col("symbol") == symbol)).agg(F.count(F.lit(1)).alias("n"))


def last_ascending(rows: DataFrame, time: str, n: int) -> DataFrame:
    """The newest n rows, oldest first."""
    return rows.orderBy(F.desc(time), F.desc("id")).limit(n).orderBy(time, "id")


def open_positions(buys: DataFrame, symbol: str | None = None) -> DataFrame:
    out = buys.filter("sold_at is null")
    return out if symbol is None else out.filter(F.col("symbol") == symbol)


def watching(watchlist: DataFrame, symbol: str | None = None) -> DataFrame:
    out = watchlist.filter("status = 'watching'")
    return (out if symbol is None else out.filter(F.col("symbol") == symbol)).orderBy("first_seen_at", "id")


def latest_close(candles: DataFrame, interval: str = "1h") -> DataFrame:
    """symbol, close and close_time of each symbol's newest bar."""
    newest = F.max_by(F.struct("close", "close_time"), "open_time")
    return candles.filter(F.col("interval") == interval).groupBy("symbol").agg(newest.alias("b")).select("symbol", "b.close", "b.close_time")


def freshness(candles: DataFrame, interval: str = "1h") -> DataFrame:
    """close_time of the newest bar over all symbols."""
    return candles.filter(F.col("interval") == interval).agg(F.max_by("close_time", "open_time").alias("close_time"))


def latest_by_id(rows: DataFrame, limit: int = 1) -> DataFrame:
    return rows.orderBy(F.desc("id")).limit(limit)


def weekly_list(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("week_end"), F.desc("id")).limit(limit)


def by_id(rows: DataFrame, key: str, value: int) -> DataFrame:
    return rows.filter(F.col(key) == value)


def signal_detail(signals: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Signals with their evaluation as a struct, null while there is none."""
    e = evaluations.select(F.col("signal_id").alias("_id"), F.struct("*").alias("evaluation"))
    return signals.join(e, F.col("id") == F.col("_id"), "left").drop("_id")


def ranked(rows: DataFrame, key: str, canonical: list[str]) -> DataFrame:
    """Canonical keys first in their order, the rest by name."""
    place = F.array_position(F.array(*map(F.lit, canonical)), F.col(key))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(canonical) + 1), key)


def max_severity(signals: DataFrame) -> DataFrame:
    """Highest severity rank per symbol and candle hour."""
    rank = F.when(F.col("severity") == "very_strong", 3).when(F.col("severity") == "strong", 2).when(F.col("severity") == "normal", 1)
    return signals.groupBy("symbol", "candle_hour").agg(F.max(rank).alias("max_rank"))


def per_symbol_rank(time: str) -> Column:
    return F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(time), F.desc("id")))
