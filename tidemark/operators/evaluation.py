"""Outcomes of matured signals and buys: as-of prices, excursions, verdicts.

The as-of lookup is a union of targets and bars with windows of a symbol and
month, and the extremes of a span are two running extremes of a symbol's blocks,
so that neither visits all later bars of a symbol for each event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Verdicts
from . import scoring


def price_at_or_after(targets: DataFrame, bars: DataFrame, by_month: bool = True) -> DataFrame:
    """``targets`` (key, symbol, at) with the close of the first bar that opens at or after ``at``.

    A window holds one symbol and month; what a month lacks is the first bar of
    the next month that has one, from a table of a row per symbol and month.
    """
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz")
    if not by_month:
        month = lambda c: F.lit("1970-01-01").cast("timestamp_ntz")
    bar = bars.select("symbol", F.col("open_time").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(targets.schema["key"].dataType).alias("key"), "close")
    both = targets.select("symbol", "at", F.lit(0).alias("kind"), "key", F.lit(None).cast("double").alias("close")).unionByName(bar).withColumn("m", month(F.col("at")))
    # newest first: a frame that grows is one pass, one that shrinks is not
    here = Window.partitionBy("symbol", "m").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.last_value("close", True).over(here)
    found = both.select("symbol", "m", "key", "at", "kind", first.alias("price")).filter("kind = 0")
    months = both.groupBy("symbol", "m").agg(F.min_by("close", F.when(F.col("kind") == 1, F.col("at"))).alias("c"))
    later = Window.partitionBy("symbol").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("symbol", "m", F.last_value("c", True).over(later).alias("next"))
    return found.join(months, ["symbol", "m"]).select("key", "symbol", "at", F.coalesce("price", "next").alias("price"))


def extremes(points: DataFrame, bars: DataFrame, days: int = 7) -> DataFrame:
    """(symbol, t0) with the highest high and lowest low of the bars that open in [t0, t0 + days], and their earliest times.

    Time is cut into blocks of ``days``.  Such a span is the rest of one block
    and the beginning of the next, so a point needs two lookups: the extremes from
    t0 to its block's end, and those from the next block's start to t0 + days.
    Both are running extremes over a symbol's block, where points stand among the
    bars; a symbol's blocks go to separate tasks.  Points without bars have no row.
    """
    size = days * 86_400_000_000
    bar, begin, end = 0, 1, 2
    rows = bars.select("symbol", _us(F.col("open_time")).alias("at"), F.lit(bar).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("t0"), "high", "low")
    none = F.lit(None).cast("double")
    ends = F.explode(F.array(F.struct(_us(F.col("t0")).alias("at"), F.lit(begin).alias("kind")), F.struct((_us(F.col("t0")) + size).alias("at"), F.lit(end).alias("kind"))))
    wanted = points.select("symbol", "t0", ends.alias("e")).select("symbol", "e.at", "e.kind", "t0", none.alias("high"), none.alias("low"))
    rows = rows.unionByName(wanted).withColumn("block", F.floor(F.col("at") / size))
    is_bar = F.col("kind") == bar
    high = F.when(is_bar, F.struct(F.col("high").alias("v"), (-F.col("at")).alias("t")))
    low = F.when(is_bar, F.struct(F.col("low").alias("v"), F.col("at").alias("t")))
    block = Window.partitionBy("symbol", "block")
    grown = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest, start = grown(block.orderBy(F.desc("at"), "kind")), grown(block.orderBy("at", "kind"))  # a bar at the time of a point counts
    side = lambda f, c: F.when(F.col("kind") == begin, f(c).over(rest)).otherwise(f(c).over(start))
    found = rows.select("symbol", "t0", "kind", side(F.max, high).alias("h"), side(F.min, low).alias("l")).filter(F.col("kind") != bar)
    out = found.groupBy("symbol", "t0").agg(F.max("h").alias("h"), F.min("l").alias("l")).filter(F.col("h").isNotNull())
    return out.select("symbol", "t0", F.col("h.v").alias("top"), (-F.col("h.t")).alias("top_us"), F.col("l.v").alias("bottom"), F.col("l.t").alias("bottom_us"))


def _us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def excursions(events: DataFrame, bars: DataFrame, days: int = 7) -> DataFrame:
    """Best gain and worst loss over the bars that open in [t0, t0 + days].

    ``events`` has key, symbol, t0 and base.  Gains and losses are percents;
    hours run to the earliest bar with the extreme.  Both ends count.  Extremes
    are found once for all events of a symbol and time.
    """
    points = extremes(events.select("symbol", "t0").distinct(), bars, days)
    hours = lambda us: (F.col(us) - _us(F.col("t0"))) / 3.6e9
    return events.join(points, ["symbol", "t0"]).select(
        "key",
        S.pct_change(F.col("base"), F.col("top")).alias("max_gain_pct"),
        S.pct_change(F.col("base"), F.col("bottom")).alias("max_loss_pct"),
        hours("top_us").alias("time_to_mfe_hours"),
        hours("bottom_us").alias("time_to_mae_hours"),
    )


def pending(rows: DataFrame, evaluations: DataFrame, key: str) -> DataFrame:
    """Rows without an evaluation."""
    return rows.join(evaluations.select(F.col(key).alias("id")), "id", "left_anti")


def _prices_later(points: DataFrame, bars: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """(symbol, t0) with ``price_<h>_later`` for each horizon (in hours)."""
    names = list(horizons)
    at = [F.struct(F.lit(h).alias("h"), F.timestamp_add("HOUR", F.lit(n), "t0").alias("at")) for h, n in horizons.items()]
    targets = points.select("symbol", "t0", F.explode(F.array(*at)).alias("t")).select(F.struct("t0", "t.h").alias("key"), "symbol", F.col("t.at").alias("at"))
    found = price_at_or_after(targets, bars)
    later = [F.max(F.when(F.col("key.h") == h, F.col("price"))).alias(f"price_{h}_later") for h in names]
    return found.groupBy("symbol", F.col("key.t0").alias("t0")).agg(*later)


def _outcomes(due: DataFrame, bars: DataFrame, horizons: dict[str, int], days: int = 7) -> DataFrame:
    """``due`` (key, symbol, t0, base, ...) with later prices, gains, losses and their hours.

    What depends on symbol and time only is found once for each such point, and
    joined back; a symbol's many events of an hour share it.
    """
    points = due.select("symbol", "t0").distinct()
    found = _prices_later(points, bars, horizons).join(extremes(points, bars, days), ["symbol", "t0"], "left")
    hours = lambda us: (F.col(us) - _us(F.col("t0"))) / 3.6e9
    return due.join(found, ["symbol", "t0"], "left").withColumns(
        {
            "max_gain_pct": S.pct_change(F.col("base"), F.col("top")),
            "max_loss_pct": S.pct_change(F.col("base"), F.col("bottom")),
            "time_to_mfe_hours": hours("top_us"),
            "time_to_mae_hours": hours("bottom_us"),
        }
    )


def evaluate_signals(signals: DataFrame, evaluations: DataFrame, bars_1h: DataFrame, now: Column, p: Verdicts = Verdicts(), only: int | None = None) -> DataFrame:
    """Evaluation rows of all pending signals that have matured."""
    due = pending(signals, evaluations, "signal_id").filter(S.matured(F.col("candle_hour"), now))
    due = due if only is None else due.filter(F.col("id") == only)
    due = due.select(F.col("id").alias("key"), "symbol", F.col("candle_hour").alias("t0"), F.col("price_at_signal").alias("base"))
    out = _outcomes(due, bars_1h, {"24h": 24, "7d": 7 * 24, "30d": 30 * 24})
    returns = {h: S.pct_change(F.col("base"), F.col(f"price_{h}_later")) for h in ("24h", "7d", "30d")}
    return out.select(
        F.col("key").alias("signal_id"),
        now.alias("evaluated_at"),
        F.col("base").alias("price_at_signal"),
        *[f"price_{h}_later" for h in returns],
        *[c.alias(f"return_{h}_pct") for h, c in returns.items()],
        F.col("max_gain_pct").alias("max_gain_7d_pct"),
        F.col("max_loss_pct").alias("max_loss_7d_pct"),
        scoring.verdict(returns["7d"], p).alias("verdict"),
        "time_to_mfe_hours",
        "time_to_mae_hours",
    )


def day_lows(buys: DataFrame, bars_1h: DataFrame) -> DataFrame:
    """Day open and hourly low of the UTC day of each buy."""
    b = bars_1h.select("symbol", S.floor_day(F.col("open_time")).alias("day"), "open_time", "open", "low")
    days = b.groupBy("symbol", "day").agg(
        F.min_by("open", "open_time").alias("day_open"), F.min("low").alias("day_low_hourly"), F.min_by("open_time", F.struct("low", "open_time")).alias("day_low_hourly_time")
    )
    return buys.withColumn("day", S.floor_day(F.col("t0"))).join(days, ["symbol", "day"], "left").drop("day")


#: Fixed text of the evaluation table.
NOTE = "day low resolved from 1h candles"


def evaluate_buys(buys: DataFrame, evaluations: DataFrame, bars_1h: DataFrame, now: Column, p: Verdicts = Verdicts(), only: int | None = None) -> DataFrame:
    """Evaluation rows of all pending buys that have matured."""
    due = pending(buys, evaluations, "buy_id").filter(S.matured(F.col("bought_at"), now))
    due = due if only is None else due.filter(F.col("id") == only)
    due = due.select(F.col("id").alias("key"), "symbol", F.col("bought_at").alias("t0"), F.col("price").alias("base"))
    out = _outcomes(day_lows(due, bars_1h), bars_1h, {"7d": 7 * 24, "30d": 30 * 24})
    r7, r30 = (S.pct_change(F.col("base"), F.col(f"price_{h}_later")) for h in ("7d", "30d"))
    return out.select(
        F.col("key").alias("buy_id"),
        now.alias("evaluated_at"),
        "day_open",
        "day_low_hourly",
        "day_low_hourly_time",
        S.pct_change(F.col("day_open"), F.col("day_low_hourly")).alias("pct_from_day_open_to_low_hourly"),
        S.pct_change(F.col("base"), F.col("day_low_hourly")).alias("pct_from_buy_to_low_hourly"),
        S.pct_change(F.col("day_low_hourly"), F.col("base")).alias("buy_vs_day_low_hourly_pct"),
        "price_7d_later",
        r7.alias("return_7d_pct"),
        "price_30d_later",
        r30.alias("return_30d_pct"),
        scoring.verdict(r7, p).alias("verdict"),
        F.lit(NOTE).alias("resolution_note"),
        "max_gain_pct",
        "max_loss_pct",
        "time_to_mfe_hours",
        "time_to_mae_hours",
    )


def evaluation_report(rows: DataFrame, evaluations: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """considered, evaluated and skipped of a pass."""
    one = pending(rows, evaluations, key).agg(F.count(F.lit(1)).alias("considered"))
    two = made.agg(F.count(F.lit(1)).alias("evaluated"))
    return one.crossJoin(F.broadcast(two)).withColumn("skipped", F.col("considered") - F.col("evaluated"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
