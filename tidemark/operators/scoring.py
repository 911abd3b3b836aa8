"""Scoring rules as column expressions, and the score of every symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import scalars as S
from ..params import Regime, Scoring, Tiers, Verdicts

HORIZONS = ["1h", "24h", "7d", "30d", "180d"]


def tier_up(value: Column, tiers: Tiers) -> Column:
    """Points of the last level, in list order, that the value reaches; null gives 0."""
    out = F.lit(0)
    for level, points in zip(*tiers, strict=True):
        out = F.when(value >= level, points).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def tier_down(value: Column, tiers: Tiers) -> Column:
    """Points of the last level that the value is at or under."""
    out = F.lit(0)
    for level, points in zip(*tiers, strict=True):
        out = F.when(value <= level, points).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def tier_first(value: Column, tiers: Tiers) -> Column:
    """Points of the first level that the value is at or under; negative gives 0."""
    out = F.lit(0)
    for level, points in reversed(list(zip(*tiers, strict=True))):
        out = F.when(value <= level, points).otherwise(out)
    return F.when(value.isNull() | (value < 0), 0).otherwise(out)


def with_drop(df: DataFrame, atr: str, price: str, p: Scoring) -> DataFrame:
    """Add ``drop``: (points, horizon, drop_pct, by_horizon, atr_normalized, atr_pct).

    The drops are the columns ``drop_<h>_pct``.  They count in units of ATR
    where that is known; the drop reported is raw.
    """
    unit = F.when((F.col(atr) > 0) & (F.col(price) > 0), F.try_divide(F.col(atr), F.col(price)) * 100)
    df = settled(df.withColumn("_unit", unit))
    known = F.col("_unit") > 0
    scaled = {h: F.when(known, F.col(f"drop_{h}_pct") / F.col("_unit")).otherwise(F.col(f"drop_{h}_pct")) for h in HORIZONS}
    df = settled(df.withColumns({f"_s{h}": c for h, c in scaled.items()}))
    df = settled(df.withColumns({f"_p{h}": tier_up(F.col(f"_s{h}"), p.drops[h]) for h in HORIZONS}))
    points = {h: F.col(f"_p{h}") for h in HORIZONS}
    df = settled(df.withColumn("_best", F.greatest(*points.values())))
    df = settled(df.withColumn("_horizon", F.coalesce(*[F.when((points[h] == F.col("_best")) & (F.col("_best") > 0), h) for h in HORIZONS])))
    raw = F.coalesce(*[F.when(F.col("_horizon") == h, F.col(f"drop_{h}_pct")) for h in HORIZONS])
    drop = F.struct(
        F.least("_best", F.lit(p.weights.drop)).alias("points"),
        F.col("_horizon").alias("horizon"),
        raw.alias("drop_pct"),
        F.struct(*[points[h].alias(f"h{h}") for h in HORIZONS]).alias("by_horizon"),
        F.coalesce(known, F.lit(False)).alias("atr_normalized"),
        F.when(known, F.col("_unit")).alias("atr_pct"),
    )
    return settled(df.withColumn("drop", drop).drop("_unit", "_best", "_horizon", *[f"_{k}{h}" for k in "sp" for h in HORIZONS]))


def rsi_points(rsi_1h: Column, rsi_4h: Column, p: Scoring) -> Column:
    return F.least(tier_down(rsi_1h, p.rsi_1h) + tier_down(rsi_4h, p.rsi_4h), F.lit(p.weights.rsi))


def volume_points(rel_volume: Column, p: Scoring) -> Column:
    return F.least(tier_up(rel_volume, p.rel_volume), F.lit(p.weights.volume))


def support_points(distance: Column, p: Scoring) -> Column:
    return F.least(tier_first(distance, p.support), F.lit(p.weights.support))


def discount_points(d30: Column, d180: Column, p: Scoring) -> Column:
    return F.least(tier_up(d30, p.discount_30d) + tier_up(d180, p.discount_180d), F.lit(p.weights.discount))


def reversal_points(pattern: Column, recovery: Column, reclaim: Column, divergence: Column, p: Scoring) -> Column:
    flag = lambda c, n: F.when(c, n).otherwise(0)
    total = flag(pattern.isNotNull(), 5) + flag(recovery, 3) + flag(reclaim, 2) + flag(divergence, 2)
    return F.least(total, F.lit(p.weights.reversal))


def trend_points(trend: Column, p: Scoring) -> Column:
    return F.least(F.when(trend == "uptrend", 5).when(trend == "sideways", 3).otherwise(0), F.lit(p.weights.trend))


def severity_of(score: Column, p: Scoring = Scoring()) -> Column:
    """Severity by tier alone."""
    return F.when(score >= p.very_strong, "very_strong").when(score >= p.strong, "strong").when(score >= p.normal, "normal")


def severity(score: Column, p: Scoring = Scoring(), adjust: Column | int = 0) -> Column:
    """Severity, null under the emit gate."""
    return F.when(score >= F.lit(p.min_score) + adjust, severity_of(score, p))


def regime_adjust(regime: Column, p: Regime = Regime()) -> Column:
    if not p.enabled:
        return F.lit(0)
    return F.when(regime == "risk_on", p.risk_on_adjust).when(regime == "risk_off", p.risk_off_adjust).otherwise(0)


def verdict(return_pct: Column, p: Verdicts = Verdicts()) -> Column:
    return (
        F.when(return_pct.isNull(), "pending")
        .when(return_pct >= p.great, "great")
        .when(return_pct >= p.good, "good")
        .when(return_pct <= p.bad, "bad")
        .when(return_pct <= p.poor, "poor")
        .otherwise("neutral")
    )


def trigger_reason(horizon: Column, drop: Column, rsi_1h: Column, rel_volume: Column, pattern: Column) -> Column:
    text = F.concat_ws(
        " | ",
        F.when(drop > 0, F.concat(F.lit("drop_"), horizon, F.lit("=-"), S.fixed(drop, 1), F.lit("%"))),
        F.when(rsi_1h <= 30, F.concat(F.lit("rsi_1h="), S.fixed(rsi_1h, 0))),
        F.when(rel_volume >= 1.5, F.concat(F.lit("rel_vol="), S.fixed(rel_volume, 1), F.lit("x"))),
        F.when(pattern.isNotNull(), F.concat(F.lit("pattern="), pattern)),
    )
    return F.when(text == "", "low-score evaluation").otherwise(text)


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator, so that later columns read its values.

    Without it the optimizer merges the projections and every use of a fold
    computes the fold again.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def score_symbols(arrays: DataFrame, detected_at: Column, p: Scoring = Scoring(), regime: DataFrame | None = None, regime_params: Regime = Regime()) -> DataFrame:
    """A candidate for every symbol with 1h bars, even under the threshold.

    ``arrays`` has symbol, interval and bars; ``regime`` (one row, label) is
    optional.  One shuffle by symbol brings the three intervals together.
    """
    pick = lambda i: F.coalesce(F.first(F.when(F.col("interval") == i, F.col("bars")), ignorenulls=True), F.array().cast(arrays.schema["bars"].dataType))
    s = arrays.groupBy("symbol").agg(pick("1h").alias("b1h"), pick("4h").alias("b4h"), pick("1d").alias("b1d")).filter(F.size("b1h") > 0)
    s = s.join(F.broadcast(regime.select(F.col("label").alias("regime")).limit(1)), F.lit(True), "left") if regime is not None else s.withColumn("regime", F.lit(None).cast("string"))
    c1, c4, cd = (I.field(F.col(b), "close") for b in ("b1h", "b4h", "b1d"))
    s = settled(s.withColumns({"c1h": c1, "c4h": c4, "c1d": cd, "last": F.element_at("b1h", -1)}))
    price = F.col("last.close")
    s = s.withColumns(
        {
            "price": price,
            "rsi_1h": I.rsi(F.col("c1h")),
            "rsi_4h": I.rsi(F.col("c4h")),
            "rsi_list": I.rsi_series(F.col("c1h")),
            "rel_volume": I.relative_volume(I.field(F.col("b1h"), "volume")),
            "atr_1h": I.atr(F.col("b1h")),
            "support": I.support(F.col("b1d"), price, p.support_lookback),
            "pattern": I.reversal(F.col("b1h")),
            "reclaim": I.high_reclaim(F.col("b1h")),
            "trend_4h": I.trend_label(F.col("c4h")),
            "trend_1d": I.trend_label(F.col("c1d")),
            "high_30d": F.array_max(I.field(I.last_n(F.col("b1d"), 30), "high")),
            "high_180d": F.array_max(I.field(I.last_n(F.col("b1d"), 180), "high")),
        }
    )
    s = settled(s)
    drops = {
        "1h": S.positive_drop(F.col("last.open"), F.col("price")),
        "24h": S.positive_drop(I.at_end(F.col("c1h"), 25), F.col("price")),
        **{f"{d}d": S.positive_drop(I.at_end(F.col("c1d"), d + 1), F.col("price")) for d in (7, 30, 180)},
    }
    s = s.withColumns(
        {f"drop_{h}_pct": c for h, c in drops.items()}
        | {f"discount_{d}d": S.positive_drop(F.col(f"high_{d}d"), F.col("price")) for d in (30, 180)}
        | {
            "recovery": I.rsi_recovery(F.col("rsi_list")),
            "divergence": I.bullish_divergence(F.col("c1h"), F.col("rsi_list")) if p.divergence else F.lit(False),
        }
    )
    s = settled(s.drop("b1h", "b4h", "b1d", "c4h"))
    s = with_drop(s, "atr_1h", "price", p)
    s = s.withColumns(
        {
            "p_rsi": rsi_points(F.col("rsi_1h"), F.col("rsi_4h"), p),
            "p_volume": volume_points(F.col("rel_volume"), p),
            "p_support": support_points(F.col("support.distance_pct"), p),
            "p_discount": discount_points(F.col("discount_30d"), F.col("discount_180d"), p),
            "p_reversal": reversal_points(F.col("pattern"), F.col("recovery"), F.col("reclaim"), F.col("divergence"), p),
            "p_trend": trend_points(F.col("trend_1d"), p),
        }
    )
    score = F.col("drop.points") + F.col("p_rsi") + F.col("p_volume") + F.col("p_support") + F.col("p_discount") + F.col("p_reversal") + F.col("p_trend")
    s = settled(s.withColumn("score", score))
    breakdown = F.to_json(
        F.struct(
            F.col("score").alias("total"),
            F.col("drop").alias("drop_magnitude"),
            F.struct(F.col("p_rsi").alias("points"), "rsi_1h", "rsi_4h").alias("rsi_oversold"),
            F.struct(F.col("p_volume").alias("points"), "rel_volume").alias("relative_volume"),
            F.struct(F.col("p_support").alias("points"), "support.distance_pct", F.col("support.price").alias("support_price")).alias("support_distance"),
            F.struct(F.col("p_discount").alias("points"), F.col("discount_30d").alias("discount_30d_pct"), F.col("discount_180d").alias("discount_180d_pct")).alias("discount_from_high"),
            F.struct(F.col("p_reversal").alias("points"), "pattern", F.col("recovery").alias("rsi_recovery"), F.col("reclaim").alias("high_reclaim"), "divergence").alias("reversal_pattern"),
            F.struct(F.col("p_trend").alias("points"), F.col("trend_1d")).alias("trend_context"),
        )
    )
    return s.select(
        "symbol",
        F.col("last.open_time").alias("candle_hour"),
        detected_at.alias("detected_at"),
        F.col("price").alias("price_at_signal"),
        "score",
        severity(F.col("score"), p, regime_adjust(F.col("regime"), regime_params)).alias("severity"),
        trigger_reason(F.col("drop.horizon"), F.col("drop.drop_pct"), F.col("rsi_1h"), F.col("rel_volume"), F.col("pattern")).alias("trigger_reason"),
        F.col("drop.horizon").alias("dominant_trigger_timeframe"),
        *[f"drop_{h}_pct" for h in HORIZONS],
        F.col("drop.drop_pct").alias("drop_trigger_pct"),
        F.col("high_30d").alias("recent_30d_high"),
        F.col("high_180d").alias("recent_180d_high"),
        F.col("discount_30d").alias("distance_from_30d_high_pct"),
        F.col("discount_180d").alias("distance_from_180d_high_pct"),
        "rsi_1h",
        "rsi_4h",
        "rel_volume",
        "atr_1h",
        F.col("support.distance_pct").alias("dist_support_pct"),
        F.col("support.price").alias("support_level_price"),
        F.col("pattern").isNotNull().alias("reversal_signal"),
        F.col("pattern").alias("reversal_pattern"),
        F.col("trend_4h").alias("trend_context_4h"),
        F.col("trend_1d").alias("trend_context_1d"),
        breakdown.alias("score_breakdown"),
        F.col("regime").alias("regime_at_signal"),
    )


def classify_regime(arrays: DataFrame, symbol: str, determined_at: Column, p: Regime = Regime()) -> DataFrame:
    """One regime row of the reference symbol's daily bars, if there is enough history."""
    bars, closes = F.col("bars"), F.col("closes")
    s = arrays.filter((F.col("symbol") == symbol) & (F.col("interval") == "1d") & (F.size("bars") >= p.ema_long)).withColumn("closes", I.field(bars, "close"))
    s = s.select(
        I.ema(closes, p.ema_short).alias("ema_short"),
        I.ema(closes, p.ema_long).alias("ema_long"),
        I.atr(bars, p.atr_period).alias("atr"),
        I.atr_percentile(bars, p.atr_period, p.lookback).alias("atr_percentile"),
    )
    calm = F.col("atr_percentile") <= p.high_percentile
    label = F.when((F.col("ema_short") > F.col("ema_long")) & calm, "risk_on").when((F.col("ema_short") < F.col("ema_long")) & ~calm, "risk_off").otherwise("neutral")
    return s.select(label.alias("label"), "ema_short", "ema_long", "atr", "atr_percentile", determined_at.alias("determined_at"))


def regime_snapshot(regime: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows to append to ``regime_snapshots``: a classified regime with the next id."""
    next_id = earlier.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("bigint").alias("id"))
    return regime.crossJoin(F.broadcast(next_id)).select(
        "id", "label", F.col("ema_short").alias("btc_ema_short"), F.col("ema_long").alias("btc_ema_long"), F.col("atr").alias("btc_atr_14d"), "atr_percentile", "determined_at"
    )
