"""Win rate, expectancy and profit factor over evaluated signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["count", "win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "avg_mfe", "avg_mae", "avg_time_to_mfe", "avg_time_to_mae"]


def evaluation_rows(signals: DataFrame, evaluations: DataFrame, now: Column, scope_days: int | None = None) -> DataFrame:
    """Evaluations with what is reported on of their signals."""
    s = signals if scope_days is None else signals.filter(F.col("detected_at") >= F.timestamp_add("DAY", F.lit(-scope_days), now))
    s = s.select(F.col("id").alias("signal_id"), "severity", "regime_at_signal", "score", "dominant_trigger_timeframe")
    e = evaluations.select("signal_id", "return_7d_pct", "max_gain_7d_pct", "max_loss_7d_pct", "time_to_mfe_hours", "time_to_mae_hours")
    return e.join(s, "signal_id")


def bucket_metrics() -> list[Column]:
    """The ten metrics as aggregates; returns ignore null, zero is neither win nor loss."""
    r = F.col("return_7d_pct")
    n, wins, losses = F.count(r), F.count_if(r > 0), F.count_if(r < 0)
    avg_win, avg_loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, r))
    sum_win, sum_loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, r))
    share = lambda k, a: F.coalesce(F.try_divide(k, n) * a, F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("count"),
        (F.try_divide(wins, n) * 100).alias("win_rate"),
        avg_win.alias("avg_win"),
        avg_loss.alias("avg_loss"),
        F.when(n > 0, share(wins, avg_win) + share(losses, avg_loss)).alias("expectancy"),
        F.when(losses > 0, F.coalesce(F.try_divide(sum_win, F.abs(sum_loss)), F.lit(0.0))).when((n > 0) & (wins == 0), F.lit(None).cast("double")).alias("profit_factor"),
        F.avg("max_gain_7d_pct").alias("avg_mfe"),
        F.avg("max_loss_7d_pct").alias("avg_mae"),
        F.avg("time_to_mfe_hours").alias("avg_time_to_mfe"),
        F.avg("time_to_mae_hours").alias("avg_time_to_mae"),
    ]


def score_band(score: Column) -> Column:
    return F.when(score.between(50, 64), "50-64").when(score.between(65, 79), "65-79").when(score.between(80, 100), "80-100")


def report(rows: DataFrame, min_signals: int = 5) -> DataFrame:
    """Long form: dimension, bucket and the metrics.

    The overall row is always there; other buckets need ``min_signals`` rows,
    null keys make none.  One aggregate covers all dimensions, so the rows are
    read once.
    """
    keys = {
        "overall": F.lit("all"),
        "severity": F.col("severity"),
        "regime": F.col("regime_at_signal"),
        "trigger": F.col("dominant_trigger_timeframe"),
        "score": score_band(F.col("score")),
    }
    slices = F.array(*[F.struct(F.lit(d).alias("dimension"), k.alias("bucket")) for d, k in keys.items()])
    cut = rows.select("*", F.inline(slices)).filter("bucket is not null").groupBy("dimension", "bucket").agg(*bucket_metrics())
    cut = cut.filter((F.col("count") >= min_signals) | (F.col("dimension") == "overall"))
    always = rows.sparkSession.createDataFrame([("overall", "all")], "dimension string, bucket string")
    return cut.join(always, ["dimension", "bucket"], "full").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
