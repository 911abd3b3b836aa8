"""Weekly summaries, the activity feed and the overview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import expectancy
from .readers import recent


def signals_by_severity(signals: DataFrame, start: Column, end: Column) -> DataFrame:
    inside = (F.col("detected_at") >= start) & (F.col("detected_at") < end)
    return signals.filter(inside).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def top_drop(signals: DataFrame, start: Column, end: Column) -> DataFrame:
    """The largest drop in the window; ties go to the earliest, then the least id."""
    inside = (F.col("detected_at") >= start) & (F.col("detected_at") < end) & F.col("drop_trigger_pct").isNotNull()
    return signals.filter(inside).orderBy(F.desc("drop_trigger_pct"), "detected_at", "id").limit(1).select("id", "symbol", "drop_trigger_pct")


def count_buys(buys: DataFrame, start: Column, end: Column) -> DataFrame:
    return buys.filter((F.col("bought_at") >= start) & (F.col("bought_at") < end)).agg(F.count(F.lit(1)).alias("n"))


def verdict_histogram(signal_evaluations: DataFrame, buy_evaluations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Verdicts given in the window, over both tables."""
    pick = lambda t: t.filter((F.col("evaluated_at") >= start) & (F.col("evaluated_at") < end) & F.col("verdict").isNotNull()).select("verdict")
    return pick(signal_evaluations).unionAll(pick(buy_evaluations)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _cross(frames: list[DataFrame]) -> DataFrame:
    """One row from frames of one row each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def digest(report: DataFrame, min_rows: int = 5) -> DataFrame:
    """One line on the overall bucket."""
    line = F.concat(
        F.concat_ws(
            " · ",
            F.concat(F.lit("WR "), S.fixed(F.col("win_rate"), 1), F.lit("%")),
            F.concat(F.lit("exp "), S.signed_pct(F.col("expectancy"))),
            F.concat(F.lit("PF "), S.fixed(F.col("profit_factor"), 2)),
        ),
        F.lit(" — "),
        F.col("count").cast("string"),
        F.lit(" sinais"),
    )
    short = (F.col("count") < min_rows) | F.col("win_rate").isNull()
    return report.filter("dimension = 'overall'").select(F.when(short, "Análise: dados insuficientes").otherwise(line).alias("analytics_line"))


def conclusion(n: Column, very_strong: Column, strong: Column) -> Column:
    return (
        F.when(n == 0, "Leitura rápida: sem oportunidades nesta semana.")
        .when(very_strong > 0, "Leitura rápida: houve sinal forte de compra nesta semana.")
        .when(strong > 0, "Leitura rápida: sinais moderados — vale acompanhar.")
        .otherwise("Leitura rápida: apenas sinais fracos, sem urgência.")
    )


def weekly_summary(
    signals: DataFrame, buys: DataFrame, signal_evaluations: DataFrame, buy_evaluations: DataFrame, report: DataFrame, now: Column, days: int = 7, debug: bool = False
) -> DataFrame:
    """One row over [now - days, now) with counts, the top drop and the message.

    One conditional aggregate per source table; the window is a filter, so it
    reaches the scans.
    """
    if days <= 0:
        raise ValueError("the window must have days")
    start = F.timestamp_add("DAY", F.lit(-days), now)
    tell = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    drop = F.col("drop_trigger_pct")
    best = F.min_by(F.struct("symbol", "drop_trigger_pct"), F.when(drop.isNotNull(), F.struct(-drop, F.col("detected_at"), F.col("id"))))
    found = signals.filter((F.col("detected_at") >= start) & (F.col("detected_at") < now))
    found = found.agg(F.count(F.lit(1)).alias("signal_count"), *[tell(s) for s in ("very_strong", "strong", "normal")], best.alias("b"))
    found = found.select("*", F.col("b.symbol").alias("top_drop_symbol"), F.col("b.drop_trigger_pct").alias("top_drop_pct")).drop("b")
    hist = verdict_histogram(signal_evaluations, buy_evaluations, start, now)
    of = lambda *v: F.coalesce(F.sum(F.when(F.col("verdict").isin(*v), F.col("n"))), F.lit(0))
    verdicts = hist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matured_count"), of("great", "good").alias("n_good"), of("neutral").alias("n_neutral"), of("poor", "bad").alias("n_bad")
    )
    row = _cross([found, count_buys(buys, start, now).withColumnRenamed("n", "buy_count"), verdicts, digest(report)])
    row = row.withColumn("week_start", start).withColumn("week_end", now)
    c = F.col
    some = lambda n, text: F.when(c(n) > 0, F.concat(F.lit(text), c(n).cast("string")))
    matured = lambda n, text: F.when(c("matured_count") > 0, some(n, text))
    day = lambda n: F.date_format(c(n), "yyyy-MM-dd")
    raw = [
        F.lit("\n--- debug ---"),
        F.concat(F.lit("window="), day("week_start"), F.lit(" → "), day("week_end")),
        F.concat(F.lit("signal_count="), c("signal_count").cast("string")),
        F.concat(F.lit("top_drop="), c("top_drop_symbol"), F.lit(" "), S.plain(c("top_drop_pct"))),
        F.concat(F.lit("buy_count="), c("buy_count").cast("string")),
        F.concat(F.lit("matured="), c("matured_count").cast("string")),
    ]
    body = F.concat_ws(
        "\n",
        F.lit("📊 Resumo da semana"),
        F.lit(""),
        F.when(c("signal_count") == 0, "Sinais emitidos: 0 (semana tranquila)").otherwise(F.concat(F.lit("Sinais emitidos: "), c("signal_count").cast("string"))),
        some("n_very_strong", "  🟢 Críticos: "),
        some("n_strong", "  🟡 Fortes: "),
        some("n_normal", "  🟠 Normais: "),
        F.concat(F.lit("Maior queda: "), S.friendly_name(c("top_drop_symbol")), F.lit(" (-"), S.fixed(c("top_drop_pct"), 1), F.lit("%)")),
        some("buy_count", "\nCompras registradas: "),
        some("matured_count", "\nAvaliações vencidas: "),
        matured("n_good", "  ✅ Boas: "),
        matured("n_neutral", "  ⚠️ Neutras: "),
        matured("n_bad", "  ❌ Ruins: "),
        F.lit(""),
        conclusion(c("signal_count"), c("n_very_strong"), c("n_strong")),
        F.lit("\n📈 Análise (90d)"),
        c("analytics_line"),
        *(raw if debug else []),
    )
    dates = [F.lit(" ("), day("week_start"), F.lit(" → "), day("week_end"), F.lit(")")] if debug else []
    title = F.concat(F.lit("Resumo semanal — "), S.day_month(c("week_start")), F.lit(" a "), S.day_month(c("week_end")), *dates)
    return row.withColumn("title", title).withColumn("body", body).withColumn("sent", F.lit(False))


def mark_sent(summaries: DataFrame, delivered: DataFrame) -> DataFrame:
    """Summaries with ``sent`` set where the delivery table has the id."""
    d = delivered.filter("ok").select(F.col("id").alias("_id")).distinct()
    return summaries.join(d, F.col("id") == F.col("_id"), "left").withColumn("sent", F.col("sent") | F.col("_id").isNotNull()).drop("_id")


def activity(signals: DataFrame, sells: DataFrame, n: int = 10) -> DataFrame:
    """Newest n of both tables by time; of equal times signals come first.

    The headline tells severity and score, or rule and result, where the
    tables have them.
    """
    has = lambda t, c, kind: F.col(c) if c in t.columns else F.lit(None).cast(kind)
    said = F.concat(F.coalesce(has(signals, "severity", "string"), F.lit("below_threshold")), F.lit(" score="), has(signals, "score", "int").cast("string"))
    sold = F.concat(has(sells, "rule_triggered", "string"), F.coalesce(F.concat(F.lit(" "), S.signed_pct(has(sells, "pnl_pct", "double"))), F.lit("")))
    a = recent(signals, "detected_at", n).select(F.lit("signal").alias("kind"), "id", "symbol", F.col("detected_at").alias("at"), F.lit(0).alias("rank"), said.alias("headline"))
    b = recent(sells, "detected_at", n).select(F.lit("sell").alias("kind"), "id", "symbol", F.col("detected_at").alias("at"), F.lit(1).alias("rank"), sold.alias("headline"))
    return a.unionAll(b).orderBy(F.desc("at"), "rank", F.desc("id")).limit(n).drop("rank")


def overview(signals: DataFrame, sells: DataFrame, watchlist: DataFrame, buys: DataFrame, regimes: DataFrame, evaluations: DataFrame, now: Column, scope_days: int = 90) -> DataFrame:
    """One row of headline figures; the metrics are over signals of the last ``scope_days``."""
    ago = lambda d: F.timestamp_add("DAY", F.lit(-d), now)
    at, n = F.col("detected_at"), F.count(F.lit(1))
    s = signals.filter(at >= ago(7)).agg(F.count_if(at >= ago(1)).alias("signals_24h"), n.alias("signals_7d"))
    e = sells.filter(at >= ago(7)).agg(n.alias("sells_7d"))
    w = watchlist.filter("status = 'watching'").agg(n.alias("active_watches"))
    b = buys.filter("sold_at is null").agg(n.alias("open_buys"))
    r = regimes.agg(F.max_by(F.struct("label", "determined_at", "atr_percentile"), "id").alias("r"))
    r = r.select(F.col("r.label").alias("regime"), F.col("r.determined_at").alias("regime_at"), F.col("r.atr_percentile").alias("atr_percentile"))
    rows = expectancy.evaluation_rows(signals, evaluations, now, scope_days)
    x = rows.agg(*expectancy.bucket_metrics()).select(F.col("count").alias("evaluated"), "win_rate", "expectancy", "profit_factor")
    return _cross([s, e, w, b, r, x])


def scan_counters(scored: DataFrame) -> DataFrame:
    """Candidates of a scan: all, those under the threshold, and symbols."""
    return scored.agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("severity").isNull()).alias("below_threshold"), F.countDistinct("symbol").alias("symbols"))


def _act(name: str) -> Column:
    return F.coalesce(F.col("action") == name, F.lit(False))


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _reason(*names: str) -> Column:
    return F.count_if(F.coalesce(F.col("reason").isin(*names), F.lit(False)))


def counters() -> dict[str, dict[str, Column]]:
    """Counters of a scan by the result that they are counted in.

    Seeded symbols; the flushed queue (with ``tried``); new bars; outcomes of
    candidates; alert decisions; judged positions; sell signals with their sends
    (``alerted``); watch actions; the watchlist as ``stale`` or not.
    """
    return {
        "seeding": {"symbols_seeded": F.count(F.lit(1))},
        "flush": {
            "flush_sent": F.count_if(_yes("tried") & _yes("delivered")),
            "flush_failed": F.count_if(_yes("tried") & ~_yes("delivered")),
            "flush_waiting": F.count_if(_yes("queued")),
        },
        "ingest": {"ingested": F.count(F.lit(1))},
        "outcomes": {
            "scored": F.count(F.lit(1)),
            "inserted": F.count_if(_yes("inserted")),
            "escalated": _reason("escalated"),
            "duplicates": _reason("duplicate"),
            "superseded": _reason("superseded"),
            "below_threshold": _reason("below_threshold"),
        },
        "alerts": {
            "sent": F.count_if(_act("send_now") & _yes("ok")),
            "queued": F.count_if(_act("queue")),
            "cooldown": F.count_if(_act("skip_cooldown")),
            "failed": F.count_if(_act("send_now") & ~_yes("ok")),
        },
        "positions": {
            "positions": F.count(F.lit(1)),
            "sell_evaluated": F.count_if(~_yes("no_price")),
            "sell_cooldown": F.count_if(_yes("suppressed")),
            "no_price": F.count_if(_yes("no_price")),
        },
        "sells": {"sell_emitted": F.count(F.lit(1)), "sell_sent": F.count_if(_yes("alerted")), "sell_failed": F.count_if(~_yes("alerted"))},
        "watches": {
            "watched": F.count_if(_act("WATCH")),
            "promoted": F.count_if(_act("PROMOTE") & _yes("inserted")),
            "expired": F.count_if(_act("EXPIRE")),
            "ignored": F.count_if(_act("IGNORE")),
        },
        "stale": {"expired_stale": F.count_if(_yes("stale"))},
    }


class ScanCounters:
    """Counters of a scan, observed while its results are written.

    ``of`` wraps a result before it is written or otherwise used; the counts come
    with that job, so nothing is read or computed for them again.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def of(self, part: str, df: DataFrame) -> DataFrame:
        """``df``, counted as ``part`` (see ``counters``) when it is first used."""
        self.seen[part] = Observation(part)
        return df.observe(self.seen[part], *[c.alias(n) for n, c in counters()[part].items()])

    def row(self) -> dict[str, int]:
        """All counters; those of parts that took no part in the scan are 0.  Waits for results that aren't used yet."""
        out = {}
        for part, names in counters().items():
            got = self.seen[part].get if part in self.seen else {}
            out |= {n: int(got.get(n, 0)) for n in names}
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(self.row().values())], ", ".join(f"{n} bigint" for n in self.row()))


def maintenance_report(signal_report: DataFrame, buy_report: DataFrame, retention: DataFrame) -> DataFrame:
    """One row: evaluated and skipped signals and buys, and candles beyond their caps."""
    name = lambda df, kind: df.select(F.col("evaluated").alias(f"{kind}_evaluated"), F.col("skipped").alias(f"{kind}_pending"))
    return _cross([name(signal_report, "signals"), name(buy_report, "buys"), retention.agg(F.coalesce(F.sum("n_deleted"), F.lit(0)).alias("pruned"))])
