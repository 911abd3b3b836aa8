"""Registered queries that run the streams over the given tables.

The rows are fed in parts; the stream runs on all that is there and ends, and a
restart from its checkpoint goes on with the next part.  The SQL is that of the
batch form over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Sell
from ..sources import candles as C
from ..streaming import jobs
from . import catalog as K
from . import fixtures as X
from . import rules_sql as R

query, _bars = K.query, K._bars
#: State partitions of these small runs.
PARTITIONS = 8


def _run(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that a job gives for the parts, each of which is a run of its own."""
    spark, folder = parts[0].sparkSession, C.scratch(parts[0].sparkSession)
    parts[0].limit(0).write.parquet(f"{folder}/in")  # a stream needs its folder
    stream = job(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        writer = jobs.to_files(stream, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True)
        jobs.start(writer, spark, PARTITIONS).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _halves(df: DataFrame, time: str) -> list[DataFrame]:
    late = F.coalesce(F.col(time) >= X.ts("2024-01-16 00:00:00"), F.lit(False))
    return [df.filter(~late), df.filter(late)]


@query(X.with_sql("e1h") + " SELECT symbol, open_time, close FROM e1h")
def stream_first_bars(spark, sf_dir):
    """The second part brings all bars again, with other values for those that are known."""
    bars = _bars(spark, sf_dir, "1h", X.ticks_events)
    first = _halves(bars, "open_time")[0]
    again = bars.join(first.select("symbol", "open_time", F.lit(1.0).alias("known")), ["symbol", "open_time"], "left")
    again = again.withColumn("close", F.col("close") + F.coalesce("known", F.lit(0.0))).select(bars.columns)
    return _run([first, again], jobs.ingest).select("symbol", "open_time", "close")


@query(K._OUTCOMES + " SELECT id, reason, reason IN ('inserted', 'escalated') AS inserted FROM x")
def stream_insert_outcomes(spark, sf_dir):
    return _run(_halves(X.signals(spark, sf_dir), "detected_at"), jobs.insert_signals).select("id", "reason", "inserted")


@query(R.PASSED + " SELECT * FROM passed")
def stream_alert_pass(spark, sf_dir):
    """Signals arrive up to two days late; a last row of another symbol lets the stream pass the end."""
    s = X.signals(spark, sf_dir).filter("severity is not null").select("id", "symbol", "detected_at", "severity", "score")
    s = s.withColumn("arrived_at", F.timestamp_add("DAY", (F.col("id") % 3).cast("int"), "detected_at"))
    end = s.agg(F.timestamp_add("DAY", F.lit(30), F.max("detected_at")).alias("detected_at"))
    end = end.select(F.lit(-1).cast("bigint").alias("id"), F.lit("").alias("symbol"), "detected_at", F.lit("normal").alias("severity"), F.lit(0).alias("score"))
    parts = [p.drop("arrived_at") for p in _halves(s, "arrived_at")] + [end]
    return _run(parts, lambda stream: jobs.alert(stream, delivered=F.col("id") % 7 != 0, delay="3 days"))


_SCANS = f"""WITH RECURSIVE cand AS (
  SELECT event_type || '-' || (user_id % 40) AS symbol, time_bucket(INTERVAL 12 HOUR, ts) + INTERVAL 12 HOUR AS tm,
    arg_max(CAST(30 + (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) * 7) % 31 AS INTEGER), event_id) AS score, max(event_id) AS signal_id FROM events GROUP BY 1, 2
), q AS (SELECT *, signal_id % 2 = 0 AS inserted, row_number() OVER (PARTITION BY symbol ORDER BY tm) AS n FROM cand),
walk AS (
  SELECT DISTINCT symbol, 0::BIGINT AS n, NULL::TIMESTAMP AS f, NULL::TIMESTAMP AS l, NULL::INTEGER AS s FROM q
  UNION ALL
  SELECT symbol, n, CASE WHEN act = 'WATCH' THEN coalesce(f, tm) WHEN act = 'STAY' THEN f END, CASE WHEN act = 'WATCH' THEN tm WHEN act = 'STAY' THEN l END,
    CASE WHEN act = 'WATCH' THEN score WHEN act = 'STAY' THEN s END
  FROM (SELECT q.symbol, q.n, q.tm, q.score, CASE WHEN w.l + INTERVAL 48 HOUR > q.tm THEN w.f END AS f, w.l, w.s,
    CASE WHEN q.score >= 50 THEN CASE WHEN q.inserted THEN 'PROMOTE' ELSE 'STAY' END WHEN q.score < 35 THEN 'EXPIRE' ELSE 'WATCH' END AS act
    FROM walk w JOIN q ON q.symbol = w.symbol AND q.n = w.n + 1)
),
steps AS (SELECT w.*, q.tm, q.score, q.signal_id, q.inserted, w.l + INTERVAL 48 HOUR > q.tm AS live FROM walk w JOIN q ON q.symbol = w.symbol AND q.n = w.n + 1 WHERE w.f IS NOT NULL),
ended AS (
  SELECT symbol, f, l, s, 'expired' AS status, 'expired_stale' AS reason, NULL::BIGINT AS signal_id, NULL::TIMESTAMP AS resolved_at FROM steps WHERE NOT live
  UNION ALL SELECT symbol, f, l, s, 'expired', 'below_floor', NULL, tm FROM steps WHERE live AND score < 35
  UNION ALL SELECT symbol, f, l, s, 'promoted', 'promoted', signal_id, tm FROM steps WHERE live AND score >= 50 AND inserted
),
last AS (SELECT w.*, w.l + INTERVAL 48 HOUR <= (SELECT max(tm) FROM q) AS stale FROM walk w JOIN (SELECT symbol, max(n) AS n FROM q GROUP BY symbol) USING (symbol, n) WHERE w.f IS NOT NULL)
SELECT symbol, f AS first_seen_at, l AS last_seen_at, s AS last_score, status, reason AS resolution_reason, signal_id AS promoted_signal_id, resolved_at FROM ended
UNION ALL SELECT symbol, f, l, s, CASE WHEN stale THEN 'expired' ELSE 'watching' END, CASE WHEN stale THEN 'expired_stale' END, NULL, NULL FROM last"""


@query(_SCANS)
def stream_watchlist(spark, sf_dir):
    """Scans every twelve hours; when a stale watch was noticed is left out, as that depends on the parts."""
    e = X.table(spark, sf_dir, "events")
    symbol = F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 40).cast("string"))
    score = (30 + (X._digits(F.col("props")) * 7) % 31).cast("int")
    at = F.timestamp_add("HOUR", F.lit(12), X._start(F.col("ts"), 12 * 3600))
    scans = e.groupBy(symbol.alias("symbol"), at.alias("scanned_at")).agg(F.max_by(score, "event_id").alias("score"), F.max("event_id").alias("signal_id"))
    scans = scans.withColumns({"inserted": F.col("signal_id") % 2 == 0, "severity": F.lit(None).cast("string")})
    w = jobs.watch_table(_run(_halves(scans, "scanned_at"), jobs.watch))
    told = F.when(F.col("resolution_reason") != "expired_stale", F.col("resolved_at")).alias("resolved_at")
    return w.select("symbol", "first_seen_at", "last_seen_at", "last_score", "status", "resolution_reason", "promoted_signal_id", told)


@query(
    X.with_sql("buys", "e1d").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, j AS (SELECT b.id, b.price, e.close, e.close_time AS tm, max(greatest(b.price, e.close)) OVER (PARTITION BY b.id ORDER BY e.close_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm
  FROM buys b JOIN e1d e ON b.symbol = e.symbol AND e.close_time >= b.bought_at AND (b.sold_at IS NULL OR e.close_time < b.sold_at)),
r AS (SELECT *, CASE WHEN price <= 0 OR close <= 0 THEN NULL WHEN close <= price * 0.92 THEN 'stop_loss' WHEN wm > 0 AND close <= wm * 0.9 THEN 'trailing_stop' WHEN close >= price * 1.2 THEN 'take_profit' WHEN (close - price) / price < 0 THEN 'context_deterioration' END AS rule FROM j),
f AS (SELECT *, row_number() OVER (PARTITION BY id, rule ORDER BY tm) AS n FROM r WHERE rule IS NOT NULL),
walk AS (
  SELECT DISTINCT id, rule, 0::BIGINT AS n, NULL::TIMESTAMP AS last, false AS fired FROM f
  UNION ALL SELECT f.id, f.rule, f.n, CASE WHEN w.last IS NULL OR f.tm - w.last >= INTERVAL 60 HOUR THEN f.tm ELSE w.last END, w.last IS NULL OR f.tm - w.last >= INTERVAL 60 HOUR
  FROM walk w JOIN f ON f.id = w.id AND f.rule = w.rule AND f.n = w.n + 1
)
SELECT id AS buy_id, last AS detected_at, rule AS rule_triggered FROM walk WHERE fired"""
)
def stream_sells(spark, sf_dir):
    """A scan at the close of each day, with a cooldown of 60 hours."""
    closes = _bars(spark, sf_dir, "1d", X.ticks_events).select("symbol", "close", "close_time")
    regime = spark.createDataFrame([("risk_off",)], "label string")
    job = lambda stream: jobs.sells(stream, X.buys(spark, sf_dir), Sell(cooldown_hours=60), regime)
    return _run(_halves(closes, "close_time"), job).select("buy_id", "detected_at", "rule_triggered")
