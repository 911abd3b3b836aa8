"""Further registered queries: watchlist, queue, readers, messages, reports and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import indicators as I
from ..functions import recurrences
from ..functions import scalars as S
from ..operators import alerts, evaluation, readers, reports, scoring, transitions
from ..params import RETENTION
from ..sources import bar_table
from ..sources import candles as C
from . import catalog as K
from . import fixtures as X
from . import rules_sql as R

query, NOW, _bars, _round = K.query, K.NOW, K._bars, K._round

# --- watchlist ---------------------------------------------------------------

_MANY = "event_type || '-' || (user_id % 40)"
#: Candidates by symbol and user group, and a watchlist of two thirds of them.
_WATCH = f""", cand AS (SELECT {_MANY} AS symbol, arg_max(CAST(30 + (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) * 7) % 31 AS INTEGER), event_id) AS score, max(event_id) AS signal_id, max(event_id) % 2 = 0 AS inserted, any_value(user_id % 40) AS u FROM events GROUP BY 1),
list0 AS (SELECT u * 10 + length(symbol) AS id, symbol, CASE u % 3 WHEN 0 THEN 'watching' ELSE 'promoted' END AS status, 40 AS last_score, TIMESTAMP '2024-03-01' + to_hours(CAST(u - 20 AS BIGINT)) AS expires_at FROM cand WHERE u % 3 < 2),
list1 AS (SELECT *, status = 'watching' AND expires_at <= TIMESTAMP '2024-03-01' AS stale FROM list0),
live AS (SELECT * FROM list1 WHERE status = 'watching' AND NOT stale),
act AS (SELECT c.*, l.symbol IS NOT NULL AS has_watch, CASE WHEN c.score >= 50 THEN 'PROMOTE' WHEN c.score < 35 THEN CASE WHEN l.symbol IS NOT NULL THEN 'EXPIRE' ELSE 'IGNORE' END ELSE 'WATCH' END AS action FROM cand c LEFT JOIN live l USING (symbol))"""


def _candidates(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    symbol = F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 40).cast("string"))
    score = (30 + (X._digits(F.col("props")) * 7) % 31).cast("int")
    c = e.groupBy(symbol.alias("symbol")).agg(F.max_by(score, "event_id").alias("score"), F.max("event_id").alias("signal_id"), F.max(F.col("user_id") % 40).alias("u"))
    return c.withColumns({"inserted": F.col("signal_id") % 2 == 0, "severity": F.lit(None).cast("string")})


def _watchlist(spark, sf_dir):
    c, none = _candidates(spark, sf_dir).filter("u % 3 < 2"), F.lit(None)
    now = X.ts(NOW)
    return c.select(
        (F.col("u") * 10 + F.length("symbol")).cast("bigint").alias("id"),
        "symbol",
        F.when(F.col("u") % 3 == 0, "watching").otherwise("promoted").alias("status"),
        X.ts("2024-02-01 00:00:00").alias("first_seen_at"),
        X.ts("2024-02-01 00:00:00").alias("last_seen_at"),
        F.lit(40).alias("last_score"),
        F.timestamp_add("HOUR", (F.col("u") - 20).cast("int"), now).alias("expires_at"),
        none.cast("bigint").alias("promoted_signal_id"),
        none.cast("timestamp_ntz").alias("resolved_at"),
        none.cast("string").alias("resolution_reason"),
    )


def _watch_pass(spark, sf_dir):
    now = X.ts(NOW)
    return transitions.watch_pass(transitions.expire_stale(_watchlist(spark, sf_dir), now), _candidates(spark, sf_dir).drop("u"), now)


@query("WITH x AS (SELECT 1)" + _WATCH + " SELECT symbol, score, action, has_watch FROM act")
def watch_candidates(spark, sf_dir):
    a = _watch_pass(spark, sf_dir)[0]
    return a.select("symbol", "score", "action", F.col("has_watch").isNotNull().alias("has_watch"))


@query(
    "WITH x AS (SELECT 1)"
    + _WATCH
    + """, old AS (SELECT l.*, a.action AS act, a.score, a.signal_id, a.inserted, l.status = 'watching' AND NOT stale AS alive FROM list1 l LEFT JOIN act a USING (symbol))
SELECT symbol, CASE WHEN stale THEN 'expired' WHEN alive AND act = 'PROMOTE' AND inserted THEN 'promoted' WHEN alive AND act = 'EXPIRE' THEN 'expired' ELSE status END AS status,
  CASE WHEN alive AND act = 'WATCH' THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-02-01' END AS last_seen_at, CASE WHEN alive AND act = 'WATCH' THEN score ELSE last_score END AS last_score,
  CASE WHEN alive AND act = 'WATCH' THEN TIMESTAMP '2024-03-03' ELSE expires_at END AS expires_at, CASE WHEN alive AND act = 'PROMOTE' AND inserted THEN signal_id END AS promoted_signal_id,
  CASE WHEN stale OR alive AND (act = 'EXPIRE' OR act = 'PROMOTE' AND inserted) THEN TIMESTAMP '2024-03-01' END AS resolved_at,
  CASE WHEN stale THEN 'expired_stale' WHEN alive AND act = 'PROMOTE' AND inserted THEN 'promoted' WHEN alive AND act = 'EXPIRE' THEN 'below_floor' END AS resolution_reason FROM old
UNION ALL SELECT symbol, 'watching', TIMESTAMP '2024-03-01', score, TIMESTAMP '2024-03-03', NULL, NULL, NULL FROM act WHERE action = 'WATCH' AND NOT has_watch"""
)
def watchlist_after_scan(spark, sf_dir):
    w = _watch_pass(spark, sf_dir)[1]
    return w.select("symbol", "status", "last_seen_at", "last_score", "expires_at", "promoted_signal_id", "resolved_at", "resolution_reason")


@query("WITH x AS (SELECT 1)" + _WATCH + " SELECT id, symbol FROM list0 WHERE status = 'watching'")
def active_watches(spark, sf_dir):
    return readers.watching(_watchlist(spark, sf_dir)).select("id", "symbol")


@query(X.with_sql("signals") + " SELECT id, CASE WHEN score >= 80 THEN 'very_strong' WHEN score >= 65 THEN 'strong' WHEN score >= 50 THEN 'normal' END AS severity FROM signals")
def promoted_severities(spark, sf_dir):
    return X.signals(spark, sf_dir).select("id", transitions.promoted_severity(F.col("score")).alias("severity"))


# --- alerts ------------------------------------------------------------------


def _notifications(spark, sf_dir):
    """A notification of every signal; two thirds are delivered, some are queued."""
    s, third = X.signals(spark, sf_dir), F.col("id") % 3
    return s.select(
        (F.col("id") + 1000).alias("id"),
        F.col("detected_at").alias("created_at"),
        F.when(third > 0, F.timestamp_add("MINUTE", F.lit(1), "detected_at")).alias("sent_at"),
        F.col("id").alias("signal_id"),
        (third == 0).alias("queued"),
        (third > 0).alias("delivered"),
        F.when(third > 0, 1).otherwise(0).alias("delivery_attempts"),
        F.lit(None).cast("string").alias("last_error"),
    )


def _flushed(spark, sf_dir, now, with_tried=False):
    n = _notifications(spark, sf_dir)
    tried = n.filter("queued and (id - 1000) % 5 < 4")
    r = tried.select("id", ((F.col("id") - 1000) % 5 < 3).alias("ok"), F.when((F.col("id") - 1000) % 5 == 3, "timeout").alias("error"))
    return alerts.flush_queue(n, r, now, with_tried=with_tried)


@query(X.with_sql("signals") + " SELECT symbol, max(detected_at) + INTERVAL 1 MINUTE AS sent_at, arg_max(score, (detected_at, id)) AS score FROM signals WHERE id % 3 > 0 GROUP BY symbol")
def prior_alerts(spark, sf_dir):
    return alerts.prior_alerts(_notifications(spark, sf_dir), X.signals(spark, sf_dir))


@query(R.PASSED + " SELECT symbol, max(now) AS sent_at FROM passed WHERE action = 'send_now' AND ok GROUP BY symbol")
def last_sends(spark, sf_dir):
    return alerts.last_sent(K._pass(spark, sf_dir)[1])


@query(
    """SELECT event_id + 1000 AS id, event_id % 3 > 0 OR event_id % 5 < 3 AS delivered, event_id % 3 = 0 AND event_id % 5 >= 3 AS queued,
  CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 1 MINUTE WHEN event_id % 5 < 3 THEN TIMESTAMP '2024-03-01 15:00:00' END AS sent_at,
  CASE WHEN event_id % 3 > 0 THEN 1 WHEN event_id % 5 < 4 THEN 1 ELSE 0 END AS delivery_attempts, CASE WHEN event_id % 3 = 0 AND event_id % 5 = 3 THEN 'timeout' END AS last_error FROM events"""
)
def queue_flush(spark, sf_dir):
    """Of five queued rows three are delivered, one fails and one has no result."""
    return _flushed(spark, sf_dir, X.ts("2024-03-01 15:00:00")).select("id", "delivered", "queued", "sent_at", "delivery_attempts", "last_error")


@query("SELECT event_id + 1000 AS id, event_id % 3 > 0 AS delivered, event_id % 3 = 0 AS queued FROM events")
def queue_flush_in_quiet_hours(spark, sf_dir):
    n = _notifications(spark, sf_dir)
    r = n.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return alerts.flush_queue(n, r, X.ts("2024-03-01 02:00:00")).select("id", "delivered", "queued")


@query(
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'chart,money' WHEN 1 THEN 'chart,money,' || event_type WHEN 2 THEN 'chart,money,' || event_type || ',x' ELSE 'chart,money' END AS tags FROM events"""
)
def merged_tags(spark, sf_dir):
    k, kind = F.col("event_id") % 4, F.col("event_type")
    more = F.when(k == 0, "money").when(k == 1, F.concat(kind, F.lit(", chart"))).when(k == 2, F.concat(F.lit(",money,"), kind, F.lit(",x,"), kind))
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), alerts.merge_tags(F.lit("chart,money"), more).alias("tags"))


_SOLD = (
    X.with_sql("buys")
    + """, sells AS (SELECT id, symbol || CASE WHEN id % 2 = 0 THEN 'USDT' ELSE '' END AS symbol, price * 1.25 AS price_at_signal, CASE WHEN id % 5 > 0 THEN price - 50 END AS pnl_pct, ['stop_loss', 'trailing_stop', 'take_profit', 'context_deterioration', 'other'][id % 5 + 1] AS rule_triggered,
  CASE id % 3 WHEN 0 THEN 'why ' || id WHEN 1 THEN '' END AS reason, ['risk_on', 'risk_off', 'neutral'][id % 3 + 1] AS regime_at_signal, CASE WHEN id % 5 = 0 THEN 'high' WHEN id % 5 < 4 THEN 'medium' END AS severity FROM buys)"""
)


@query(_SOLD + f" SELECT id, {R.SELL_TITLE} AS title, {R.SELL_BODY} AS body, CASE severity WHEN 'high' THEN 'max' WHEN 'medium' THEN 'high' ELSE 'default' END AS priority FROM sells")
def sell_messages(spark, sf_dir):
    c = F.col
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (c("id") % n).cast("int"))
    s = X.buys(spark, sf_dir).select(
        "id",
        F.concat("symbol", F.when(c("id") % 2 == 0, "USDT").otherwise("")).alias("symbol"),
        (c("price") * 1.25).alias("price_at_signal"),
        F.when(c("id") % 5 > 0, c("price") - 50).alias("pnl_pct"),
        pick(("stop_loss", "trailing_stop", "take_profit", "context_deterioration", "other"), 5).alias("rule_triggered"),
        F.when(c("id") % 3 == 0, F.concat(F.lit("why "), c("id").cast("string"))).when(c("id") % 3 == 1, "").alias("reason"),
        pick(("risk_on", "risk_off", "neutral"), 3).alias("regime_at_signal"),
        F.when(c("id") % 5 == 0, "high").when(c("id") % 5 < 4, "medium").alias("severity"),
    )
    return s.select("id", alerts.sell_title(c("symbol"), c("rule_triggered")).alias("title"), alerts.sell_body().alias("body"), alerts.sell_priority(c("severity")).alias("priority"))


# --- readers -----------------------------------------------------------------


@query("SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN ('click', 'view')")
def scored_symbols(spark, sf_dir):
    """Active symbols without the reference of the regime."""
    known = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct().withColumn("active", F.col("symbol") != "click")
    return C.active_symbols(known, "view").select("symbol")


@query(X.with_sql("buys") + " SELECT * EXCLUDE (rn) FROM (SELECT id, bought_at, price, row_number() OVER (ORDER BY bought_at, id) AS rn FROM buys WHERE sold_at IS NOT NULL AND symbol = 'purchase') WHERE rn BETWEEN 11 AND 60")
def sold_buys_page(spark, sf_dir):
    return readers.buys(X.buys(spark, sf_dir), "sold", "purchase", 50, 10).select("id", "bought_at", "price")


@query(
    X.with_sql("buys") + " SELECT 'all' AS status, count(*) AS n FROM buys UNION ALL SELECT 'open', count(*) FROM buys WHERE sold_at IS NULL UNION ALL SELECT 'sold', count(*) FROM buys WHERE sold_at IS NOT NULL"
)
def buy_counts(spark, sf_dir):
    b = X.buys(spark, sf_dir)
    return evaluation.union_all([readers.count_buys(b, s).select(F.lit(s).alias("status"), "n") for s in ("all", "open", "sold")])


@query(X.with_sql("buys") + " SELECT id, price FROM buys WHERE id = (SELECT min(id) FROM buys)")
def buy_by_id(spark, sf_dir):
    b = X.buys(spark, sf_dir)
    first = b.agg(F.min("id")).first()[0]  # one number
    return readers.by_id(b, "id", first).select("id", "price")


def _regimes(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    label = F.when(F.col("user_id") % 3 == 0, "risk_on").when(F.col("user_id") % 3 == 1, "risk_off").otherwise("neutral")
    return e.select(F.col("event_id").alias("id"), label.alias("label"), F.col("ts").alias("determined_at"))


@query("SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'risk_on' WHEN 1 THEN 'risk_off' ELSE 'neutral' END AS label, ts AS determined_at FROM events ORDER BY event_id DESC LIMIT 50")
def regime_history(spark, sf_dir):
    return readers.latest_by_id(_regimes(spark, sf_dir), 50)


def _summaries(spark, sf_dir):
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    e = X.table(spark, sf_dir, "events").groupBy("event_type", week.alias("week_start")).agg(F.max("event_id").alias("id"), F.count(F.lit(1)).alias("signal_count"))
    return e.withColumns({"week_end": F.timestamp_add("DAY", F.lit(7), "week_start"), "sent": F.col("id") % 4 == 0})


_SUMMARIES = "WITH s AS (SELECT event_type, max(event_id) AS id, count(*) AS signal_count, date_trunc('week', ts) + INTERVAL 7 DAY AS week_end, max(event_id) % 4 = 0 AS sent FROM events GROUP BY event_type, date_trunc('week', ts))"


@query(_SUMMARIES + " SELECT id, week_end, signal_count FROM s ORDER BY week_end DESC, id DESC LIMIT 20")
def weekly_summaries_list(spark, sf_dir):
    return readers.weekly_list(_summaries(spark, sf_dir)).select("id", "week_end", "signal_count")


@query(_SUMMARIES + " SELECT id, sent OR id % 3 = 0 AS sent FROM s")
def sent_summaries(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    results = s.filter("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("ok"))
    return reports.mark_sent(s, results).select("id", "sent")


@query(X.with_sql("e1h", "e1d") + " SELECT DISTINCT symbol, interval FROM (SELECT symbol, interval FROM e1h UNION ALL SELECT symbol, interval FROM e1d)")
def tracked_pairs(spark, sf_dir):
    return C.tracked_pairs(_bars(spark, sf_dir, "1h", X.ticks_events).unionByName(_bars(spark, sf_dir, "1d", X.ticks_events)))


# --- scalars and indicators --------------------------------------------------


@query(
    """WITH t AS (SELECT event_id AS id, ts, value, ['BTCUSDT', 'USDT', 'ABCUSDT', 'ETHBTC', upper(event_type) || 'USDT'][event_id % 5 + 1] AS symbol FROM events)
SELECT id, CASE WHEN ends_with(symbol, 'USDT') AND length(symbol) > 4 THEN left(symbol, length(symbol) - 4) ELSE symbol END AS name,
  CASE WHEN value - 50 > 0 THEN '+' ELSE '' END || printf('%.2f', value - 50) || '%' AS pct, format('{:g}', value * 1000) AS price, date_trunc('second', ts) AS at FROM t"""
)
def names_and_numbers(spark, sf_dir):
    e, c = X.table(spark, sf_dir, "events"), F.col
    symbols = F.array(*map(F.lit, ("BTCUSDT", "USDT", "ABCUSDT", "ETHBTC")), F.concat(F.upper("event_type"), F.lit("USDT")))
    return e.select(
        c("event_id").alias("id"),
        S.friendly_name(F.get(symbols, (c("event_id") % 5).cast("int"))).alias("name"),
        S.signed_pct(c("value") - 50).alias("pct"),
        S.general(c("value") * 1000).alias("price"),
        S.from_utc_iso(S.utc_iso(c("ts"))).alias("at"),
    )


@query(
    X.with_sql("o1h")
    + ", l AS (SELECT symbol, list(close ORDER BY open_time) AS c FROM (SELECT * FROM o1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 250) GROUP BY symbol)"
    + """ SELECT symbol, i AS n, round(list_reduce(c[21:i], lambda a, x: (x - a) * (2.0 / 21) + a, list_sum(c[:20]) / 20), 6) AS ema FROM (SELECT symbol, c, unnest(range(20, len(c) + 1)) AS i FROM l)"""
)
def ema_of_newest_bars(spark, sf_dir):
    a = C.bar_arrays(_bars(spark, sf_dir))
    e = a.select("symbol", F.posexplode(I.ema_series(I.field(F.col("bars"), "close"), 20)).alias("n", "ema"))
    return _round(e.select("symbol", (F.col("n") + 20).cast("bigint").alias("n"), "ema"))


@query(
    X.with_sql("o1h", "o4h", "o1d")
    + R.REGIME
    + " SELECT (SELECT max(event_id) FROM events) + 1 AS id, label, round(ema_short, 6) AS btc_ema_short, round(ema_long, 6) AS btc_ema_long, round(atr, 6) AS btc_atr_14d, round(atr_percentile, 6) AS atr_percentile, TIMESTAMP '2024-03-01' AS determined_at FROM regime"
)
def regime_snapshot(spark, sf_dir):
    regime = scoring.classify_regime(C.bar_arrays(_bars(spark, sf_dir, "1d")), "1-URGENT", X.ts(NOW))
    new = scoring.regime_snapshot(regime, _regimes(spark, sf_dir))
    path = C.scratch(spark)
    C.write_table(new, path, "regime_snapshots")
    return _round(spark.read.schema(schemas.TABLES["regime_snapshots"]).parquet(path))


# --- tables and reports ------------------------------------------------------


@query(X.with_sql("e1h", "e1d") + " SELECT symbol, interval, open_time, close FROM e1h UNION ALL SELECT symbol, interval, open_time, close FROM e1d")
def candles_table_round_trip(spark, sf_dir):
    bars = _bars(spark, sf_dir, "1h", X.ticks_events).unionByName(_bars(spark, sf_dir, "1d", X.ticks_events))
    path = C.scratch(spark)
    C.write_table(bars, path, "candles")
    return spark.read.parquet(path).select("symbol", "interval", "open_time", "close")


def _first_matured(signals):
    return signals.filter(F.col("candle_hour") < X.ts("2024-01-25 00:00:00")).agg(F.min("id")).first()[0]  # one number


@query(
    K._SIGNAL_EVAL
    + " SELECT signal_id, verdict, round(return_7d_pct, 6) AS return_7d_pct, round(max_gain_7d_pct, 6) AS max_gain_7d_pct, time_to_mfe_hours FROM evaluations WHERE signal_id = (SELECT min(id) FROM signals WHERE candle_hour < TIMESTAMP '2024-01-25')"
)
def evaluate_one_signal(spark, sf_dir):
    s = X.signals(spark, sf_dir)
    e = evaluation.evaluate_signals(s, K._no_evaluations(spark, "signal_id"), _bars(spark, sf_dir, "1h", X.ticks_events), X.ts(NOW), only=_first_matured(s))
    return _round(e.select("signal_id", "verdict", "return_7d_pct", "max_gain_7d_pct", "time_to_mfe_hours"))


@query(K._BUY_EVAL + f" SELECT buy_id, {K._VERDICT} AS verdict, round(r7, 6) AS return_7d_pct FROM be WHERE buy_id = (SELECT min(id) FROM buys)")
def evaluate_one_buy(spark, sf_dir):
    b = X.buys(spark, sf_dir)
    first = b.agg(F.min("id")).first()[0]  # one number
    e = evaluation.evaluate_buys(b, K._no_evaluations(spark, "buy_id"), _bars(spark, sf_dir, "1h", X.ticks_events), X.ts(NOW), only=first)
    return _round(e.select("buy_id", "verdict", "return_7d_pct"))


@query(
    R.PASSED
    + ", "
    + X.SQL["buys"]
    + ", "
    + X.SQL["ticks_events"]
    + ", "
    + X.SQL["e1h"]
    + _WATCH
    + f""", o AS (SELECT CASE severity WHEN 'very_strong' THEN 3 WHEN 'strong' THEN 2 WHEN 'normal' THEN 1 END AS k, max(CASE severity WHEN 'very_strong' THEN 3 WHEN 'strong' THEN 2 WHEN 'normal' THEN 1 END) OVER (PARTITION BY symbol, candle_hour ORDER BY detected_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM signals),
cl AS (SELECT symbol, arg_max(close, open_time) AS close FROM e1h GROUP BY symbol),
jj AS (SELECT b.*, cl.close, CASE WHEN b.id % 2 = 0 THEN b.price * 1.1 END AS wm, (cl.close - b.price) / b.price * 100 AS pnl FROM buys b LEFT JOIN cl USING (symbol) WHERE sold_at IS NULL),
rr AS (SELECT *, CASE WHEN price > 0 THEN CASE WHEN close <= price * 0.92 THEN 'stop_loss' WHEN wm > 0 AND close <= wm * 0.9 THEN 'trailing_stop' WHEN close >= price * 1.2 THEN 'take_profit' WHEN pnl < 0 THEN 'context_deterioration' END END AS rule FROM jj)
, oo AS (SELECT CASE WHEN k IS NULL THEN 'below_threshold' WHEN m IS NULL THEN 'inserted' WHEN m = k THEN 'duplicate' WHEN m > k THEN 'superseded' ELSE 'escalated' END AS reason FROM o),
em AS (SELECT * FROM rr WHERE rule IS NOT NULL AND NOT (rule = 'stop_loss' AND id % 5 = 0))
SELECT (SELECT count(DISTINCT event_type) FROM events WHERE event_type <> 'click') AS symbols_seeded,
  (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 5 < 3) AS flush_sent, (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 5 = 3) AS flush_failed, (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 5 >= 3) AS flush_waiting,
  (SELECT count(*) FROM e1h) AS ingested, (SELECT count(*) FROM signals) AS scored, (SELECT count(*) FROM o WHERE k IS NOT NULL AND (m IS NULL OR m < k)) AS inserted,
  (SELECT count(*) FROM oo WHERE reason = 'escalated') AS escalated, (SELECT count(*) FROM oo WHERE reason = 'duplicate') AS duplicates, (SELECT count(*) FROM oo WHERE reason = 'superseded') AS superseded, (SELECT count(*) FROM oo WHERE reason = 'below_threshold') AS below_threshold,
  (SELECT count(*) FROM passed WHERE action = 'send_now' AND ok) AS sent, (SELECT count(*) FROM passed WHERE action = 'queue') AS queued, (SELECT count(*) FROM passed WHERE action = 'skip_cooldown') AS cooldown, (SELECT count(*) FROM passed WHERE action = 'send_now' AND NOT ok) AS failed,
  (SELECT count(*) FROM rr) AS positions, (SELECT count(*) FROM rr WHERE close > 0) AS sell_evaluated, (SELECT count(*) FROM rr WHERE rule = 'stop_loss' AND id % 5 = 0) AS sell_cooldown, (SELECT count(*) FROM rr WHERE close IS NULL) AS no_price,
  (SELECT count(*) FROM em) AS sell_emitted, (SELECT count(*) FROM em WHERE id % 7 <> 0) AS sell_sent, (SELECT count(*) FROM em WHERE id % 7 = 0) AS sell_failed,
  (SELECT count(*) FROM act WHERE action = 'WATCH') AS watched, (SELECT count(*) FROM act WHERE action = 'PROMOTE' AND inserted) AS promoted, (SELECT count(*) FROM act WHERE action = 'EXPIRE') AS expired, (SELECT count(*) FROM act WHERE action = 'IGNORE') AS ignored,
  (SELECT count(*) FROM list1 WHERE stale) AS expired_stale"""
)
def scan_report(spark, sf_dir):
    """Counters observed while a scan writes its results, here to the noop sink."""
    seen, now, e = reports.ScanCounters(), X.ts(NOW), X.table(spark, sf_dir, "events")
    known = spark.createDataFrame([("click",)], "symbol string")
    stale = transitions.expire_stale(_watchlist(spark, sf_dir), now)
    judged, sells, _ = K._sell_parts(spark, sf_dir)
    results = {
        "seeding": C.seed_symbols(known, e.select(F.col("event_type").alias("symbol")), now),
        "flush": _flushed(spark, sf_dir, X.ts("2024-03-01 15:00:00"), True),
        "ingest": _bars(spark, sf_dir, "1h", X.ticks_events),
        "outcomes": transitions.insert_outcomes(X.signals(spark, sf_dir)),
        "alerts": K._pass(spark, sf_dir)[1],
        "positions": judged,
        "sells": alerts.sent_sells(sells, sells.select("id", (F.col("buy_id") % 7 != 0).alias("ok"))),
        "watches": _watch_pass(spark, sf_dir)[0],
        "stale": stale.withColumn("stale", (F.col("resolution_reason") == "expired_stale") & (F.col("resolved_at") == now)),
    }
    for part, result in results.items():
        seen.of(part, result).write.format("noop").mode("overwrite").save()
    return seen.report(spark)


@query(
    K._SELL
    + """, em AS (SELECT id AS b FROM r WHERE rule IS NOT NULL AND NOT (rule = 'stop_loss' AND id % 5 = 0))"""
    + " SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id, count(DISTINCT id) AS ids, count(*) FILTER (alerted) AS alerted FROM (SELECT 700 + row_number() OVER (ORDER BY b) AS id, b % 7 <> 0 AS alerted FROM em)"
)
def sell_signal_ids(spark, sf_dir):
    """Ids of new sell signals go on from the earlier ones, and sends are marked by them."""
    _, sells, _ = K._sell_parts(spark, sf_dir, first_id=700)
    sent = alerts.sent_sells(sells, sells.select("id", (F.col("buy_id") % 7 != 0).alias("ok")))
    return sent.agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"), F.count_if("alerted").alias("alerted")
    )


@query(
    X.with_sql("e1h")
    + """ SELECT (SELECT count(*) FROM events WHERE event_id % 4 <> 0 AND date_trunc('hour', ts) + INTERVAL 30 DAY <= TIMESTAMP '2024-02-20') AS signals_evaluated, (SELECT count(*) FROM events WHERE event_id % 4 <> 0 AND date_trunc('hour', ts) + INTERVAL 30 DAY > TIMESTAMP '2024-02-20') AS signals_pending,
  (SELECT count(*) FROM events WHERE event_type = 'purchase' AND ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-20') AS buys_evaluated, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-20') AS buys_pending,
  (SELECT count(*) FROM (SELECT 1 FROM e1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) > 2160)) AS pruned"""
)
def maintenance_report(spark, sf_dir):
    s, b, bars, now = X.signals(spark, sf_dir), X.buys(spark, sf_dir), _bars(spark, sf_dir, "1h", X.ticks_events), X.ts("2024-02-20 00:00:00")
    done, none = s.filter("id % 4 = 0").select(F.col("id").alias("signal_id")), K._no_evaluations(spark, "buy_id")
    one = evaluation.evaluation_report(s, done, evaluation.evaluate_signals(s, done, bars, now), "signal_id")
    two = evaluation.evaluation_report(b, none, evaluation.evaluate_buys(b, none, bars, now), "buy_id")
    return reports.maintenance_report(one, two, C.retention_report(bars, RETENTION))


# --- rows behind the counts --------------------------------------------------


@query(
    X.with_sql("e1h")
    + " SELECT symbol, open_time, close FROM e1h WHERE close_time <= TIMESTAMP '2024-01-20 00:00:00' AND open_time > (SELECT max(open_time) FROM e1h x WHERE x.symbol = e1h.symbol AND x.open_time < TIMESTAMP '2024-01-10')"
)
def first_rows_of_new_bars(spark, sf_dir):
    """Every new bar arrives twice with different closes; the first arrival stays."""
    all_bars = _bars(spark, sf_dir, "1h", X.ticks_events)
    old = all_bars.filter(F.col("open_time") < X.ts("2024-01-10 00:00:00"))
    twice = all_bars.filter(F.col("close_time") <= X.ts("2024-01-20 00:00:00")).withColumn("arrival", F.explode(F.array(F.lit(2), F.lit(1))))
    twice = twice.withColumn("close", F.col("close") + F.col("arrival") - 1)
    state = C.advance_state(schemas.empty(spark, "processing_state"), old)
    return C.new_bars(C.incremental(twice, state, X.ts("2024-01-20 00:00:00")), old, "arrival").select("symbol", "open_time", "close")


@query(
    X.with_sql("e1h")
    + """ SELECT symbol, open_time, close FROM e1h WHERE symbol = 'click' AND open_time > TIMESTAMP '2024-01-10'
UNION ALL SELECT symbol, open_time, close FROM (SELECT * FROM e1h WHERE symbol NOT IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 250)"""
)
def incremental_and_cold_start(spark, sf_dir):
    """One symbol has a mark, one has a mark in the future, the others take their newest bars."""
    state = spark.createDataFrame([("click", "1h", "2024-01-10 00:00:00"), ("view", "1h", "2025-01-01 00:00:00")], "symbol string, interval string, at string")
    state = state.select("symbol", "interval", F.col("at").cast("timestamp_ntz").alias("last_open_time"))
    return C.incremental(_bars(spark, sf_dir, "1h", X.ticks_events), state, X.ts("2024-03-01 00:00:00")).select("symbol", "open_time", "close")


_SPLIT = "CASE " + " ".join(f"WHEN ends_with(s, '{q}') AND length(s) > {len(q)} THEN '{q}'" for q in S.QUOTES) + " END"


@query(
    f"""WITH t AS (SELECT event_id AS id, upper(left(event_type, CAST(1 + event_id % 4 AS INTEGER))) || [{', '.join(f"'{q}'" for q in (*S.QUOTES, 'XYZ', ''))}][event_id % 13 + 1] AS s FROM events),
k AS (SELECT id, s, {_SPLIT} AS q FROM t)
SELECT id, CASE WHEN q IS NOT NULL THEN left(s, length(s) - length(q)) ELSE left(s, 3) END AS base, coalesce(q, substr(s, 4)) AS quote FROM k"""
)
def split_symbols(spark, sf_dir):
    tails = F.array(*map(F.lit, (*S.QUOTES, "XYZ", "")))
    head = F.upper(F.substring("event_type", F.lit(1), (1 + F.col("event_id") % 4).cast("int")))
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(head, F.get(tails, (F.col("event_id") % 13).cast("int"))).alias("s"))
    return e.select("id", S.split_symbol(F.col("s")).alias("p")).select("id", "p.base", "p.quote")


@query(
    K._SELL
    + """ SELECT id AS buy_id, symbol, TIMESTAMP '2024-03-01' AS detected_at, round(close, 6) AS price_at_signal, rule AS rule_triggered, 'risk_off' AS regime_at_signal, false AS alerted
FROM r WHERE rule IS NOT NULL AND NOT (rule = 'stop_loss' AND id % 5 = 0)"""
)
def sell_signal_rows(spark, sf_dir):
    rows = K._sell_parts(spark, sf_dir)[1]
    return _round(rows.select("buy_id", "symbol", "detected_at", "price_at_signal", "rule_triggered", "regime_at_signal", "alerted"))


@query(
    X.with_sql("buys")
    + """, s AS (SELECT id AS buy_id, bought_at + to_days(CAST(id % 5 - 1 AS INTEGER)) AS t, price * (id % 4) AS p FROM buys)
SELECT b.id, CASE WHEN b.sold_at IS NULL AND p > 0 AND t >= b.bought_at THEN t ELSE b.sold_at END AS sold_at, CASE WHEN b.sold_at IS NULL AND p > 0 AND t >= b.bought_at THEN round(p, 6) END AS sold_price FROM buys b LEFT JOIN s ON s.buy_id = b.id"""
)
def stamped_sales(spark, sf_dir):
    b = X.buys(spark, sf_dir).withColumns({"sold_price": F.lit(None).cast("double"), "sold_note": F.lit(None).cast("string")})
    days = (F.col("id") % 5 - 1).cast("int")
    sales = b.select(F.col("id").alias("buy_id"), F.timestamp_add("DAY", days, "bought_at").alias("sold_at"), (F.col("price") * (F.col("id") % 4)).alias("sold_price"), F.lit(None).cast("string").alias("sold_note"))
    return _round(transitions.record_sales(b, sales)[0].select("id", "sold_at", "sold_price"))


# --- folds over whole histories ---------------------------------------------------

_FOLD = "CASE WHEN q.n < {m} THEN w.{v} + {x} WHEN q.n = {m} THEN (w.{v} + {x}) / {p} ELSE (w.{v} * ({p} - 1) + {x}) / {p} END"
_EMA = "CASE WHEN q.n < {m} THEN w.{v} + q.close WHEN q.n = {m} THEN (w.{v} + q.close) / {p} ELSE (q.close - w.{v}) * 2.0 / ({p} + 1) + w.{v} END"


@query(
    X.with_sql("o1h").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", q AS (SELECT symbol, open_time, close, row_number() OVER o - 1 AS n, greatest(close - lag(close) OVER o, 0) AS up, greatest(lag(close) OVER o - close, 0) AS down,
  greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0)) AS tr FROM o1h WINDOW o AS (PARTITION BY symbol ORDER BY open_time)),
walk AS (
  SELECT symbol, n, open_time, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, tr AS a, close AS e20, close AS e50 FROM q WHERE n = 0
  UNION ALL
  SELECT q.symbol, q.n, q.open_time, {_FOLD.format(v="g", x="q.up", m=14, p=14)}, {_FOLD.format(v="l", x="q.down", m=14, p=14)}, {_FOLD.format(v="a", x="q.tr", m=13, p=14)},
    {_EMA.format(v="e20", m=19, p=20)}, {_EMA.format(v="e50", m=49, p=50)}
  FROM walk w JOIN q ON q.symbol = w.symbol AND q.n = w.n + 1
)
SELECT symbol, open_time, round(CASE WHEN n < 14 THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi,
  round(CASE WHEN n >= 13 THEN a END, 6) AS atr, round(CASE WHEN n >= 19 THEN e20 END, 6) AS ema_20, round(CASE WHEN n >= 49 THEN e50 END, 6) AS ema_50 FROM walk"""
)
def indicator_history(spark, sf_dir):
    return _round(recurrences.indicator_history(_bars(spark, sf_dir)).drop("interval"))


# --- the stored table of candles ----------------------------------------------------


def _bar_table(spark, rows):
    """A table of its own in the shared folder with all ``rows``."""
    folder = C.scratch(spark)
    base = "tidemark_" + folder.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {base} LOCATION '{folder}'")
    bar_table.create(spark, f"{base}.bars")
    bar_table.insert(spark, f"{base}.bars", rows)
    return f"{base}.bars"


@query(X.with_sql("e1h") + " SELECT symbol, interval, open_time, close FROM e1h WHERE open_time >= TIMESTAMP '2024-01-16' AND symbol < 'p' OR open_time >= TIMESTAMP '2024-01-20'")
def new_bars_of_stored_table(spark, sf_dir):
    """Bars of a batch that a table, which ends earlier for some symbols, does not have."""
    bars = _bars(spark, sf_dir, "1h", X.ticks_events)
    have = bars.filter((F.col("open_time") < X.ts("2024-01-16 00:00:00")) | (F.col("symbol") >= "p") & (F.col("open_time") < X.ts("2024-01-20 00:00:00")))
    table = _bar_table(spark, have)
    return bar_table.fresh(spark, table, bars).select("symbol", "interval", "open_time", "close")


@query(
    X.with_sql("o1h", "o4h", "o1d")
    + """, a AS (SELECT * FROM o1h UNION ALL SELECT * FROM o4h UNION ALL SELECT * FROM o1d)
SELECT symbol, interval, open_time, close FROM a QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY open_time DESC) <= CASE interval WHEN '1h' THEN 100 WHEN '4h' THEN 60 ELSE 1000000000 END"""
)
def stored_table_after_retention(spark, sf_dir):
    table = _bar_table(spark, X.all_candles(X.ticks_orders(spark, sf_dir)))
    bar_table.retain(spark, table, {"1h": 100, "4h": 60, "1d": 0})
    return spark.table(table).select("symbol", "interval", "open_time", "close")
