"""Registered queries, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import scalars as S
from ..operators import alerts, evaluation, expectancy, readers, reports, scoring, transitions
from ..params import RETENTION, Regime, Sell
from .. import schemas
from ..sources import candles as C
from . import fixtures as X
from . import rules_sql as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-03-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum can't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _bars(spark, sf_dir, interval="1h", ticks=X.ticks_orders):
    return X.candles(ticks(spark, sf_dir), interval)


# --- candles ---------------------------------------------------------------


@query(X.with_sql("o1h", "o4h", "o1d") + " SELECT * FROM o1h UNION ALL SELECT * FROM o4h UNION ALL SELECT * FROM o1d")
def candles_all_intervals(spark, sf_dir):
    return X.all_candles(X.ticks_orders(spark, sf_dir))


@query(X.with_sql("e1h") + " SELECT * FROM e1h")
def candles_from_events(spark, sf_dir):
    return _bars(spark, sf_dir, "1h", X.ticks_events)


@query(X.with_sql("e1h") + " SELECT symbol, interval, open_time, close FROM e1h QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY open_time DESC) <= 250")
def latest_250_bars(spark, sf_dir):
    return C.latest_bars(_bars(spark, sf_dir, "1h", X.ticks_events)).select("symbol", "interval", "open_time", "close")


@query(
    X.with_sql("o1h", "o4h", "o1d")
    + """, c AS (SELECT * FROM o1h UNION ALL SELECT * FROM o4h UNION ALL SELECT * FROM o1d),
r AS (SELECT interval, row_number() OVER (PARTITION BY symbol, interval ORDER BY open_time DESC) <= CASE interval WHEN '1h' THEN 2160 WHEN '4h' THEN 1080 ELSE 400 END AS keep FROM c)
SELECT interval, count(*) FILTER (NOT keep) AS n_deleted, count(*) FILTER (keep) AS n_kept FROM r GROUP BY interval"""
)
def candle_retention(spark, sf_dir):
    return C.retention_report(X.all_candles(X.ticks_orders(spark, sf_dir)), RETENTION)


def _raw_klines(spark, sf_dir):
    """Hourly bars as raw rows; every fifth hour comes twice."""
    b = _bars(spark, sf_dir, "1h", X.ticks_events)
    ms = lambda c: S.second_to_millis(F.col(c)).cast("string")
    k = F.array(ms("open_time"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")], ms("close_time"))
    twice = F.when((S.second_to_millis(F.col("open_time")) / 3600000) % 5 == 0, 2).otherwise(1)
    return b.select("symbol", "interval", k.alias("k"), F.explode(F.sequence(F.lit(1), twice)).alias("copy")).drop("copy")


@query(
    X.with_sql("e1h")
    + """, c AS (SELECT *, CASE WHEN (epoch(open_time) // 3600) % 5 = 0 THEN 2 ELSE 1 END AS copies FROM e1h WHERE close_time <= TIMESTAMP '2024-01-20 00:00:00'),
s AS (SELECT symbol, interval, max(open_time) AS mark FROM e1h WHERE open_time < TIMESTAMP '2024-01-10' GROUP BY ALL),
n AS (SELECT c.symbol, c.interval FROM c JOIN s USING (symbol, interval) WHERE c.open_time > s.mark)
SELECT symbol, interval, count(*) AS n_new FROM n GROUP BY symbol, interval UNION ALL SELECT NULL, NULL, count(*) FROM n"""
)
def candle_ingest_report(spark, sf_dir):
    now = X.ts("2024-01-20 00:00:00")
    bars = C.typed(C.closed_bars(C.parse_klines(_raw_klines(spark, sf_dir)).filter(~F.col("bad")), S.second_to_millis(now)))
    old = _bars(spark, sf_dir, "1h", X.ticks_events).filter(F.col("open_time") < X.ts("2024-01-10 00:00:00"))
    state = C.advance_state(spark.createDataFrame([], "symbol string, interval string, last_open_time timestamp_ntz"), old)
    return C.ingest_report(C.new_bars(C.incremental(bars, state, now), old))


@query(
    X.with_sql("e1h")
    + " SELECT symbol, interval, max(open_time) AS last_open_time FROM e1h WHERE close_time <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY symbol, interval"
)
def ingest_watermarks(spark, sf_dir):
    bars = C.typed(C.closed_bars(C.parse_klines(_raw_klines(spark, sf_dir)), S.second_to_millis(X.ts("2024-01-20 00:00:00"))))
    state = bars.filter(F.col("open_time") < X.ts("2024-01-05 00:00:00")).groupBy("symbol", "interval").agg(F.max("open_time").alias("last_open_time"))
    return C.advance_state(state, bars)


@query(
    """WITH s AS (SELECT DISTINCT upper(event_type) || CASE WHEN length(event_type) % 2 = 0 THEN 'USDT' ELSE 'XYZ' END AS symbol FROM events)
SELECT symbol, CASE WHEN ends_with(symbol, 'USDT') THEN left(symbol, length(symbol) - 4) ELSE left(symbol, 3) END AS base,
  CASE WHEN ends_with(symbol, 'USDT') THEN 'USDT' ELSE substr(symbol, 4) END AS quote, true AS active FROM s WHERE symbol <> 'CLICKXYZ'"""
)
def symbol_seeding(spark, sf_dir):
    tail = F.when(F.length("event_type") % 2 == 0, "USDT").otherwise("XYZ")
    wanted = X.table(spark, sf_dir, "events").select(F.concat(F.upper("event_type"), tail).alias("symbol")).distinct()
    known = spark.createDataFrame([("CLICKXYZ",)], "symbol string")
    return C.seed_symbols(known, wanted, X.ts(NOW)).drop("added_at")


# --- indicators on every bar -----------------------------------------------

_W = "(PARTITION BY symbol ORDER BY open_time"


@query(
    X.with_sql("o1h")
    + f"""SELECT symbol, open_time,
  CASE WHEN count(*) OVER {_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 AND avg(volume) OVER {_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) > 0
    THEN round(volume / avg(volume) OVER {_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) END AS rel_volume,
  round(max(high) OVER {_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS high_30,
  coalesce(count(*) OVER {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10 AND close > max(high) OVER {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) AS reclaim,
  round(CASE WHEN lag(close, 24) OVER {_W}) > 0 THEN greatest((lag(close, 24) OVER {_W}) - close) / lag(close, 24) OVER {_W}) * 100, 0) END, 6) AS drop_24h,
  round(greatest(high - low, coalesce(abs(high - lag(close) OVER {_W})), 0), coalesce(abs(low - lag(close) OVER {_W})), 0)), 6) AS true_range
FROM o1h"""
)
def rolling_indicators(spark, sf_dir):
    w = Window.partitionBy("symbol", "interval", "block").orderBy("open_time")
    before = lambda n: w.rowsBetween(-n, -1)
    c = F.col
    volume = F.avg("volume").over(before(20))
    tr = F.greatest(c("high") - c("low"), F.abs(c("high") - F.lag("close").over(w)), F.abs(c("low") - F.lag("close").over(w)))
    rows = C.in_blocks(_bars(spark, sf_dir), 30).select(
        "own",
        "symbol",
        "open_time",
        F.when((F.count("*").over(before(20)) == 20) & (volume > 0), c("volume") / volume).alias("rel_volume"),
        F.max("high").over(w.rowsBetween(-29, 0)).alias("high_30"),
        F.coalesce((F.count("*").over(before(10)) == 10) & (c("close") > F.max("high").over(before(10))), F.lit(False)).alias("reclaim"),
        S.positive_drop(F.lag("close", 24).over(w), c("close")).alias("drop_24h"),
        tr.alias("true_range"),
    )
    return _round(rows.filter("own").drop("own"))


@query(
    X.with_sql("o1h")
    + f""", p AS (SELECT *, lag(open) OVER {_W}) AS po, lag(close) OVER {_W}) AS pc FROM o1h)
SELECT symbol, open_time, CASE
  WHEN abs(close - open) > 0 AND high > low AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.25 * (high - low) THEN 'hammer'
  WHEN pc < po AND close > open AND open <= pc AND close >= po THEN 'bullish_engulfing'
  WHEN high > low AND abs(close - open) / (high - low) <= 0.10 THEN 'doji' END AS pattern FROM p"""
)
def reversal_patterns(spark, sf_dir):
    w = Window.partitionBy("symbol", "interval", "block").orderBy("open_time").rowsBetween(-1, 0)
    bars = F.collect_list(F.struct("open", "high", "low", "close")).over(w)
    return C.in_blocks(_bars(spark, sf_dir), 1).withColumn("bars", bars).filter("own").select("symbol", "open_time", I.reversal(F.col("bars")).alias("pattern"))


_LAST = """, l AS (SELECT symbol, list(struct_pack(open, high, low, close, volume) ORDER BY open_time) AS b FROM
  (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 250) GROUP BY symbol)"""


@query(
    X.with_sql("o1h")
    + _LAST.format(t="o1h")
    + """, d AS (SELECT symbol, b, len(b) AS n, list_transform(range(2, len(b) + 1), lambda i: b[i].close - b[i - 1].close) AS d,
  list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i = 1 THEN b[i].high - b[i].low ELSE greatest(b[i].high - b[i].low, abs(b[i].high - b[i - 1].close), abs(b[i].low - b[i - 1].close)) END) AS tr,
  list_transform(b, lambda x: x.close) AS c FROM l),
f AS (SELECT symbol, n,
  list_reduce(list_transform(d[15:], lambda x: greatest(x, 0.0)), lambda a, x: (a * 13 + x) / 14, list_sum(list_transform(d[:14], lambda x: greatest(x, 0.0))) / 14) AS g,
  list_reduce(list_transform(d[15:], lambda x: greatest(-x, 0.0)), lambda a, x: (a * 13 + x) / 14, list_sum(list_transform(d[:14], lambda x: greatest(-x, 0.0))) / 14) AS l,
  list_reduce(tr[15:], lambda a, x: (a * 13 + x) / 14, list_sum(tr[:14]) / 14) AS atr,
  list_reduce(c[21:], lambda a, x: (x - a) * (2.0 / 21) + a, list_sum(c[:20]) / 20) AS e20,
  list_reduce(c[51:], lambda a, x: (x - a) * (2.0 / 51) + a, list_sum(c[:50]) / 50) AS e50 FROM d)
SELECT symbol, round(CASE WHEN n < 15 THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi,
  round(CASE WHEN n >= 14 THEN atr END, 6) AS atr, round(CASE WHEN n >= 20 THEN e20 END, 6) AS ema_20, round(CASE WHEN n >= 50 THEN e50 END, 6) AS ema_50,
  CASE WHEN n < 50 THEN 'sideways' WHEN (e20 - e50) / e50 * 100 > 1 THEN 'uptrend' WHEN (e20 - e50) / e50 * 100 < -1 THEN 'downtrend' ELSE 'sideways' END AS trend FROM f"""
)
def wilder_indicators(spark, sf_dir):
    a = C.bar_arrays(_bars(spark, sf_dir)).withColumn("closes", I.field(F.col("bars"), "close"))
    c = F.col("closes")
    return _round(
        a.select(
            "symbol", I.rsi(c).alias("rsi"), I.atr(F.col("bars")).alias("atr"), I.ema(c, 20).alias("ema_20"), I.ema(c, 50).alias("ema_50"), I.trend_label(c).alias("trend")
        )
    )


@query(
    X.with_sql("o1d")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k, last_value(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS price,
  max(high) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS h30, max(high) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS h180 FROM o1d),
n AS (SELECT *, min(low) OVER w1 AS l1, count(*) OVER w1 AS n1, min(low) OVER w2 AS l2, count(*) OVER w2 AS n2 FROM r WHERE k <= 90
  WINDOW w1 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
s AS (SELECT symbol, max(low) AS support FROM n WHERE n1 = 3 AND n2 = 3 AND low < l1 AND low < l2 AND low <= price GROUP BY symbol)
SELECT r.symbol, round(r.price, 6) AS price, round(s.support, 6) AS support, round((r.price - s.support) / s.support * 100, 6) AS distance_pct,
  round(greatest((h30 - price) / h30 * 100, 0), 6) AS discount_30d, round(greatest((h180 - price) / h180 * 100, 0), 6) AS discount_180d
FROM r LEFT JOIN s USING (symbol) WHERE k = 1"""
)
def support_and_discounts(spark, sf_dir):
    a = C.bar_arrays(_bars(spark, sf_dir, "1d"))
    price = F.element_at("bars", -1)["close"]
    high = lambda n: F.array_max(I.field(I.last_n(F.col("bars"), n), "high"))
    a = a.select("symbol", price.alias("price"), I.support(F.col("bars"), price).alias("s"), high(30).alias("h30"), high(180).alias("h180"))
    discount = lambda h: S.positive_drop(F.col(h), F.col("price"))
    return _round(
        a.select("symbol", "price", F.col("s.price").alias("support"), F.col("s.distance_pct").alias("distance_pct"), discount("h30").alias("discount_30d"), discount("h180").alias("discount_180d"))
    )


@query(
    X.with_sql("o1h")
    + ", "
    + R.rsi("r", "SELECT symbol, open_time AS k, list(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS c FROM o1h")
    + " SELECT symbol, k AS open_time, round(v, 6) AS rsi FROM r"
)
def rsi_on_every_bar(spark, sf_dir):
    return _round(C.rsi_of_bars(_bars(spark, sf_dir)).select("symbol", "open_time", "rsi"))


@query(
    X.with_sql("o1h", "o4h", "o1d")
    + R.REGIME
    + " SELECT label, round(ema_short, 6) AS ema_short, round(ema_long, 6) AS ema_long, round(atr, 6) AS atr, round(atr_percentile, 6) AS atr_percentile, TIMESTAMP '2024-03-01' AS determined_at FROM regime"
)
def market_regime(spark, sf_dir):
    a = C.bar_arrays(_bars(spark, sf_dir, "1d"))
    return _round(scoring.classify_regime(a, "1-URGENT", X.ts(NOW)))


def _scored(spark, sf_dir):
    a = C.bar_arrays(X.all_candles(X.ticks_orders(spark, sf_dir)))
    regime = scoring.classify_regime(a, "1-URGENT", X.ts(NOW))
    return scoring.score_symbols(a, X.ts(NOW), regime=regime, regime_params=Regime(enabled=True))


#: Places in the score's JSON and their names.
_BREAKDOWN = {
    "drop": "drop_magnitude",
    "rsi": "rsi_oversold",
    "volume": "relative_volume",
    "support": "support_distance",
    "discount": "discount_from_high",
    "reversal": "reversal_pattern",
    "trend": "trend_context",
}


@query(X.with_sql("o1h", "o4h", "o1d") + R.SCORED + f" SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in R.SCORED_DOUBLES)}) FROM scored")
def score_symbols(spark, sf_dir):
    s = _scored(spark, sf_dir)
    get = lambda path, kind: F.get_json_object("score_breakdown", f"$.{path}").cast(kind)
    parts = {f"p_{k}": get(f"{v}.points", "int") for k, v in _BREAKDOWN.items()}
    parts |= {"atr_normalized": get("drop_magnitude.atr_normalized", "boolean"), "atr_pct": get("drop_magnitude.atr_pct", "double")}
    return _round(s.withColumns(parts).drop("score_breakdown"))


# --- signals ---------------------------------------------------------------

_RANK = "CASE severity WHEN 'very_strong' THEN 3 WHEN 'strong' THEN 2 WHEN 'normal' THEN 1 END"
_OUTCOMES = (
    X.with_sql("signals")
    + f""", r AS (SELECT id, {_RANK} AS k, max({_RANK}) OVER (PARTITION BY symbol, candle_hour ORDER BY detected_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM signals),
x AS (SELECT id, CASE WHEN k IS NULL THEN 'below_threshold' WHEN m IS NULL THEN 'inserted' WHEN m = k THEN 'duplicate' WHEN m > k THEN 'superseded' ELSE 'escalated' END AS reason FROM r)"""
)


@query(_OUTCOMES + " SELECT id, reason, reason IN ('inserted', 'escalated') AS inserted FROM x")
def signal_insert_outcomes(spark, sf_dir):
    return transitions.insert_outcomes(X.signals(spark, sf_dir)).select("id", "reason", "inserted")


@query(_OUTCOMES + " SELECT reason, count(*) AS n FROM x GROUP BY reason")
def signal_outcome_counts(spark, sf_dir):
    return transitions.outcome_counts(transitions.insert_outcomes(X.signals(spark, sf_dir)))


_PAGE = "severity = 'strong' AND regime_at_signal = 'risk_on' AND detected_at >= TIMESTAMP '2024-01-05' AND detected_at < TIMESTAMP '2024-01-25'"


def _page_filter():
    return readers.signal_filter(severity="strong", regime="risk_on", since=X.ts("2024-01-05 00:00:00"), until=X.ts("2024-01-25 00:00:00"))


@query(X.with_sql("signals") + f" SELECT id, symbol, detected_at, score FROM signals WHERE {_PAGE} ORDER BY detected_at DESC, id DESC LIMIT 50 OFFSET 20")
def signals_page(spark, sf_dir):
    return readers.page(X.signals(spark, sf_dir).filter(_page_filter()).select("id", "symbol", "detected_at", "score"), "detected_at", 50, 20)


@query(
    X.with_sql("signals")
    + f' SELECT count(*) AS total, 50 AS "limit", 20 AS "offset", CASE WHEN 70 < count(*) THEN 70 END AS next_offset FROM signals WHERE {_PAGE}'
)
def signals_page_meta(spark, sf_dir):
    return readers.page_meta(X.signals(spark, sf_dir).filter(_page_filter()), 50, 20)


@query(X.with_sql("signals") + f" SELECT symbol, candle_hour, max({_RANK}) AS max_rank FROM signals GROUP BY ALL")
def signal_max_severity(spark, sf_dir):
    return readers.max_severity(X.signals(spark, sf_dir))


@query(
    X.with_sql("signals")
    + " SELECT severity, count(*) AS n FROM signals WHERE detected_at >= TIMESTAMP '2024-01-08' AND detected_at < TIMESTAMP '2024-01-15' GROUP BY severity"
)
def weekly_signals_by_severity(spark, sf_dir):
    return reports.signals_by_severity(X.signals(spark, sf_dir), X.ts("2024-01-08 00:00:00"), X.ts("2024-01-15 00:00:00"))


@query(
    X.with_sql("signals")
    + """ SELECT id, symbol, drop_trigger_pct FROM signals WHERE detected_at >= TIMESTAMP '2024-01-08' AND detected_at < TIMESTAMP '2024-01-15'
ORDER BY drop_trigger_pct DESC, detected_at, id LIMIT 1"""
)
def weekly_top_drop(spark, sf_dir):
    return reports.top_drop(X.signals(spark, sf_dir), X.ts("2024-01-08 00:00:00"), X.ts("2024-01-15 00:00:00"))


@query(X.with_sql("signals") + " SELECT count(*) AS n FROM signals WHERE detected_at >= TIMESTAMP '2024-01-20'")
def signals_since(spark, sf_dir):
    return readers.count_since(X.signals(spark, sf_dir), "detected_at", X.ts("2024-01-20 00:00:00"))


# --- positions -------------------------------------------------------------


@query(X.with_sql("buys") + " SELECT id, symbol, bought_at, price FROM buys WHERE sold_at IS NULL ORDER BY bought_at, id")
def open_buys(spark, sf_dir):
    return readers.buys(X.buys(spark, sf_dir), "open").select("id", "symbol", "bought_at", "price")


@query(X.with_sql("e1h") + " SELECT symbol, arg_max(close, open_time) AS close, max(open_time) + INTERVAL 3599 SECOND AS close_time FROM e1h GROUP BY symbol")
def latest_closes(spark, sf_dir):
    return readers.latest_close(_bars(spark, sf_dir, "1h", X.ticks_events))


def _sell_parts(spark, sf_dir, first_id=0):
    buys = X.buys(spark, sf_dir)
    closes = _bars(spark, sf_dir, "1h", X.ticks_events).groupBy("symbol").agg(F.max_by("close", "open_time").alias("close"))
    # earlier scans: watermarks 10 % over the entry for every second buy, and stop losses an hour ago for every fifth
    tracking = buys.filter("id % 2 = 0").select("symbol", F.col("id").alias("buy_id"), (F.col("price") * 1.1).alias("high_watermark"), X.ts("2024-02-01 00:00:00").alias("updated_at"))
    fired = buys.filter("id % 5 = 0").select(F.col("id").alias("buy_id"), F.lit("stop_loss").alias("rule_triggered"), X.ts("2024-02-29 23:00:00").alias("detected_at"), F.lit(first_id).cast("bigint").alias("id"))
    return transitions.sell_pass(readers.open_positions(buys), closes, tracking, fired, X.ts(NOW), F.lit("risk_off"), Sell())


_SELL = (
    X.with_sql("buys", "e1h")
    + """, c AS (SELECT symbol, arg_max(close, open_time) AS close FROM e1h GROUP BY symbol),
j AS (SELECT b.*, c.close, CASE WHEN b.id % 2 = 0 THEN b.price * 1.1 END AS wm, (c.close - b.price) / b.price * 100 AS pnl FROM buys b LEFT JOIN c USING (symbol) WHERE sold_at IS NULL),
r AS (SELECT *, CASE WHEN close <= price * 0.92 THEN 'stop_loss' WHEN wm > 0 AND close <= wm * 0.9 THEN 'trailing_stop' WHEN close >= price * 1.2 THEN 'take_profit' WHEN pnl < 0 THEN 'context_deterioration' END AS rule FROM j WHERE price > 0)"""
)


@query(
    _SELL
    + """ SELECT id AS buy_id, rule AS rule_triggered, CASE WHEN rule = 'stop_loss' THEN 'high' ELSE 'medium' END AS severity, round(pnl, 6) AS pnl_pct
FROM r WHERE rule IS NOT NULL AND NOT (rule = 'stop_loss' AND id % 5 = 0)"""
)
def sell_signals(spark, sf_dir):
    return _round(_sell_parts(spark, sf_dir)[1].select("buy_id", "rule_triggered", "severity", "pnl_pct"))


@query(_SELL + " SELECT id AS buy_id, round(greatest(coalesce(wm, price), price, close), 6) AS high_watermark FROM j")
def position_watermarks(spark, sf_dir):
    return _round(_sell_parts(spark, sf_dir)[2].join(readers.open_positions(X.buys(spark, sf_dir)).select(F.col("id").alias("buy_id")), "buy_id", "left_semi").select("buy_id", "high_watermark"))


@query(
    X.with_sql("buys", "e1h")
    + """, j AS (SELECT b.id, e.open_time, b.price, e.close, max(greatest(b.price, e.close)) OVER (PARTITION BY b.id ORDER BY e.open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm
  FROM buys b JOIN e1h e ON b.symbol = e.symbol AND e.open_time >= b.bought_at AND e.open_time < b.bought_at + INTERVAL 3 DAY)
SELECT id, open_time, round(wm, 6) AS watermark, CASE WHEN price <= 0 OR close <= 0 THEN NULL WHEN close <= price * 0.92 THEN 'stop_loss' WHEN wm > 0 AND close <= wm * 0.9 THEN 'trailing_stop' WHEN close >= price * 1.2 THEN 'take_profit' END AS rule FROM j"""
)
def sell_rule_replay(spark, sf_dir):
    bars = _bars(spark, sf_dir, "1h", X.ticks_events)
    return _round(transitions.replay_sells(X.buys(spark, sf_dir), bars, days=3).select("id", "open_time", "watermark", "rule"))


@query(
    X.with_sql("buys", "e1h")
    + """, j AS (SELECT b.id, e.open_time, b.price, e.close, max(greatest(b.price, e.close)) OVER (PARTITION BY b.id ORDER BY e.open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm
  FROM buys b JOIN e1h e ON b.symbol = e.symbol AND e.open_time >= b.bought_at AND (b.sold_at IS NULL OR e.open_time < b.sold_at))
SELECT id, open_time, round(wm, 6) AS watermark, CASE WHEN price <= 0 OR close <= 0 THEN NULL WHEN close <= price * 0.92 THEN 'stop_loss' WHEN wm > 0 AND close <= wm * 0.9 THEN 'trailing_stop' WHEN close >= price * 1.2 THEN 'take_profit' END AS rule FROM j"""
)
def sell_rule_replay_to_sale(spark, sf_dir):
    """The whole life of every position; ``sell_rule_replay`` has the first three days of its SQL."""
    bars = _bars(spark, sf_dir, "1h", X.ticks_events)
    return _round(transitions.replay_sells(X.buys(spark, sf_dir), bars).select("id", "open_time", "watermark", "rule"))


@query(
    X.with_sql("buys", "e1h")
    + """, c AS (SELECT symbol, arg_max(close, open_time) AS close FROM e1h GROUP BY symbol)
SELECT id, symbol, price, CASE WHEN id % 2 = 0 THEN round(price * 1.1, 6) END AS high_watermark, close, round(CASE WHEN price <> 0 THEN (close - price) / price * 100 END, 6) AS pnl_pct,
  round(CASE WHEN id % 2 = 0 AND price <> 0 THEN (close - price * 1.1) / (price * 1.1) * 100 END, 6) AS drawdown_pct FROM buys LEFT JOIN c USING (symbol) WHERE sold_at IS NULL"""
)
def position_monitor(spark, sf_dir):
    buys = readers.open_positions(X.buys(spark, sf_dir))
    tracking = buys.filter("id % 2 = 0").select(F.col("id").alias("buy_id"), (F.col("price") * 1.1).alias("high_watermark"))
    return _round(transitions.monitor(buys, _bars(spark, sf_dir, "1h", X.ticks_events), tracking))


# --- evaluation ------------------------------------------------------------


def _no_evaluations(spark, key):
    return spark.createDataFrame([], f"{key} bigint")


def _asof(n: int, h: str) -> str:
    return f"{h} AS (SELECT d.id, e.close AS p FROM d ASOF LEFT JOIN e1h e ON d.symbol = e.symbol AND d.t0 + INTERVAL {n} HOUR <= e.open_time)"


_VERDICT = "CASE WHEN r7 IS NULL THEN 'pending' WHEN r7 >= 10 THEN 'great' WHEN r7 >= 5 THEN 'good' WHEN r7 <= -10 THEN 'bad' WHEN r7 <= -5 THEN 'poor' ELSE 'neutral' END"
_MFE = """x AS (SELECT d.id, max(e.high) AS hi, min(e.low) AS lo, arg_min((epoch(e.open_time) - epoch(d.t0)) / 3600, (-e.high, e.open_time)) AS th, arg_min((epoch(e.open_time) - epoch(d.t0)) / 3600, (e.low, e.open_time)) AS tl
  FROM d JOIN e1h e ON d.symbol = e.symbol AND e.open_time >= d.t0 AND e.open_time <= d.t0 + INTERVAL 7 DAY GROUP BY d.id)"""
_SIGNAL_EVAL = (
    X.with_sql("signals", "e1h")
    + ", d AS (SELECT id, symbol, candle_hour AS t0, price_at_signal AS base FROM signals WHERE TIMESTAMP '2024-03-01' >= candle_hour + INTERVAL 30 DAY), "
    + ", ".join([_asof(24, "a1"), _asof(168, "a7"), _asof(720, "a30"), _MFE])
    + f""", ev AS (SELECT d.id AS signal_id, base AS price_at_signal, a1.p AS price_24h_later, a7.p AS price_7d_later, a30.p AS price_30d_later,
  CASE WHEN base <> 0 THEN (a1.p - base) / base * 100 END AS return_24h_pct, CASE WHEN base <> 0 THEN (a7.p - base) / base * 100 END AS r7, CASE WHEN base <> 0 THEN (a30.p - base) / base * 100 END AS return_30d_pct,
  CASE WHEN base <> 0 THEN (hi - base) / base * 100 END AS max_gain_7d_pct, CASE WHEN base <> 0 THEN (lo - base) / base * 100 END AS max_loss_7d_pct, th AS time_to_mfe_hours, tl AS time_to_mae_hours
  FROM d LEFT JOIN a1 USING (id) LEFT JOIN a7 USING (id) LEFT JOIN a30 USING (id) LEFT JOIN x USING (id)),
evaluations AS (SELECT * EXCLUDE (r7), r7 AS return_7d_pct, {_VERDICT} AS verdict FROM ev)"""
)


def _signal_evaluations(spark, sf_dir):
    return evaluation.evaluate_signals(X.signals(spark, sf_dir), _no_evaluations(spark, "signal_id"), _bars(spark, sf_dir, "1h", X.ticks_events), X.ts(NOW))


def _rounded(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


@query(
    _SIGNAL_EVAL
    + "SELECT signal_id, verdict, "
    + _rounded("price_at_signal price_24h_later price_7d_later price_30d_later return_24h_pct return_7d_pct return_30d_pct max_gain_7d_pct max_loss_7d_pct time_to_mfe_hours time_to_mae_hours")
    + " FROM evaluations"
)
def evaluate_signals(spark, sf_dir):
    return _round(_signal_evaluations(spark, sf_dir).drop("evaluated_at"))


_BUY_EVAL = (
    X.with_sql("buys", "e1h")
    + ", d AS (SELECT id, symbol, bought_at AS t0, price AS base FROM buys WHERE TIMESTAMP '2024-03-01' >= bought_at + INTERVAL 30 DAY), "
    + ", ".join([_asof(168, "a7"), _asof(720, "a30"), _MFE])
    + """, dl AS (SELECT symbol, date_trunc('day', open_time) AS day, arg_min(open, open_time) AS day_open, min(low) AS day_low, arg_min(open_time, (low, open_time)) AS low_time FROM e1h GROUP BY ALL),
be AS (SELECT d.id AS buy_id, day_open, day_low AS day_low_hourly, low_time AS day_low_hourly_time, CASE WHEN day_open <> 0 THEN (day_low - day_open) / day_open * 100 END AS pct_from_day_open_to_low_hourly,
  CASE WHEN base <> 0 THEN (day_low - base) / base * 100 END AS pct_from_buy_to_low_hourly, CASE WHEN day_low <> 0 THEN (base - day_low) / day_low * 100 END AS buy_vs_day_low_hourly_pct,
  a7.p AS price_7d_later, CASE WHEN base <> 0 THEN (a7.p - base) / base * 100 END AS r7, a30.p AS price_30d_later, CASE WHEN base <> 0 THEN (a30.p - base) / base * 100 END AS return_30d_pct,
  CASE WHEN base <> 0 THEN (hi - base) / base * 100 END AS max_gain_pct, CASE WHEN base <> 0 THEN (lo - base) / base * 100 END AS max_loss_pct, th AS time_to_mfe_hours, tl AS time_to_mae_hours
  FROM d LEFT JOIN dl ON d.symbol = dl.symbol AND date_trunc('day', d.t0) = dl.day LEFT JOIN a7 USING (id) LEFT JOIN a30 USING (id) LEFT JOIN x USING (id))"""
)


@query(
    _BUY_EVAL
    + f"SELECT buy_id, day_low_hourly_time, {_VERDICT} AS verdict, round(r7, 6) AS return_7d_pct, "
    + _rounded(
        "day_open day_low_hourly pct_from_day_open_to_low_hourly pct_from_buy_to_low_hourly buy_vs_day_low_hourly_pct price_7d_later price_30d_later return_30d_pct max_gain_pct max_loss_pct time_to_mfe_hours time_to_mae_hours"
    )
    + " FROM be"
)
def evaluate_buys(spark, sf_dir):
    e = evaluation.evaluate_buys(X.buys(spark, sf_dir), _no_evaluations(spark, "buy_id"), _bars(spark, sf_dir, "1h", X.ticks_events), X.ts(NOW))
    return _round(e.drop("evaluated_at", "resolution_note"))


_METRICS = """count(*) AS "count", count(*) FILTER (r > 0) / nullif(count(r), 0) * 100 AS win_rate, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r < 0) AS avg_loss,
  CASE WHEN count(r) > 0 THEN coalesce(count(*) FILTER (r > 0) / nullif(count(r), 0) * avg(r) FILTER (r > 0), 0) + coalesce(count(*) FILTER (r < 0) / nullif(count(r), 0) * avg(r) FILTER (r < 0), 0) END AS expectancy,
  CASE WHEN count(*) FILTER (r < 0) > 0 THEN coalesce(sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)), 0) END AS profit_factor,
  avg(max_gain_7d_pct) AS avg_mfe, avg(max_loss_7d_pct) AS avg_mae, avg(time_to_mfe_hours) AS avg_time_to_mfe, avg(time_to_mae_hours) AS avg_time_to_mae"""
_BAND = "CASE WHEN score BETWEEN 50 AND 64 THEN '50-64' WHEN score BETWEEN 65 AND 79 THEN '65-79' WHEN score BETWEEN 80 AND 100 THEN '80-100' END"
_SLICES = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {k} AS bucket, {_METRICS} FROM rows WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) >= 5"
    for d, k in (("severity", "severity"), ("regime", "regime_at_signal"), ("trigger", "dominant_trigger_timeframe"), ("score", _BAND))
)


@query(
    _SIGNAL_EVAL
    + f""", rows AS (SELECT e.*, e.return_7d_pct AS r, s.severity, s.regime_at_signal, s.score, s.dominant_trigger_timeframe FROM evaluations e JOIN signals s ON s.id = e.signal_id),
u AS (SELECT 'overall' AS dimension, 'all' AS bucket, {_METRICS} FROM rows UNION ALL {_SLICES})
SELECT dimension, bucket, "count", {_rounded(' '.join(expectancy.METRICS[1:]))} FROM u"""
)
def expectancy_report(spark, sf_dir):
    rows = expectancy.evaluation_rows(X.signals(spark, sf_dir), _signal_evaluations(spark, sf_dir), X.ts(NOW))
    return _round(expectancy.report(rows))


@query(
    _SIGNAL_EVAL
    + f""", b0 AS (SELECT signal_id, verdict FROM evaluations) SELECT verdict, count(*) AS n FROM (SELECT verdict FROM b0 UNION ALL SELECT verdict FROM b0 WHERE signal_id % 3 = 0) GROUP BY verdict"""
)
def verdict_histogram(spark, sf_dir):
    e = _signal_evaluations(spark, sf_dir).select("signal_id", "verdict", "evaluated_at")
    return reports.verdict_histogram(e, e.filter("signal_id % 3 = 0"), X.ts("2024-02-25 00:00:00"), X.ts("2024-03-02 00:00:00"))


@query(
    _SIGNAL_EVAL
    + " SELECT s.id, s.symbol, round(e.return_7d_pct, 6) AS return_7d_pct, coalesce(e.verdict, 'none') AS verdict FROM signals s LEFT JOIN evaluations e ON e.signal_id = s.id"
)
def signal_details(spark, sf_dir):
    d = readers.signal_detail(X.signals(spark, sf_dir), _signal_evaluations(spark, sf_dir))
    return _round(d.select("id", "symbol", F.col("evaluation.return_7d_pct").alias("return_7d_pct"), F.coalesce("evaluation.verdict", F.lit("none")).alias("verdict")))


# --- watchlist and alerts --------------------------------------------------


@query(
    X.with_sql("signals")
    + """, m AS (SELECT symbol, arg_max(score, (detected_at, id)) AS score FROM signals WHERE severity IS NULL GROUP BY symbol)
SELECT symbol, score, CASE WHEN score >= 50 THEN 'PROMOTE' WHEN score < 35 THEN CASE WHEN length(symbol) % 2 = 0 THEN 'EXPIRE' ELSE 'IGNORE' END ELSE 'WATCH' END AS action FROM m"""
)
def watch_actions(spark, sf_dir):
    s = X.signals(spark, sf_dir).filter("severity is null").groupBy("symbol").agg(F.max_by("score", F.struct("detected_at", "id")).alias("score"))
    return s.select("symbol", "score", transitions.watch_action(F.col("score"), F.length("symbol") % 2 == 0).alias("action"))


_LOCAL = "hour(s.detected_at - INTERVAL 3 HOUR)"


@query(
    X.with_sql("signals")
    + f""", p AS (SELECT *, lag(detected_at) OVER w AS prior_at, lag(score) OVER w AS prior_score FROM signals WHERE severity IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY detected_at, id)),
s AS (SELECT *, abs(epoch(detected_at) - epoch(prior_at)) / 60 AS el FROM p),
q AS (SELECT *, coalesce(el < 120, false) AS cooling, coalesce(score - prior_score >= 10, false) AS jump, ({_LOCAL} >= 22 OR {_LOCAL} < 8) AS quiet FROM s)
SELECT id, CASE WHEN cooling AND NOT jump THEN 'skip_cooldown' WHEN quiet AND severity <> 'very_strong' THEN 'queue' ELSE 'send_now' END AS action,
 CASE WHEN cooling AND NOT jump THEN 'cooldown:' || CAST(floor(el) AS BIGINT) || 'm<120m' WHEN quiet AND severity = 'very_strong' THEN 'very_strong_bypass_quiet' WHEN quiet THEN 'quiet_hours' WHEN cooling THEN 'escalation_override' ELSE 'fresh' END AS reason FROM q"""
)
def alert_decisions(spark, sf_dir):
    w = Window.partitionBy("symbol", "block").orderBy("detected_at", "id")
    s = C.in_blocks(X.signals(spark, sf_dir).filter("severity is not null"), 1, ["symbol"], ["detected_at", "id"])
    s = s.select("own", "id", "score", "severity", "detected_at", F.lag("detected_at").over(w).alias("prior_at"), F.lag("score").over(w).alias("prior_score")).filter("own")
    d = alerts.decide(F.col("score"), F.col("severity"), F.col("detected_at"), F.col("prior_at"), F.col("prior_score"))
    return s.select("id", d.alias("d")).select("id", "d.action", "d.reason")


def _pass(spark, sf_dir):
    """Alerts of all signals; earlier sends of the pass count as prior."""
    s = X.signals(spark, sf_dir).filter("severity is not null")
    return s, alerts.alert_pass(s, spark.createDataFrame([], "symbol string, sent_at timestamp_ntz, score int"), "detected_at", delivered=F.col("id") % 7 != 0)


@query(R.PASSED + " SELECT * FROM passed")
def alert_pass(spark, sf_dir):
    return _pass(spark, sf_dir)[1]


def _failures(decisions):
    """Why sends failed: every second one with an error text."""
    return decisions.filter("action = 'send_now' and not ok").select(
        F.col("id").alias("signal_id"), F.lit("http_error").alias("reason"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("status "), F.col("id").cast("string"))).alias("error")
    )


@query(
    R.PASSED
    + ", "
    + X.SQL["rich"]
    + f""" SELECT now AS created_at, CASE WHEN action = 'send_now' AND ok THEN now END AS sent_at, symbol, id AS signal_id, {R.TITLE} AS title, {R.BODY} AS body,
  CASE severity WHEN 'strong' THEN 'high' WHEN 'very_strong' THEN 'max' ELSE 'default' END AS priority, 'chart,money' AS tags, action = 'queue' AS queued, bypass_quiet, action = 'send_now' AND ok AS delivered,
  CASE WHEN action = 'send_now' THEN 1 ELSE 0 END AS delivery_attempts, CASE WHEN action = 'send_now' AND NOT ok THEN 'http_error:' || CASE WHEN id % 2 = 0 THEN 'status ' || id ELSE '' END END AS last_error
FROM (SELECT p.now, p.action, p.bypass_quiet, p.ok, s.* FROM passed p JOIN rich s USING (id) WHERE p.action <> 'skip_cooldown')"""
)
def alert_outbox(spark, sf_dir):
    d = _pass(spark, sf_dir)[1]
    return alerts.outbox(d, X.rich_signals(spark, sf_dir), _failures(d), "chart,money")


@query(
    R.PASSED
    + " SELECT id, true AS alerted, CASE WHEN action = 'skip_cooldown' THEN reason WHEN action = 'queue' THEN 'quiet_hours' WHEN NOT ok THEN 'send_failed:http_error' END AS alert_skipped_reason FROM passed"
)
def alerted_signals(spark, sf_dir):
    d = _pass(spark, sf_dir)[1]
    return alerts.marked(d, _failures(d))


@query(
    X.with_sql("signals", "buys")
    + """, a AS (SELECT 'signal' AS kind, id, symbol, detected_at AS "at", 0 AS k, coalesce(severity, 'below_threshold') || ' score=' || score AS headline FROM signals ORDER BY detected_at DESC, id DESC LIMIT 10),
b AS (SELECT 'sell' AS kind, id, symbol, sold_at AS "at", 1 AS k, 'take_profit ' || CASE WHEN price > 50 THEN '+' ELSE '' END || printf('%.2f', price - 50) || '%' AS headline FROM buys WHERE sold_at IS NOT NULL ORDER BY sold_at DESC, id DESC LIMIT 10)
SELECT kind, id, symbol, "at", headline FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY "at" DESC, k, id DESC LIMIT 10"""
)
def recent_activity(spark, sf_dir):
    sells = X.buys(spark, sf_dir).filter("sold_at is not null")
    sells = sells.select("id", "symbol", F.col("sold_at").alias("detected_at"), F.lit("take_profit").alias("rule_triggered"), (F.col("price") - 50).alias("pnl_pct"))
    return reports.activity(X.signals(spark, sf_dir), sells)


_WEEK = "detected_at >= TIMESTAMP '2024-01-15' AND detected_at < TIMESTAMP '2024-01-22'"
_WEEKLY = (
    _SIGNAL_EVAL
    + ", "
    + X.SQL["buys"]
    + f""", rows AS (SELECT e.*, e.return_7d_pct AS r FROM evaluations e), m AS (SELECT {_METRICS} FROM rows),
b7 AS (SELECT b.id, CASE WHEN b.price <> 0 THEN (e.close - b.price) / b.price * 100 END AS r7 FROM buys b ASOF LEFT JOIN e1h e ON b.symbol = e.symbol AND b.bought_at + INTERVAL 168 HOUR <= e.open_time WHERE TIMESTAMP '2024-03-01' >= b.bought_at + INTERVAL 30 DAY),
v AS (SELECT verdict FROM evaluations UNION ALL SELECT {_VERDICT} AS verdict FROM b7),
n AS (SELECT count(*) AS signal_count, count(*) FILTER (severity = 'very_strong') AS n_very_strong, count(*) FILTER (severity = 'strong') AS n_strong, count(*) FILTER (severity = 'normal') AS n_normal FROM signals WHERE {_WEEK}),
t AS (SELECT symbol, drop_trigger_pct AS pct FROM signals WHERE {_WEEK} AND drop_trigger_pct IS NOT NULL ORDER BY drop_trigger_pct DESC, detected_at, id LIMIT 1),
w AS (SELECT n.*, (SELECT symbol FROM t) AS top_drop_symbol, (SELECT pct FROM t) AS top_drop_pct, (SELECT count(*) FROM buys WHERE bought_at >= TIMESTAMP '2024-01-15' AND bought_at < TIMESTAMP '2024-01-22') AS buy_count,
  (SELECT count(*) FROM v) AS matured_count, (SELECT count(*) FROM v WHERE verdict IN ('great', 'good')) AS n_good, (SELECT count(*) FROM v WHERE verdict = 'neutral') AS n_neutral, (SELECT count(*) FROM v WHERE verdict IN ('poor', 'bad')) AS n_bad,
  (SELECT CASE WHEN "count" < 5 OR win_rate IS NULL THEN 'Análise: dados insuficientes' ELSE array_to_string(list_filter(['WR ' || printf('%.1f', win_rate) || '%', 'exp ' || CASE WHEN expectancy > 0 THEN '+' ELSE '' END || printf('%.2f', expectancy) || '%',
    'PF ' || printf('%.2f', profit_factor)], lambda x: x IS NOT NULL), ' · ') || ' — ' || "count" || ' sinais' END FROM m) AS analytics_line FROM n)"""
)


def _some(column: str, text: str) -> str:
    return f"CASE WHEN {column} > 0 THEN '{text}' || {column} END"


_WEEKLY_BODY = R.lines(
    "'📊 Resumo da semana'",
    "''",
    "CASE WHEN signal_count = 0 THEN 'Sinais emitidos: 0 (semana tranquila)' ELSE 'Sinais emitidos: ' || signal_count END",
    _some("n_very_strong", "  🟢 Críticos: "),
    _some("n_strong", "  🟡 Fortes: "),
    _some("n_normal", "  🟠 Normais: "),
    "'Maior queda: ' || top_drop_symbol || ' (-' || printf('%.1f', top_drop_pct) || '%)'",
    "CASE WHEN buy_count > 0 THEN chr(10) || 'Compras registradas: ' || buy_count END",
    "CASE WHEN matured_count > 0 THEN chr(10) || 'Avaliações vencidas: ' || matured_count END",
    _some("n_good", "  ✅ Boas: "),
    _some("n_neutral", "  ⚠️ Neutras: "),
    _some("n_bad", "  ❌ Ruins: "),
    "''",
    "CASE WHEN signal_count = 0 THEN 'Leitura rápida: sem oportunidades nesta semana.' WHEN n_very_strong > 0 THEN 'Leitura rápida: houve sinal forte de compra nesta semana.' "
    "WHEN n_strong > 0 THEN 'Leitura rápida: sinais moderados — vale acompanhar.' ELSE 'Leitura rápida: apenas sinais fracos, sem urgência.' END",
    "chr(10) || '📈 Análise (90d)'",
    "analytics_line",
)


@query(
    _WEEKLY
    + f""" SELECT * REPLACE (round(top_drop_pct, 6) AS top_drop_pct), TIMESTAMP '2024-01-15' AS week_start, TIMESTAMP '2024-01-22' AS week_end, 'Resumo semanal — 15/01 a 22/01' AS title, {_WEEKLY_BODY} AS body, false AS sent FROM w"""
)
def weekly_summary(spark, sf_dir):
    s, b, now = X.signals(spark, sf_dir), X.buys(spark, sf_dir), X.ts("2024-01-22 00:00:00")
    bars = _bars(spark, sf_dir, "1h", X.ticks_events)
    e = evaluation.evaluate_signals(s, _no_evaluations(spark, "signal_id"), bars, X.ts(NOW)).withColumn("evaluated_at", X.ts("2024-01-20 00:00:00"))
    be = evaluation.evaluate_buys(b, _no_evaluations(spark, "buy_id"), bars, X.ts(NOW)).withColumn("evaluated_at", X.ts("2024-01-20 00:00:00"))
    e, be = C.stored(e, "signal_evaluations"), C.stored(be, "buy_evaluations")
    rows = expectancy.evaluation_rows(s, e, now, 90)
    return _round(reports.weekly_summary(s, b, e, be, expectancy.report(rows), now))


@query(
    _SIGNAL_EVAL
    + f""", {X.SQL['buys']}, rows AS (SELECT e.*, e.return_7d_pct AS r FROM evaluations e JOIN signals s ON s.id = e.signal_id WHERE s.detected_at >= TIMESTAMP '2024-01-10'), m AS (SELECT {_METRICS} FROM rows)
SELECT (SELECT count(*) FROM signals WHERE detected_at >= TIMESTAMP '2024-04-08') AS signals_24h, (SELECT count(*) FROM signals WHERE detected_at >= TIMESTAMP '2024-04-02') AS signals_7d,
 (SELECT count(*) FROM buys WHERE sold_at >= TIMESTAMP '2024-04-02') AS sells_7d, (SELECT count(*) FROM buys WHERE sold_at IS NULL) AS open_buys, (SELECT count(DISTINCT event_type) FROM events WHERE length(event_type) % 2 = 0) AS active_watches,
 (SELECT arg_max(CASE user_id % 3 WHEN 0 THEN 'risk_on' WHEN 1 THEN 'risk_off' ELSE 'neutral' END, event_id) FROM events) AS regime, (SELECT arg_max(ts, event_id) FROM events) AS regime_at, (SELECT round(arg_max(value, event_id), 6) FROM events) AS atr_percentile,
 "count" AS evaluated, {_rounded('win_rate expectancy profit_factor')} FROM m"""
)
def overview_page(spark, sf_dir):
    """All headline figures at a time when the 90 days leave out the first signals."""
    s, b, e = X.signals(spark, sf_dir), X.buys(spark, sf_dir), X.table(spark, sf_dir, "events")
    sells = b.filter("sold_at is not null").select("id", F.col("sold_at").alias("detected_at"))
    watch = e.select("event_type").distinct().select(F.when(F.length("event_type") % 2 == 0, "watching").otherwise("expired").alias("status"))
    label = F.when(F.col("user_id") % 3 == 0, "risk_on").when(F.col("user_id") % 3 == 1, "risk_off").otherwise("neutral")
    regimes = e.select(F.col("event_id").alias("id"), label.alias("label"), F.col("ts").alias("determined_at"), F.col("value").alias("atr_percentile"))
    return _round(reports.overview(s, sells, watch, b, regimes, _signal_evaluations(spark, sf_dir), X.ts("2024-04-09 00:00:00")))


@query(
    _SIGNAL_EVAL
    + """, b AS (SELECT event_id AS id, event_id % 3 = 0 AS sold FROM events WHERE event_type = 'purchase'), r AS (SELECT e.return_7d_pct AS v FROM evaluations e)
SELECT (SELECT count(*) FROM signals WHERE detected_at >= TIMESTAMP '2024-01-30') AS signals_24h, (SELECT count(*) FROM signals WHERE detected_at >= TIMESTAMP '2024-01-24') AS signals_7d,
 (SELECT count(*) FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 AND ts + INTERVAL 5 DAY >= TIMESTAMP '2024-01-24') AS sells_7d, (SELECT count(*) FROM b WHERE NOT sold) AS open_buys,
 (SELECT count(*) FROM r) AS evaluated, (SELECT round(count(*) FILTER (v > 0) / count(v) * 100, 6) FROM r) AS win_rate"""
)
def overview_kpis(spark, sf_dir):
    s, b = X.signals(spark, sf_dir), X.buys(spark, sf_dir)
    sells = b.filter("sold_at is not null").select("id", F.col("sold_at").alias("detected_at"))
    o = reports.overview(s, sells, schemas.empty(spark, "watchlist"), b, schemas.empty(spark, "regime_snapshots"), _signal_evaluations(spark, sf_dir), X.ts("2024-01-31 00:00:00"))
    return _round(o.select("signals_24h", "signals_7d", "sells_7d", "open_buys", "evaluated", "win_rate"))


@query(
    X.with_sql("o1h", "o4h", "o1d")
    + R.SCORED
    + f" SELECT symbol, {R.TITLE} AS title, array_to_string({R.REASONS}, ' | ') AS reasons, {R.BODY} AS body, reversal_pattern AS pattern FROM scored"
)
def alert_messages(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("symbol", alerts.title(F.col("symbol"), F.col("severity")).alias("title"), F.array_join(alerts.reasons(), " | ").alias("reasons"), alerts.body().alias("body"), alerts.pattern_of(F.col("score_breakdown")).alias("pattern"))


@query(
    X.with_sql("signals", "rich")
    + f" SELECT id, {R.TITLE} AS title, array_to_string({R.REASONS}, ' | ') AS reasons, {R.BODY} AS body FROM rich"
)
def signal_messages(spark, sf_dir):
    s = X.rich_signals(spark, sf_dir)
    return s.select("id", alerts.title(F.col("symbol"), F.col("severity")).alias("title"), F.array_join(alerts.reasons(), " | ").alias("reasons"), alerts.body().alias("body"))


# --- further readers, rules and scalars ------------------------------------


def _sells(spark, sf_dir):
    """Sales of the fixture as sell signals; the rule follows the id."""
    rule = F.get(F.array(*map(F.lit, ("stop_loss", "trailing_stop", "take_profit"))), (F.col("id") % 3).cast("int"))
    b = X.buys(spark, sf_dir).filter("sold_at is not null")
    return b.select("id", "symbol", F.col("sold_at").alias("detected_at"), rule.alias("rule_triggered"))


_SELL_ROWS = (
    X.with_sql("buys") + ", sells AS (SELECT id, symbol, sold_at AS detected_at, ['stop_loss', 'trailing_stop', 'take_profit'][id % 3 + 1] AS rule_triggered FROM buys WHERE sold_at IS NOT NULL)"
)


@query(_SELL_ROWS + " SELECT * FROM sells WHERE rule_triggered = 'stop_loss' AND detected_at >= TIMESTAMP '2024-01-10' ORDER BY detected_at DESC, id DESC LIMIT 50")
def sell_signals_page(spark, sf_dir):
    return readers.page(_sells(spark, sf_dir).filter(readers.sell_filter(rule="stop_loss", since=X.ts("2024-01-10 00:00:00"))), "detected_at")


@query(X.with_sql("buys") + " SELECT id, bought_at FROM (SELECT * FROM buys ORDER BY bought_at DESC, id DESC LIMIT 20) ORDER BY bought_at, id")
def newest_buys_oldest_first(spark, sf_dir):
    return readers.last_ascending(X.buys(spark, sf_dir), "bought_at", 20).select("id", "bought_at")


@query(X.with_sql("e1h") + " SELECT max(close_time) AS close_time FROM e1h")
def data_freshness(spark, sf_dir):
    return readers.freshness(_bars(spark, sf_dir, "1h", X.ticks_events))


@query(X.with_sql("buys") + " SELECT count(*) AS n FROM buys WHERE bought_at >= TIMESTAMP '2024-01-08' AND bought_at < TIMESTAMP '2024-01-15'")
def weekly_buys(spark, sf_dir):
    return reports.count_buys(X.buys(spark, sf_dir), X.ts("2024-01-08 00:00:00"), X.ts("2024-01-15 00:00:00"))


@query(X.with_sql("signals") + " SELECT id, symbol FROM signals WHERE id % 4 <> 0")
def pending_signals(spark, sf_dir):
    s = X.signals(spark, sf_dir)
    return evaluation.pending(s, s.filter("id % 4 = 0").select(F.col("id").alias("signal_id")), "signal_id").select("id", "symbol")


@query(
    X.with_sql("e1h")
    + ", d AS (SELECT event_id AS id, event_type AS symbol, ts + INTERVAL 36 HOUR AS t0 FROM events) SELECT d.id, e.close AS price FROM d ASOF LEFT JOIN e1h e ON d.symbol = e.symbol AND d.t0 <= e.open_time"
)
def asof_prices(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    targets = e.select(F.col("event_id").alias("key"), F.col("event_type").alias("symbol"), F.timestamp_add("HOUR", F.lit(36), "ts").alias("at"))
    return evaluation.price_at_or_after(targets, _bars(spark, sf_dir, "1h", X.ticks_events)).select(F.col("key").alias("id"), "price")


_P = scoring.Scoring()


@query(
    f"""WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value % 50 END AS v FROM events)
SELECT id, {R.tier('v', _P.drops['7d'], '>=')} AS drop_7d, {R.tier('v', _P.rsi_1h, '<=')} AS rsi_1h, least({R.tier('v', _P.rsi_1h, '<=')} + {R.tier('v', _P.rsi_4h, '<=')}, 20) AS rsi,
  {R.tier('v', _P.rel_volume, '>=')} AS volume, CASE WHEN v <= 0.5 THEN 15 WHEN v <= 1.5 THEN 12 WHEN v <= 3 THEN 8 WHEN v <= 5 THEN 4 ELSE 0 END AS support,
  least({R.tier('v', _P.discount_30d, '>=')} + {R.tier('v', _P.discount_180d, '>=')}, 10) AS discount FROM v"""
)
def factor_points(spark, sf_dir):
    v = F.when(F.col("event_id") % 11 != 0, F.col("value") % 50)
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), v.alias("v"))
    v = F.col("v")
    return e.select(
        "id",
        scoring.tier_up(v, _P.drops["7d"]).alias("drop_7d"),
        scoring.tier_down(v, _P.rsi_1h).alias("rsi_1h"),
        scoring.rsi_points(v, v, _P).alias("rsi"),
        scoring.volume_points(v, _P).alias("volume"),
        scoring.support_points(v, _P).alias("support"),
        scoring.discount_points(v, v, _P).alias("discount"),
    )


@query(
    X.with_sql("signals")
    + """ SELECT id, strftime(detected_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(detected_at, '%d/%m') AS day_month, CAST(floor(epoch(detected_at)) AS BIGINT) * 1000 AS ms,
  CASE severity WHEN 'very_strong' THEN 'Críticos' WHEN 'strong' THEN 'Fortes' WHEN 'normal' THEN 'Normais' ELSE '?' END AS label,
  hour(detected_at - INTERVAL 3 HOUR) >= 22 OR hour(detected_at - INTERVAL 3 HOUR) < 8 AS quiet, CASE severity WHEN 'strong' THEN 'high' WHEN 'very_strong' THEN 'max' ELSE 'default' END AS priority,
  CASE regime_at_signal WHEN 'risk_on' THEN 'Mercado favorável (risk-on)' WHEN 'risk_off' THEN 'Mercado adverso (risk-off)' END AS regime_line FROM signals"""
)
def labels_and_times(spark, sf_dir):
    s, at = X.signals(spark, sf_dir), F.col("detected_at")
    return s.select(
        "id",
        S.utc_iso(at).alias("iso"),
        S.day_month(at).alias("day_month"),
        (F.floor(S.second_to_millis(at) / 1000) * 1000).alias("ms"),
        S.label(F.col("severity"), S.SEVERITIES, F.lit("?")).alias("label"),
        S.quiet_hours(at, "America/Sao_Paulo", 22, 8).alias("quiet"),
        S.label(F.col("severity"), alerts.PRIORITY, F.lit("default")).alias("priority"),
        S.label(F.col("regime_at_signal"), S.REGIMES).alias("regime_line"),
    )


@query(
    """WITH b AS (SELECT event_id AS id, value - 20 AS price, 100.0 AS amount, CASE WHEN event_id % 3 = 0 THEN event_id + (event_id % 2) * 1000000 END AS sid FROM events WHERE event_type = 'purchase')
SELECT b.id, CASE WHEN price <= 0 THEN 'price' WHEN sid IS NOT NULL AND e.event_id IS NULL THEN 'signal' END AS error, CASE WHEN price <> 0 THEN round(amount / price, 6) END AS quantity
FROM b LEFT JOIN events e ON e.event_id = b.sid"""
)
def buy_validation(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    sid = F.when(F.col("event_id") % 3 == 0, F.col("event_id") + (F.col("event_id") % 2) * 1000000)
    new = e.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), (F.col("value") - 20).alias("price"), F.lit(100.0).alias("amount_invested"), F.lit(None).cast("double").alias("quantity"), sid.alias("signal_id")
    )
    return _round(transitions.validate_buys(new, X.signals(spark, sf_dir)).select("id", "error", "quantity"))


@query(
    X.with_sql("buys")
    + """, s AS (SELECT id AS buy_id, bought_at + to_days(CAST(id % 5 - 1 AS INTEGER)) AS t, price * (id % 4) AS p FROM buys)
SELECT buy_id, CASE WHEN b.sold_at IS NOT NULL THEN 'already_sold' WHEN p <= 0 THEN 'price' WHEN t < b.bought_at THEN 'time' END AS error FROM s JOIN buys b ON b.id = s.buy_id"""
)
def sale_validation(spark, sf_dir):
    b = X.buys(spark, sf_dir).withColumns({"sold_price": F.lit(None).cast("double"), "sold_note": F.lit(None).cast("string")})
    days = (F.col("id") % 5 - 1).cast("int")
    sales = b.select(F.col("id").alias("buy_id"), F.timestamp_add("DAY", days, "bought_at").alias("sold_at"), (F.col("price") * (F.col("id") % 4)).alias("sold_price"), F.lit(None).cast("string").alias("sold_note"))
    return transitions.record_sales(b, sales)[1].select("buy_id", "error")


@query(
    X.with_sql("signals")
    + """ SELECT coalesce(severity, 'none') AS severity, count(*) AS n FROM signals GROUP BY 1"""
)
def severities_in_order(spark, sf_dir):
    s = X.signals(spark, sf_dir).groupBy(F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return readers.ranked(s, "severity", ["very_strong", "strong", "normal"])


@query(
    X.with_sql("signals")
    + """, t AS (SELECT count(*) AS considered FROM signals) SELECT considered, count(*) FILTER (severity IS NULL) AS below_threshold, count(DISTINCT symbol) AS symbols FROM signals, t GROUP BY considered"""
)
def scan_counters(spark, sf_dir):
    return reports.scan_counters(X.signals(spark, sf_dir))
