"""The driver's tables as ticks, candles, signals, buys and symbols."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SECONDS = {"1h": 3600, "4h": 4 * 3600, "1d": 24 * 3600}


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("symbol"),
        F.timestamp_add("MINUTE", F.col("o_orderkey") * 20, ts("2020-01-01 00:00:00")).alias("ts"),
        F.col("o_orderkey").alias("seq"),
        (100 + (F.col("o_totalprice") % 1000) / 10).alias("price"),
        F.lit(1.0).alias("qty"),
    )


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))


def _start(ts: Column, n: int) -> Column:
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", zero, ts) / n) * n, zero)


def _bar(bars: DataFrame, interval: str) -> DataFrame:
    end = F.timestamp_add("SECOND", F.lit(SECONDS[interval] - 1), "open_time")
    return bars.select("symbol", F.lit(interval).alias("interval"), "open_time", "open", "high", "low", "close", "volume", end.alias("close_time"))


def candles(ticks: DataFrame, interval: str) -> DataFrame:
    """OHLCV bars of an interval; one hash aggregate with map-side combine.

    Ticks are in order of time and sequence number, as one number: a pair of
    them would be kept in a sorting aggregate.
    """
    zero = ts("1970-01-01 00:00:00")
    at = F.timestamp_diff("MICROSECOND", zero, "ts").cast("decimal(18,0)") * F.lit(Decimal(10**19)) + F.col("seq").cast("decimal(19,0)")
    bars = ticks.groupBy("symbol", _start(F.col("ts"), SECONDS[interval]).alias("open_time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume")
    )
    return _bar(bars, interval)


def all_candles(ticks: DataFrame) -> DataFrame:
    return candles(ticks, "1h").unionByName(candles(ticks, "4h")).unionByName(candles(ticks, "1d"))


def _digits(props: Column) -> Column:
    return F.regexp_extract(props, r"(\d+)", 1).cast("bigint")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    score = (40 + (_digits(F.col("props")) * 7) % 61).cast("int")
    s = e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("detected_at"),
        S.floor_hour(F.col("ts")).alias("candle_hour"),
        F.col("value").alias("price_at_signal"),
        score.alias("score"),
        (F.col("user_id") % 4).alias("u4"),
        (F.col("user_id") % 5).alias("u5"),
    )
    severity = F.when(F.col("score") >= 80, "very_strong").when(F.col("score") >= 65, "strong").when(F.col("score") >= 50, "normal")
    return s.select(
        "id",
        "symbol",
        "detected_at",
        "candle_hour",
        "price_at_signal",
        "score",
        severity.alias("severity"),
        F.when(F.col("u4") == 0, "risk_on").when(F.col("u4") == 1, "neutral").when(F.col("u4") == 2, "risk_off").alias("regime_at_signal"),
        F.get(F.array(*map(F.lit, ("1h", "24h", "7d", "30d", "180d"))), F.col("u5").cast("int")).alias("dominant_trigger_timeframe"),
        (F.col("price_at_signal") % 40).alias("drop_trigger_pct"),
    )


#: Factors that spread the prices of ``rich_signals`` over magnitudes.
FACTORS = (0.000001, 0.001, 1.0, 100.0, 10000.0, 1000000.0)
PATTERNS = ("hammer", "doji", None, "")


def rich_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals`` with the columns that messages are made of, derived from id and price."""
    c, v = F.col, F.col("price_at_signal")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (c("id") % len(values)).cast("int"))
    return signals(spark, sf_dir).withColumns(
        {
            "trigger_reason": F.lit("scan"),
            "drop_24h_pct": F.when(c("id") % 9 != 0, v % 7 - 1),
            "rsi_1h": v % 60,
            "rel_volume": v % 3,
            "reversal_pattern": pick(PATTERNS),
            "dist_support_pct": v % 9,
            "support_level_price": v * pick(FACTORS),
            "distance_from_30d_high_pct": v % 50,
            "distance_from_180d_high_pct": v % 45,
            "price_at_signal": v * pick(FACTORS),
        }
    )


def buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    sold = F.col("event_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("bought_at"),
        F.col("value").alias("price"),
        F.lit(100.0).alias("amount_invested"),
        F.when(sold, F.timestamp_add("DAY", F.lit(5), "ts")).alias("sold_at"),
    )


_CANDLES = """{name} AS (
  SELECT symbol, '{interval}' AS interval, to_timestamp_ntz(b * {n}) AS open_time, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, seq)) AS close, sum(qty) AS volume, to_timestamp_ntz(b * {n} + {n} - 1) AS close_time
  FROM (SELECT *, CAST(floor(epoch(ts) / {n}) AS BIGINT) AS b FROM {ticks}) GROUP BY symbol, b
)"""

#: Common table expressions of the same tables for DuckDB.
SQL: dict[str, str] = {
    "ticks_orders": """ticks_orders AS (
  SELECT o_orderpriority AS symbol, TIMESTAMP '2020-01-01' + to_minutes(CAST(o_orderkey * 20 AS BIGINT)) AS ts, o_orderkey AS seq,
         100 + (o_totalprice % 1000) / 10 AS price, 1.0::DOUBLE AS qty FROM orders
)""",
    "ticks_events": "ticks_events AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS qty FROM events)",
    "signals": """signals AS (
  SELECT id, symbol, detected_at, candle_hour, price_at_signal, score,
    CASE WHEN score >= 80 THEN 'very_strong' WHEN score >= 65 THEN 'strong' WHEN score >= 50 THEN 'normal' END AS severity,
    CASE u4 WHEN 0 THEN 'risk_on' WHEN 1 THEN 'neutral' WHEN 2 THEN 'risk_off' END AS regime_at_signal,
    ['1h', '24h', '7d', '30d', '180d'][u5 + 1] AS dominant_trigger_timeframe, price_at_signal % 40 AS drop_trigger_pct
  FROM (SELECT event_id AS id, event_type AS symbol, ts AS detected_at, date_trunc('hour', ts) AS candle_hour, value AS price_at_signal,
    CAST(40 + (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) * 7) % 61 AS INTEGER) AS score, user_id % 4 AS u4, user_id % 5 AS u5 FROM events)
)""",
    "rich": f"""rich AS (
  SELECT * REPLACE (price_at_signal * f AS price_at_signal), 'scan' AS trigger_reason, CASE WHEN id % 9 <> 0 THEN price_at_signal % 7 - 1 END AS drop_24h_pct, price_at_signal % 60 AS rsi_1h, price_at_signal % 3 AS rel_volume,
    ['hammer', 'doji', NULL, ''][id % 4 + 1] AS reversal_pattern, price_at_signal % 9 AS dist_support_pct, price_at_signal * f AS support_level_price, price_at_signal % 50 AS distance_from_30d_high_pct, price_at_signal % 45 AS distance_from_180d_high_pct
  FROM (SELECT *, [{', '.join(f'{f}::DOUBLE' for f in FACTORS)}][id % 6 + 1] AS f FROM signals)
)""",
    "buys": """buys AS (
  SELECT event_id AS id, event_type AS symbol, ts AS bought_at, value AS price, 100.0::DOUBLE AS amount_invested,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 DAY END AS sold_at FROM events WHERE event_type = 'purchase'
)""",
}
for _t, _p in (("ticks_orders", "o"), ("ticks_events", "e")):
    for _i, _n in SECONDS.items():
        SQL[f"{_p}{_i}"] = _CANDLES.format(name=f"{_p}{_i}", interval=_i, n=_n, ticks=_t).replace("to_timestamp_ntz(", "make_timestamp(1000000 * (")
        SQL[f"{_p}{_i}"] = SQL[f"{_p}{_i}"].replace(f"* (b * {_n}) AS", f"* (b * {_n})) AS").replace(f"* (b * {_n} + {_n} - 1) AS", f"* (b * {_n} + {_n} - 1)) AS")


def with_sql(*names: str) -> str:
    """``WITH`` and the named expressions with what they need."""
    need: list[str] = []
    for n in names:
        if n in ("o1h", "o4h", "o1d"):
            need.append("ticks_orders")
        if n in ("e1h", "e4h", "e1d"):
            need.append("ticks_events")
        need.append(n)
    return "WITH " + ",\n".join(SQL[n] for n in dict.fromkeys(need))
