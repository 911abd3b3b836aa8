"""Known values of indicators and rules, and a plain Python version of folds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scalars as S
from tidemark.operators import scoring
from tidemark.params import Scoring, Weights

R = random.Random(3)


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>"))
    return df.select(expr.alias("x")).first().x


def bars(rows):
    """Column of bars from (open, high, low, close)."""
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("open", "high", "low", "close"), r, strict=True)]) for r in rows])


def slow_rsi(c, p=14):
    if len(c) <= p:
        return None
    d = [b - a for a, b in zip(c, c[1:])]
    g, l = sum(max(x, 0) for x in d[:p]) / p, sum(max(-x, 0) for x in d[:p]) / p
    for x in d[p:]:
        g, l = (g * (p - 1) + max(x, 0)) / p, (l * (p - 1) + max(-x, 0)) / p
    return 50.0 if g == l == 0 else 100.0 if l == 0 else 0.0 if g == 0 else 100 - 100 / (1 + g / l)


@pytest.mark.parametrize("closes,want", [([50] * 30, 50), (list(range(30)), 100), (list(range(30, 0, -1)), 0), ([1] * 14, None)])
def test_rsi_known(spark, closes, want):
    assert one(spark, I.rsi(F.col("c")), c=closes) == want


def test_rsi_and_series_against_python(spark):
    c = [100 + R.uniform(-5, 5) for _ in range(60)]
    assert one(spark, I.rsi(F.col("c")), c=c) == pytest.approx(slow_rsi(c), abs=1e-9)
    series = one(spark, I.rsi_series(F.col("c")), c=c)
    assert series[:14] == [None] * 14
    assert series[14:] == pytest.approx([slow_rsi(c[: k + 1]) for k in range(14, 60)], abs=1e-9)


def test_trend_and_volume(spark):
    assert one(spark, I.trend_label(F.col("c")), c=[100 + i for i in range(60)]) == "uptrend"
    assert one(spark, I.trend_label(F.col("c")), c=[100 - i for i in range(60)]) == "downtrend"
    assert one(spark, I.trend_label(F.col("c")), c=list(range(49))) == "sideways"
    assert one(spark, I.relative_volume(F.col("v")), v=[100] * 20 + [500]) == 5.0
    assert one(spark, I.relative_volume(F.col("v")), v=[100] * 20) is None


def test_support(spark):
    lows = [110, 108, 106, 104, 102, 90, 102, 104, 106, 108, 110]
    s = one(spark, I.support(bars([(x, x, x, x) for x in lows]), F.lit(120.0)))
    assert s.price == 90 and s.distance_pct == pytest.approx(100 / 3)
    assert one(spark, I.support(bars([(x, x, x, x) for x in lows[:6]]), F.lit(120.0))) is None
    assert one(spark, I.support(bars([(x, x, x, x) for x in lows]), F.lit(80.0))) is None


def test_patterns(spark):
    assert one(spark, I.reversal(bars([(10, 10.6, 8, 10.5)]))) == "hammer"
    assert one(spark, I.reversal(bars([(10, 10, 9, 9.2), (9, 10.4, 8.9, 10.2)]))) == "bullish_engulfing"
    assert one(spark, I.reversal(bars([(10, 11, 9, 10.05)]))) == "doji"
    assert one(spark, I.reversal(bars([(10, 12, 10, 12)]))) is None


def test_atr_percentile_of_flat_ranges_is_100(spark):
    assert one(spark, I.atr_percentile(bars([(10, 11, 9, 10)] * 30))) == 100
    assert one(spark, I.atr_percentile(bars([(10, 11, 9, 10)] * 10))) == 50
    assert one(spark, I.atr(bars([(10, 11, 9, 10)] * 13))) is None


def test_divergence_and_reclaim(spark):
    closes, rsi = [99, 98, 97, 95, 90, 92, 93, 94, 91, 89, 90, 92, 93, 94], [45, 44, 43, 40, 25, 30, 28, 35, 32, 35, 38, 36, 40, 41]
    expr = I.bullish_divergence(F.col("c"), F.col("r"))
    assert one(spark, expr, c=closes, r=rsi) is True
    assert one(spark, expr, c=closes[1:], r=rsi[1:]) is False
    assert one(spark, I.high_reclaim(bars([(1, 5, 1, 1)] * 10 + [(1, 6, 1, 5.5)]))) is True
    assert one(spark, I.high_reclaim(bars([(1, 5, 1, 1)] * 9 + [(1, 6, 1, 5.5)]))) is False


def test_tiers(spark):
    t = ((1, 2, 3), (5, 8, 12))
    for v, want in ((None, 0), (0.9, 0), (1.0, 5), (2.5, 8), (9.0, 12)):
        assert one(spark, scoring.tier_up(F.lit(v).cast("double"), t)) == want
    down = ((30, 25, 20), (12, 15, 18))
    for v, want in ((None, 0), (31.0, 0), (30.0, 12), (10.0, 18)):
        assert one(spark, scoring.tier_down(F.lit(v).cast("double"), down)) == want
    first = ((0.5, 1.5), (15, 12))
    for v, want in ((None, 0), (-0.1, 0), (0.5, 15), (1.0, 12), (2.0, 0)):
        assert one(spark, scoring.tier_first(F.lit(v).cast("double"), first)) == want


def test_severity_gate_and_verdicts(spark):
    assert [one(spark, scoring.severity(F.lit(s))) for s in (49, 50, 65, 80)] == [None, "normal", "strong", "very_strong"]
    assert one(spark, scoring.severity(F.lit(47), adjust=-5)) is None and one(spark, scoring.severity(F.lit(52), adjust=5)) is None
    want = {None: "pending", 10.0: "great", 5.0: "good", -10.0: "bad", -5.0: "poor", 0.0: "neutral"}
    for v, name in want.items():
        assert one(spark, scoring.verdict(F.lit(v).cast("double"))) == name
    with pytest.raises(ValueError):
        Weights(drop=26)


def test_scalars(spark):
    t = "2024-01-01 01:00:00"
    ts = F.lit(t).cast("timestamp_ntz")
    assert one(spark, S.utc_iso(ts)) == "2024-01-01T01:00:00Z"
    assert one(spark, S.second_to_millis(S.millis_to_second(F.lit(1704070800999)))) == 1704070800000
    assert one(spark, S.quiet_hours(ts, "America/Sao_Paulo", 22, 8)) is True  # 22:00 there
    assert one(spark, S.quiet_hours(ts, "America/Sao_Paulo", 8, 8)) is False
    assert [one(spark, S.friendly_name(F.lit(s))) for s in ("BTCUSDT", "ABCUSDT", "USDT", "XYZ")] == ["BTC", "ABC", "USDT", "XYZ"]
    p = one(spark, S.split_symbol(F.lit("ETHBTC")))
    assert (p.base, p.quote) == ("ETH", "BTC")
    assert one(spark, S.pct_change(F.lit(0.0), F.lit(1.0))) is None and one(spark, S.positive_drop(F.lit(10.0), F.lit(12.0))) == 0
    assert [one(spark, S.signed_pct(F.lit(v))) for v in (1.245, -0.5, 0.0, None)] == ["+1.25%", "-0.50%", "0.00%", None]


def test_number_texts_equal_python(spark):
    r = random.Random(4)
    values = [0.0, 1.0, 50.0, 0.5, 12.25, 12.35, 0.15, 2.675, -0.04, 1234.565, 1000.005, 999999.6, 999999.5, 1234567.0, 1234565.0, 1e6, 123456.5, 0.0001, 0.00009999995, 1e-7, 1e15, 1.5e16, 3e-5, 100.4565, 0.1 + 0.2, 99999.95]
    values += [round(r.uniform(0, 2000), r.randint(0, 4)) * r.choice((1, -1)) for _ in range(3000)] + [r.uniform(0, 1) * 10 ** r.randint(-9, 14) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    rows = df.select("v", S.fixed(v, 0).alias("f0"), S.fixed(v, 1).alias("f1"), S.fixed(v, 2).alias("f2"), S.general(v).alias("g"), S.plain(v).alias("p")).collect()
    for x in rows:
        if abs(x.v) < 1e12:
            assert (x.f0, x.f1, x.f2) == (f"{x.v:.0f}", f"{x.v:.1f}", f"{x.v:.2f}"), x.v
        assert (x.g, x.p) == (f"{x.v:g}", repr(x.v)), x.v


def test_crash_series_scores_70(spark):
    def series(name, interval, closes, step, last_volume=100.0):
        return [(name, interval, i * step, float(c), last_volume if i == len(closes) - 1 else 100.0) for i, c in enumerate(closes)]

    fall = lambda n, top, down, k: [top] * n + [top - down * (i + 1) for i in range(k)]
    rows = series("X", "1h", fall(180, 50, 0.5, 20), 1, 500.0) + series("X", "4h", fall(60, 50, 0.5, 20), 4) + series("X", "1d", fall(170, 100, 2, 30), 24)
    df = spark.createDataFrame(rows, "symbol string, interval string, h long, close double, volume double")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_add("HOUR", F.col("h"), start)
    bar = F.struct(at.alias("open_time"), F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume", at.alias("close_time"))
    arrays = df.groupBy("symbol", "interval").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    r = scoring.score_symbols(arrays, start, Scoring()).first()
    assert (r.score, r.severity, r.dominant_trigger_timeframe) == (70, "strong", "7d")
    assert (r.rsi_1h, r.rel_volume, r.trend_context_1d) == (0.0, 5.0, "downtrend")
