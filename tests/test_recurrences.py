"""Folds over whole histories, scanned by months, against sequential folds."""

import random

import numpy as np

from tests.test_tables import frame
from tidemark.functions import recurrences as Rc


def slow(bars, period=14, emas=(20, 50)):
    out, g, l, a, e, last = [], 0.0, 0.0, 0.0, {n: 0.0 for n in emas}, None  # noqa: E741
    for n, (high, low, close) in enumerate(bars):
        if last is not None:
            up, down = max(close - last, 0.0), max(last - close, 0.0)
            roll = lambda s, x: s + x if n < period else (s + x) / period if n == period else (s * (period - 1) + x) / period  # noqa: B023, E731
            g, l = roll(g, up), roll(l, down)  # noqa: E741
        tr = high - low if last is None else max(high - low, abs(high - last), abs(low - last))
        a = a + tr if n < period - 1 else (a + tr) / period if n == period - 1 else (a * (period - 1) + tr) / period
        for p in emas:
            e[p] = e[p] + close if n < p - 1 else (e[p] + close) / p if n == p - 1 else (close - e[p]) * 2 / (p + 1) + e[p]
        rsi = None if n < period else 50.0 if g == l == 0 else 100.0 if l == 0 else 0.0 if g == 0 else 100 - 100 / (1 + g / l)
        out.append((rsi, a if n >= period - 1 else None, *[e[p] if n >= p - 1 else None for p in emas]))
        last = close
    return out


def test_affine_maps_compose():
    r = np.random.default_rng(3)
    x = r.random(200)
    whole = Rc.affine_scan(x, 0, 20, 0.1)
    assert np.allclose(whole[0][:20], 1)
    for cut in (1, 7, 20, 21, 150):
        a1, b1 = Rc.affine_scan(x[:cut], 0, 20, 0.1)
        a2, b2 = Rc.affine_scan(x[cut:], cut, 20, 0.1)
        assert np.allclose(b2 + a2 * b1[-1], whole[1][cut:], rtol=1e-12)


def test_history_equals_a_sequential_fold(spark):
    r = random.Random(5)
    rows, want = [], {}
    for symbol, n in (("LONG", 900), ("SHORT", 17), ("ONE", 1), ("FLAT", 60)):
        bars = []
        for i in range(n):
            close = 50.0 if symbol == "FLAT" else r.uniform(10, 90)
            bars.append((close + 0.0 if symbol == "FLAT" else close + r.random(), close - (0.0 if symbol == "FLAT" else r.random()), close))
            day = i // 8
            rows.append((symbol, "1h", f"2024-{1 + day // 28:02d}-{1 + day % 28:02d} {3 * (i % 8):02d}:00:00", *bars[-1]))
        want[symbol] = slow(bars)
    rows.append(("LONG", "1h", None, 1.0, 1.0, 1.0))
    table = frame(spark, rows, "symbol string, interval string, open_time timestamp_ntz, high double, low double, close double")
    got = {}
    for x in Rc.indicator_history(table.repartition(5)).orderBy("symbol", "open_time").collect():
        got.setdefault(x.symbol, []).append((x.rsi, x.atr, x.ema_20, x.ema_50))
    assert set(got) == set(want)
    for s, values in want.items():
        assert len(values) == len(got[s])
        for a, b in zip(got[s], values):
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b)), s
    assert Rc.indicator_history(table.limit(0)).count() == 0


def test_history_beyond_the_times_of_pandas(spark):
    r = random.Random(6)
    bars = [(c + r.random(), c - r.random(), c) for c in (r.uniform(10, 90) for _ in range(90))]
    rows = [("A", "1d", f"{2255 + i // 6}-{1 + 2 * (i % 6):02d}-01 00:00:00", *b) for i, b in enumerate(bars)]
    table = frame(spark, rows, "symbol string, interval string, open_time timestamp_ntz, high double, low double, close double")
    got = Rc.indicator_history(table).orderBy("open_time").selectExpr("rsi", "atr", "ema_20", "ema_50").collect()
    for a, b in zip(got, slow(bars), strict=True):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))
