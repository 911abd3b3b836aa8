"""Technical indicators over arrays of bars, oldest first.

Arrays are bounded slices (250 bars by default), so each fold is a short loop
inside one row.  Folds keep their seed as a sum and divide once, in bar order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def last_n(values: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)


def at_end(values: Column, back: int = 1) -> Column:
    """The back-th element from the end; null if there are fewer."""
    return F.get(values, F.size(values) - back)


def field(bars: Column, name: str) -> Column:
    return F.transform(bars, lambda b: b[name])


def _wilder(values: Column, period: int) -> Column:
    """(n, value) of Wilder's average: the mean of the first, then (a(p-1)+x)/p."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("a"))

    def step(s: Column, x: Column) -> Column:
        a = (
            F.when(s["n"] < period - 1, s["a"] + x)
            .when(s["n"] == period - 1, (s["a"] + x) / period)
            .otherwise((s["a"] * (period - 1) + x) / period)
        )
        return F.struct((s["n"] + 1).alias("n"), a.alias("a"))

    return F.aggregate(values, start, step)


def rsi_of(gain: Column, loss: Column) -> Column:
    """RSI of the averages of gains and losses."""
    return (
        F.when((gain == 0) & (loss == 0), 50.0)
        .when(loss == 0, 100.0)
        .when(gain == 0, 0.0)
        .otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    )


def _steps(closes: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(closes, 2, 1_000_000), F.slice(closes, 1, F.greatest(F.size(closes) - 1, F.lit(0))), lambda b, a: b - a)


def rsi(closes: Column, period: int = 14) -> Column:
    """Wilder's RSI of the last bar; null under period + 1 bars."""
    steps = _steps(closes)
    gain = _wilder(F.transform(steps, lambda d: F.greatest(d, F.lit(0.0))), period)["a"]
    loss = _wilder(F.transform(steps, lambda d: F.greatest(-d, F.lit(0.0))), period)["a"]
    return F.when(F.size(closes) > period, rsi_of(gain, loss))


def rsi_series(closes: Column, period: int = 14) -> Column:
    """RSI of every bar; the first ``period`` are null."""
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0.0).alias("g"), F.lit(0.0).alias("l"), none.alias("c"), F.array().cast("array<double>").alias("out")
    )

    def step(s: Column, c: Column) -> Column:
        d = c - s["c"]
        up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
        roll = lambda a, x: F.when(s["n"] < period, a + x).when(s["n"] == period, (a + x) / period).otherwise((a * (period - 1) + x) / period)
        g = F.when(s["n"] == 0, 0.0).otherwise(roll(s["g"], up))
        l = F.when(s["n"] == 0, 0.0).otherwise(roll(s["l"], down))  # noqa: E741
        value = F.when(s["n"] >= period, rsi_of(g, l))
        return F.struct((s["n"] + 1).alias("n"), g.alias("g"), l.alias("l"), c.alias("c"), F.concat(s["out"], F.array(value)).alias("out"))

    return F.aggregate(closes, start, step, lambda s: s["out"])


def rsi_windows(closes: np.ndarray, start: int, n: int = 250, period: int = 14) -> np.ndarray:
    """RSI at every bar from ``start`` on, each over the n bars that end with it (or all, if there are fewer).

    The folds of ``rsi_series`` in the same order, over all windows at once; nan
    where there are too few bars.
    """

    def folded(steps):
        g = l = np.zeros(1)  # noqa: E741
        for k, d in enumerate(steps, 1):
            up, down = np.maximum(d, 0.0), np.maximum(-d, 0.0)
            roll = (lambda a, x: a + x) if k < period else (lambda a, x: (a + x) / period) if k == period else (lambda a, x: (a * (period - 1) + x) / period)
            g, l = roll(g, up), roll(l, down)  # noqa: E741
            yield k, g, l

    def value(g, l):  # noqa: E741
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = 100 - 100 / (1 + g / l)
        return np.where((g == 0) & (l == 0), 50.0, np.where(l == 0, 100.0, np.where(g == 0, 0.0, mixed)))

    out = np.full(len(closes), np.nan)
    d = np.diff(closes)
    head = d[: n - 1]  # bars with all bars before them in the window
    for k, g, l in folded(head.reshape(-1, 1)):  # noqa: E741
        if k >= period:
            out[k] = value(g, l)[0]
    first = max(start, n)
    if first < len(closes):
        windows = np.lib.stride_tricks.sliding_window_view(d, n - 1)[first - n + 1 :]
        for _, g, l in folded(windows.T):  # noqa: E741, B007
            pass
        out[first:] = value(g, l) if n > period else np.nan
    return out[start:]


def true_range(bars: Column) -> Column:
    """True range of every bar; the first is high less low."""
    previous = F.concat(F.array(F.lit(None).cast("double")), F.slice(field(bars, "close"), 1, F.greatest(F.size(bars) - 1, F.lit(0))))
    return F.zip_with(
        bars,
        F.slice(previous, 1, F.size(bars)),
        lambda b, pc: F.greatest(b["high"] - b["low"], F.abs(b["high"] - pc), F.abs(b["low"] - pc)),
    )


def atr(bars: Column, period: int = 14) -> Column:
    """Wilder's average true range of the last bar; null under ``period`` bars."""
    return F.when(F.size(bars) >= period, _wilder(true_range(bars), period)["a"])


def atr_series(bars: Column, period: int = 14) -> Column:
    """ATR from the ``period``-th bar on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = (
            F.when(s["n"] < period - 1, s["a"] + x)
            .when(s["n"] == period - 1, (s["a"] + x) / period)
            .otherwise((s["a"] * (period - 1) + x) / period)
        )
        out = F.when(s["n"] >= period - 1, F.concat(s["out"], F.array(a))).otherwise(s["out"])
        return F.struct((s["n"] + 1).alias("n"), a.alias("a"), out.alias("out"))

    return F.aggregate(true_range(bars), start, step, lambda s: s["out"])


def atr_percentile(bars: Column, period: int = 14, lookback: int = 90) -> Column:
    """Share of the last ATR values that are at most the current one; 50 if history is short."""
    window = last_n(atr_series(bars, period), lookback)

    def share(w: Column) -> Column:
        return F.when(F.size(w) < 2, 50.0).otherwise(F.size(F.filter(w, lambda v: v <= F.element_at(w, -1))) * 100.0 / F.size(w))

    # bound once: the series is used three times
    return F.get(F.transform(F.array(window), share), F.lit(0))


def ema(values: Column, period: int) -> Column:
    """EMA of the last value, seeded by the mean of the first; null if too short."""
    k = 2.0 / (period + 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("a"))

    def step(s: Column, x: Column) -> Column:
        a = F.when(s["n"] < period - 1, s["a"] + x).when(s["n"] == period - 1, (s["a"] + x) / period).otherwise((x - s["a"]) * k + s["a"])
        return F.struct((s["n"] + 1).alias("n"), a.alias("a"))

    return F.when(F.size(values) >= period, F.aggregate(values, start, step)["a"])


def ema_series(values: Column, period: int) -> Column:
    """EMA of every value from the ``period``-th on; empty if there are fewer."""
    k = 2.0 / (period + 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = F.when(s["n"] < period - 1, s["a"] + x).when(s["n"] == period - 1, (s["a"] + x) / period).otherwise((x - s["a"]) * k + s["a"])
        out = F.when(s["n"] >= period - 1, F.concat(s["out"], F.array(a))).otherwise(s["out"])
        return F.struct((s["n"] + 1).alias("n"), a.alias("a"), out.alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def trend_label(closes: Column, fast: int = 20, slow: int = 50) -> Column:
    """uptrend or downtrend beyond one percent between the averages, else sideways."""
    gap = F.try_divide(ema(closes, fast) - ema(closes, slow), ema(closes, slow)) * 100
    return F.when(F.size(closes) < slow, "sideways").when(gap > 1, "uptrend").when(gap < -1, "downtrend").otherwise("sideways")


def relative_volume(volumes: Column, period: int = 20) -> Column:
    """The last volume over the mean of those before it."""
    before = F.slice(volumes, F.greatest(F.size(volumes) - period, F.lit(1)), period)
    mean = F.aggregate(before, F.lit(0.0), lambda a, v: a + v) / period
    return F.when((F.size(volumes) > period) & (mean > 0), F.try_divide(F.element_at(volumes, -1), mean))


def support(bars: Column, price: Column, lookback: int = 90, wing: int = 3) -> Column:
    """(price, distance_pct) of the highest swing low at or under the price; earliest of equal ones."""
    lows = field(last_n(bars, lookback), "low")

    def find(low: Column) -> Column:
        is_swing = lambda i: F.forall(
            F.sequence(F.lit(1), F.lit(wing)), lambda k: (F.get(low, i - k) > F.get(low, i)) & (F.get(low, i + k) > F.get(low, i))
        )
        inner = F.when(F.size(low) > 2 * wing, F.sequence(F.lit(wing), F.size(low) - wing - 1)).otherwise(F.array().cast("array<int>"))
        swings = F.transform(F.filter(inner, is_swing), lambda i: F.get(low, i))
        return F.array_max(F.filter(swings, lambda v: v <= price))

    best = F.get(F.transform(F.array(lows), find), F.lit(0))
    return F.when(best.isNotNull() & (best != 0), F.struct(best.alias("price"), (F.try_divide(price - best, best) * 100).alias("distance_pct")))


def body(bar: Column) -> Column:
    return F.abs(bar["close"] - bar["open"])


def is_hammer(b: Column) -> Column:
    size, top, bottom = body(b), F.greatest(b["open"], b["close"]), F.least(b["open"], b["close"])
    return (size > 0) & (b["high"] > b["low"]) & (bottom - b["low"] >= 2 * size) & (b["high"] - top <= 0.25 * (b["high"] - b["low"]))


def is_doji(b: Column) -> Column:
    span = b["high"] - b["low"]
    return (span > 0) & (F.try_divide(body(b), span) <= 0.10)


def is_engulfing(p: Column, b: Column) -> Column:
    return (p["close"] < p["open"]) & (b["close"] > b["open"]) & (b["open"] <= p["close"]) & (b["close"] >= p["open"])


def reversal(bars: Column) -> Column:
    """Name of the pattern on the last bar: hammer, bullish_engulfing, doji or null."""
    last, previous = at_end(bars, 1), at_end(bars, 2)
    return F.when(is_hammer(last), "hammer").when(F.coalesce(is_engulfing(previous, last), F.lit(False)), "bullish_engulfing").when(is_doji(last), "doji")


def rsi_recovery(series: Column, period: int = 14, back: int = 4, level: float = 30) -> Column:
    """RSI is over the level now and was not on one of the bars before."""
    before = F.slice(series, F.greatest(F.size(series) - back, F.lit(1)), back)
    found = (F.element_at(series, -1) > level) & F.exists(before, lambda v: v <= level)
    return F.when(F.size(series) >= period + back + 1, F.coalesce(found, F.lit(False))).otherwise(False)


def high_reclaim(bars: Column, lookback: int = 10) -> Column:
    """The last close is over the highest high of the bars before."""
    before = F.slice(field(bars, "high"), F.greatest(F.size(bars) - lookback, F.lit(1)), lookback)
    return F.when(F.size(bars) > lookback, at_end(bars)["close"] > F.array_max(before)).otherwise(False)


def bullish_divergence(closes: Column, series: Column, window: int = 14) -> Column:
    """Lower low in price and higher low in RSI between the halves of the window."""
    half = window // 2
    pairs = last_n(F.zip_with(closes, series, lambda c, r: F.struct(c.alias("c"), r.alias("r"))), window)

    def lowest(part: Column) -> Column:
        """The earliest of the lowest closes."""
        return F.reduce(part, F.get(part, F.lit(0)), lambda a, x: F.when(x["c"] < a["c"], x).otherwise(a))

    first, second = lowest(F.slice(pairs, 1, half)), lowest(F.slice(pairs, half + 1, window - half))
    found = (second["c"] < first["c"]) & (second["r"] > first["r"])
    return F.when((F.size(closes) >= window) & (F.size(series) >= window), F.coalesce(found, F.lit(False))).otherwise(False)
