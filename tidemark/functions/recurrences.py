"""Averages that fold a whole history, at every bar: RSI, ATR and EMA.

Each step of such a fold is an affine map of the value before it: a sum while
the seed is gathered (1, x / n), and (1 - k, k x) after it.  Maps compose, so a
key's history is cut into months: every month is scanned in a task of its own,
which gives each bar the map from the month's start to it; the months' maps are
joined by a prefix over a row a month, one after another; and a bar's value is its map applied to
what its month starts with.  No task holds more than a month of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import indicators as I

#: Names of the folded series of a bar; EMAs follow by their periods.
GAIN, LOSS, RANGE = "gain", "loss", "range"


def affine_scan(x: np.ndarray, first: int, n: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) at every value: the fold of all up to it is a times what came before plus b.

    ``first`` is the place of the first value in the whole series (values at
    places under 0 don't count); the first ``n`` values of the series are
    averaged, each later one moves the average by ``k`` of the difference.
    """
    at = first + np.arange(len(x))
    seed = at < n
    share = np.where(at < 0, 0.0, x / n)
    b = np.cumsum(np.where(seed, share, 0.0))
    a = np.ones(len(x))
    rest = np.flatnonzero(~seed)
    if len(rest):
        own = pd.Series(np.concatenate(([0.0], x[rest]))).ewm(alpha=k, adjust=False).mean().to_numpy()[1:]
        a[rest] = (1 - k) ** np.arange(1, len(rest) + 1)
        b[rest] = own + a[rest] * (b[rest[0] - 1] if rest[0] else 0.0)
    return a, b


def indicator_history(candles: DataFrame, period: int = 14, emas: Sequence[int] = (20, 50), keys: Sequence[str] = ("symbol", "interval")) -> DataFrame:
    """keys, open_time, rsi, atr and ``ema_<n>`` at every bar, folded from a key's first bar on.

    Null where there are too few bars, as in the folds over arrays.  Bars without
    a time, close, high or low are left out.
    """
    keys = list(keys)
    series = {GAIN: (period, 1 / period, 1), LOSS: (period, 1 / period, 1), RANGE: (period, 1 / period, 0)} | {f"ema_{n}": (n, 2 / (n + 1), 0) for n in emas}
    bars = candles.select(*keys, "open_time", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]).dropna(subset=["open_time", "high", "low", "close"])
    bars = bars.withColumn("month", F.date_trunc("month", "open_time"))
    months = bars.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("c"), F.max_by("close", "open_time").alias("last"))
    order = Window.partitionBy(*keys).orderBy("month")
    before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = months.select(*keys, "month", before.alias("first"), F.lag("last").over(order).alias("previous"))

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("open_time")  # Arrow's times; those of pandas end in 2262
        first, close = rows["first"][0].as_py(), rows["close"].to_numpy()
        previous = rows["previous"][0].as_py()
        earlier = np.concatenate(([np.nan if previous is None else previous], close[:-1]))
        step = np.where(np.isnan(earlier), 0.0, close - earlier)
        high, low = rows["high"].to_numpy(), rows["low"].to_numpy()
        spans = np.fmax(np.fmax(high - low, np.abs(high - earlier)), np.abs(low - earlier))
        values = {GAIN: np.maximum(step, 0.0), LOSS: np.maximum(-step, 0.0), RANGE: spans}
        out = rows.select([*keys, "month", "open_time"]).append_column("n", pa.array(first + np.arange(len(rows))))
        for name, (n, k, late) in series.items():
            a, b = affine_scan(values.get(name, close), first - late, n, k)
            out = out.append_column(f"a_{name}", pa.array(a)).append_column(f"b_{name}", pa.array(b))
        return out

    def carry(months: pa.Table) -> pa.Table:
        """What each month of a key starts with, from a row a month."""
        months = months.sort_by("month")
        a, b = (np.column_stack([months[f"{x}_{s}"].to_numpy() for s in series]) for x in "ab")
        starts = np.zeros_like(a)
        for i in range(1, len(starts)):
            starts[i] = a[i - 1] * starts[i - 1] + b[i - 1]
        out = months.select([*keys, "month"])
        for s, c in zip(series, starts.T):
            out = out.append_column(f"c_{s}", pa.array(np.ascontiguousarray(c)))
        return out

    schema = ", ".join(f"{c} {t}" for c, t in bars.select(*keys, "month", "open_time").dtypes)
    schema += ", n long, " + ", ".join(f"a_{s} double, b_{s} double" for s in series)
    maps = bars.join(starts, [*keys, "month"]).groupBy(*keys, "month").applyInArrow(scan, schema)
    ends = maps.groupBy(*keys, "month").agg(F.max_by(F.struct(*[c for c in maps.columns if c[:2] in ("a_", "b_")]), "open_time").alias("m")).select(*keys, "month", "m.*")
    schema = ", ".join(f"{c} {t}" for c, t in bars.select(*keys, "month").dtypes) + ", " + ", ".join(f"c_{s} double" for s in series)
    carries = ends.groupBy(*keys).applyInArrow(carry, schema)
    whole = maps.join(carries, [*keys, "month"])
    value = {s: F.col(f"a_{s}") * F.col(f"c_{s}") + F.col(f"b_{s}") for s in series}
    return whole.select(
        *keys,
        "open_time",
        F.when(F.col("n") >= period, I.rsi_of(value[GAIN], value[LOSS])).alias("rsi"),
        F.when(F.col("n") >= period - 1, value[RANGE]).alias("atr"),
        *[F.when(F.col("n") >= n - 1, value[f"ema_{n}"]).alias(f"ema_{n}") for n in emas],
    )
