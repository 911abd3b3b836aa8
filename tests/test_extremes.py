"""Extremes of spans against brute force, switches of the passes, and pages of buys."""

import random

from pyspark.sql import functions as F

from tests.test_tables import frame, ts
from tidemark import schemas
from tidemark.operators import evaluation, readers, transitions
from tidemark.params import Sell, Watch


def test_extremes_of_spans(spark):
    r = random.Random(9)
    stamp = lambda h: f"2024-{1 + h // 672:02d}-{1 + h // 24 % 28:02d} {h % 24:02d}:00:00"
    bars = [(s, stamp(h), float(r.randrange(5)), float(-r.randrange(5))) for s in "AB" for h in range(0, 1300) if r.random() < 0.2 and not (s == "B" and 300 < h < 700)]
    points = [(s, stamp(r.randrange(0, 1300))) for s in "ABC" for _ in range(60)] + [("A", "2024-01-04 00:00:00"), ("A", "2024-01-11 00:00:00")]
    bar_rows = frame(spark, bars, "symbol string, open_time timestamp_ntz, high double, low double")
    point_rows = frame(spark, points, "symbol string, t0 timestamp_ntz").distinct()
    for days in (1, 7):
        got = {(x.symbol, x.t0): tuple(x)[2:] for x in evaluation.extremes(point_rows, bar_rows, days).collect()}
        want, held = {}, bar_rows.withColumn("us", evaluation._us(F.col("open_time"))).collect()
        for p in point_rows.withColumn("us", evaluation._us(F.col("t0"))).collect():
            own = [b for b in held if b.symbol == p.symbol and p.us <= b.us <= p.us + days * 86_400_000_000]
            if own:
                top, bottom = max(own, key=lambda b: (b.high, -b.us)), min(own, key=lambda b: (b.low, b.us))
                want[p.symbol, p.t0] = (top.high, top.us, bottom.low, bottom.us)
        assert got == want and len(got) > 50
    assert evaluation.extremes(point_rows, bar_rows.limit(0)).count() == 0


def test_passes_that_are_switched_off(spark):
    now = ts("2024-01-05 00:00:00")
    old = frame(spark, [(1, "A", "watching", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 40, "2024-01-03 00:00:00", None, None, None)], schemas.TABLES["watchlist"])
    scan = frame(spark, [("A", 10, None, None, False), ("B", 40, None, None, False)], "symbol string, score int, severity string, signal_id bigint, inserted boolean")
    off = Watch(enabled=False)
    actions, table = transitions.watch_pass(transitions.expire_stale(old, now, off), scan, now, off)
    assert actions.count() == 0 and table.collect() == old.collect()
    pos = frame(spark, [(1, "A", "2024-01-01 00:00:00", 100.0, None)], "id bigint, symbol string, bought_at timestamp_ntz, price double, sold_at timestamp_ntz")
    closes = spark.createDataFrame([("A", 50.0)], "symbol string, close double")
    tracking = frame(spark, [("A", 1, 100.0, "2024-01-01 00:00:00")], schemas.TABLES["sell_tracking"])
    fired = spark.createDataFrame([], "buy_id bigint, rule_triggered string, detected_at timestamp_ntz")
    judged, sells, moved = transitions.sell_pass(pos, closes, tracking, fired, now, p=Sell(enabled=False))
    assert judged.count() == sells.count() == 0 and moved.count() == 1
    assert transitions.sell_pass(pos, closes, tracking, fired, now)[1].count() == 1


def test_pages_of_buys(spark):
    rows = frame(spark, [(i, "A", f"2024-01-0{i} 00:00:00", None) for i in range(1, 6)], "id bigint, symbol string, bought_at timestamp_ntz, sold_at timestamp_ntz")
    page = lambda **k: [r.id for r in readers.buys(rows, **k).collect()]
    assert page(limit=2, offset=1) == [2, 3] and page(limit=2, offset=-3) == [1, 2]
    assert page(limit=-1) == page(limit=0, offset=2) == page() == [1, 2, 3, 4, 5]
