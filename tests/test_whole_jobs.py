"""Queries and operators decide all rows of their tables."""

import datetime
import math
import random

from pyspark.sql import functions as F

from tests.oracle import SF
from tests.test_tables import BAR, bar, frame
from tidemark.functions import indicators as I
from tidemark.operators import alerts, transitions
from tidemark.plans import catalog
from tidemark.plans import fixtures as X
from tidemark.sources import candles as C


def test_alert_pass_decides_every_day(spark):
    want = X.signals(spark, SF).filter("severity is not null").orderBy("symbol", "detected_at", "id").collect()
    got = {r.id: r for r in catalog.alert_pass(spark, SF).collect()}
    assert len({r.detected_at.date() for r in want}) > 1 and set(got) == {r.id for r in want}
    last = {}
    for r in want:
        at, score = last.get(r.symbol, (None, None))
        hour = (r.detected_at.hour - 3) % 24
        cooling = at is not None and (r.detected_at - at).total_seconds() < 120 * 60
        quiet = (hour >= 22 or hour < 8) and r.severity != "very_strong"
        action = "skip_cooldown" if cooling and r.score - score < 10 else "queue" if quiet else "send_now"
        assert got[r.id].action == action
        if action == "send_now" and r.id % 7:
            last[r.symbol] = r.detected_at, r.score
    sent = [r for r in got.values() if r.action != "skip_cooldown"]
    assert catalog.alert_outbox(spark, SF).count() == len(sent)


def test_alert_pass_carries_a_send_over_arrow_batches(spark):
    rows = [(i, "AB"[i % 2], "strong", 60, f"2024-01-{2 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00") for i in range(3000)]
    p = frame(spark, rows, "id bigint, symbol string, severity string, score int, detected_at timestamp_ntz")
    priors = frame(spark, [("A", "2024-01-01 23:00:00", 60)], "symbol string, sent_at timestamp_ntz, score int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = alerts.alert_pass(p, priors, "detected_at").filter("action = 'send_now' and symbol = 'A'").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    open_minutes = [i for i in range(0, 3000, 2) if 8 <= (i // 60 - 3) % 24 < 22]
    want, last = [], -60
    for i in open_minutes:
        if i - last >= 120:
            want.append(i)
            last = i
    assert [r.id for r in got] == want


def test_replay_follows_a_position_to_its_sale_or_the_last_bar(spark):
    bars = frame(spark, [bar(0, 100 if d < 9 else 50, day=d) for d in range(1, 11)], BAR)
    rows = [(1, "A", "2024-01-01 00:00:00", 100.0, None), (2, "A", "2024-01-01 00:00:00", 100.0, "2024-01-06 00:00:00"), (3, "A", "2024-01-20 00:00:00", 100.0, None)]
    buys = frame(spark, rows, "id bigint, symbol string, bought_at timestamp_ntz, price double, sold_at timestamp_ntz")
    got = transitions.replay_sells(buys, bars).orderBy("id", "open_time").collect()
    assert [(r.id, r.open_time.day) for r in got] == [(1, d) for d in range(1, 11)] + [(2, d) for d in range(1, 6)]
    assert [r.open_time.day for r in got if r.rule == "stop_loss"] == [9, 10]
    assert transitions.replay_sells(buys.drop("sold_at"), bars).filter("id = 2").count() == 10


def test_rsi_on_every_bar_of_long_histories(spark):
    rows = [(s, "1h", f"{2020 + i // 400}-{1 + i // 28 % 12:02d}-{1 + i % 28:02d} 00:00:00", 100 + (i * i * k) % 37 / 3) for s, k, n in (("A", 7, 620), ("B", 5, 12), ("C", 3, 250)) for i in range(n)]
    bars = frame(spark, rows, "symbol string, interval string, open_time timestamp_ntz, close double").dropDuplicates(["symbol", "open_time"])
    got = {(r.symbol, r.open_time): r.rsi for r in C.rsi_of_bars(bars).collect()}
    want = {}
    for s in "ABC":
        mine = sorted((r.open_time, r.close) for r in bars.filter(F.col("symbol") == s).collect())
        windows = [(t, [c for _, c in mine[max(0, i - 249) : i + 1]]) for i, (t, _) in enumerate(mine)]
        df = spark.createDataFrame(windows, "t timestamp_ntz, closes array<double>")
        want |= {(s, r.t): r.v for r in df.select("t", F.element_at(I.rsi_series(F.col("closes")), -1).alias("v")).collect()}
    assert got == want and len(got) > 700


def test_rsi_query_has_all_bars(spark):
    assert catalog.rsi_on_every_bar(spark, SF).count() == X.candles(X.ticks_orders(spark, SF), "1h").count()
    assert all(r.n > 0 for r in catalog.rsi_on_every_bar(spark, SF).groupBy("symbol").agg(F.count("rsi").alias("n")).collect())


def test_replay_in_days_equals_a_walk(spark):
    r, nan, at = random.Random(5), float("nan"), lambda d, h, m=0: f"2024-01-{d:02d} {h:02d}:{m:02d}:00"
    closes = [("AB"[i % 2], at(d, h), r.choice((None, nan, *[r.uniform(-5, 200) for _ in range(12)]))) for d in range(1, 11) if d not in (4, 5) for h in range(24) for i in range(2) if r.random() < 0.5]
    buys = [(i, r.choice("ABZ"), at(r.randrange(1, 13), r.randrange(24), r.choice((0, 30))), r.choice((None, nan, 0.0, r.uniform(1, 150))), r.choice((None, at(r.randrange(1, 12), r.randrange(24))))) for i in range(60)]
    bars = frame(spark, closes, "symbol string, open_time timestamp_ntz, close double")
    held = frame(spark, buys, "id bigint, symbol string, bought_at timestamp_ntz, price double, sold_at timestamp_ntz")
    for days in (None, 3, 1):
        got = transitions.replay_sells(held, bars, days=days)
        assert "Window" not in got.select("id", "watermark")._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]  # positions aren't sorted
        want = []
        for i, symbol, bought, price, sold in buys:
            end = sold if days is None else (datetime.datetime.fromisoformat(bought) + datetime.timedelta(days)).isoformat(" ")
            seen, rank = [], lambda v: (math.isnan(v), v)
            for t, close in sorted((t, c) for s, t, c in closes if s == symbol and bought <= t and (end is None or t < end)):
                top = max((v for v in (price, *seen) if v is not None), key=rank, default=None) if seen else None
                want.append((i, t, str(top)))
                seen.append(close)
        assert sorted((x.id, str(x.open_time), str(x.watermark)) for x in got.collect()) == sorted(want) and want
