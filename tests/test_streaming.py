"""Streams give what the batch operators give over the same rows."""

import datetime
import random

from pyspark.sql import functions as F

from tests.test_tables import BAR, bar, frame, ts
from tidemark import schemas
from tidemark.operators import alerts, transitions
from tidemark.streaming import jobs


def feed(spark, path, frames):
    """A file stream of the frames, one file each, and a function that runs it."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(spark, df, out, restarts=1):
    """The rows of a job over all its input; further runs go on from the checkpoint."""
    for _ in range(restarts):
        writer = jobs.to_files(df, f"{out}/o", f"{out}/c").trigger(availableNow=True)
        jobs.start(writer, spark, partitions=2).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/o")


def test_settings_of_the_session_stay(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    run(spark, jobs.ingest(feed(spark, str(tmp_path / "in"), [frame(spark, [bar(0, 1)], BAR)])), str(tmp_path / "t"))
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_ingest_stream(spark, tmp_path):
    a, b = [bar(h, h) for h in range(4)], [bar(3, 77), bar(1, 1), bar(5, 5), bar(5, 6)]
    stream = feed(spark, str(tmp_path / "in"), [frame(spark, a, BAR), frame(spark, b, BAR)])
    got = run(spark, jobs.ingest(stream), str(tmp_path / "t"), 2)  # the second run finds nothing new
    assert sorted((r.open_time.hour, r.close) for r in got.collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (5, 5.0)]
    marks = jobs.state_of(spark, str(tmp_path / "t" / "c"), "mark").select("key.symbol", "value.us").collect()
    assert [r.us for r in marks] == [(ts_value(2024, 1, 1, 5))]


def ts_value(*parts):
    return int(datetime.datetime(*parts, tzinfo=datetime.timezone.utc).timestamp() * 1_000_000)


SIGNAL = "id bigint, symbol string, detected_at timestamp_ntz, candle_hour timestamp_ntz, severity string, score int"


def test_signal_stream_equals_batch(spark, tmp_path):
    sev = ["normal", "strong", "normal", "very_strong", None, "strong", "very_strong", "normal"]
    rows = [(i, "AB"[i % 2], f"2024-01-01 15:{i * 7:02d}:00", "2024-01-01 15:00:00", s, 50 + 5 * i if i % 3 else None) for i, s in enumerate(sev)]
    stream = feed(spark, str(tmp_path / "in"), [frame(spark, r, SIGNAL) for r in (rows[:3], rows[3:6])])
    df = jobs.insert_signals(stream)
    run(spark, df, str(tmp_path / "s"))
    frame(spark, rows[6:], SIGNAL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/9")
    got = run(spark, df, str(tmp_path / "s"))  # goes on with the state of the first run
    want = transitions.insert_outcomes(frame(spark, rows, SIGNAL))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_alert_stream_on_shuffled_rows(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.choice("AAAB"), f"2024-01-0{1 + i // 60} {r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", None, r.choice(("normal", "strong", "very_strong", None)), r.choice((None, *range(50, 90)))) for i in range(180)]
    end = [(999, "END", "2024-02-01 00:00:00", None, "normal", 1)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    frames = [frame(spark, shuffled[k::4], SIGNAL) for k in range(4)] + [frame(spark, end, SIGNAL)]
    priors = frame(spark, [("A", "2024-01-01 00:00:00", 60), ("C", "2024-01-01 00:00:00", 60)], "symbol string, sent_at timestamp_ntz, score int")
    ok = F.col("id") % 5 != 0
    got = run(spark, jobs.alert(feed(spark, str(tmp_path / "in"), frames), delivered=ok, delay="10 days", priors=priors), str(tmp_path / "a"), 2)
    want = alerts.alert_pass(frame(spark, rows, SIGNAL), priors, "detected_at", delivered=ok)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    held = jobs.state_of(spark, str(tmp_path / "a" / "c"), "due").select("key.symbol").collect()
    assert [h.symbol for h in held] == ["END"]  # only what nothing newer has followed


SCAN = "symbol string, score int, severity string, signal_id bigint, inserted boolean, scanned_at timestamp_ntz"


def test_watch_stream_equals_scans(spark, tmp_path):
    r = random.Random(7)
    scans = []
    for h in range(0, 198, 22):
        at = ts(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00")
        some = [s for s in "ABCDE" if r.random() < 0.35] + ["Z"]
        scans.append((at, [(s, 10 if s == "Z" else r.choice((20, 38, 40, 45, 55)), r.choice((None, None, None, "normal")), h * 10 + i, r.random() < 0.7) for i, s in enumerate(some)]))
    table = schemas.empty(spark, "watchlist")
    names = ["symbol", "score", "severity", "signal_id", "inserted"]
    for at, rows in scans:
        candidates = spark.createDataFrame(rows, "symbol string, score int, severity string, signal_id bigint, inserted boolean").select(names)
        table = transitions.watch_pass(transitions.expire_stale(table, at), candidates, at)[1]
        table = spark.createDataFrame(table.collect(), table.schema)
    frames = [spark.createDataFrame(rows, "symbol string, score int, severity string, signal_id bigint, inserted boolean").withColumn("scanned_at", at) for at, rows in scans]
    stream = feed(spark, str(tmp_path / "in"), frames[:5])
    df = jobs.watch(stream)
    run(spark, df, str(tmp_path / "w"))
    for i, f in enumerate(frames[5:]):  # after a restart
        f.coalesce(1).write.parquet(f"{tmp_path}/in/{5 + i}")
    got = jobs.watch_table(run(spark, df, str(tmp_path / "w")))
    cols = [c for c in table.columns if c != "id"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, table.select(cols).collect()))
    found = got.collect()
    assert {w.resolution_reason for w in found} == {"expired_stale", "below_floor", "promoted", None}
    assert sorted(w.id for w in found) == list(range(1, len(found) + 1))
    open_watches = jobs.state_of(spark, str(tmp_path / "w" / "c"), "open").select("key.symbol").collect()
    assert sorted(o.symbol for o in open_watches) == sorted(w.symbol for w in found if w.status == "watching")


def test_sell_stream_equals_batch(spark, tmp_path):
    prices = [100, 110, 98, 130, 115, 90]
    pos = frame(spark, [(1, "A", "2024-01-01 00:00:00", 100.0)], "id bigint, symbol string, bought_at timestamp_ntz, price double")
    bars = frame(spark, [bar(h, p) for h, p in enumerate(prices)], BAR)
    ticks = bars.select(F.lit(1).cast("bigint").alias("id"), F.lit(100.0).alias("entry"), "open_time", "close")
    cut = ts("2024-01-01 03:00:00")
    stream = feed(spark, str(tmp_path / "in"), [ticks.filter(F.col("open_time") < cut), ticks.filter(F.col("open_time") >= cut)])
    q = jobs.sell_watermarks(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    want = transitions.replay_sells(pos, bars)
    key = lambda df: sorted((r.open_time, r.watermark, r.rule) for r in df.collect())
    assert key(got) == key(want)


def test_deduplicated_stream(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), [frame(spark, [bar(0, 1), bar(0, 1)], BAR), frame(spark, [bar(0, 1), bar(1, 1)], BAR)])
    q = jobs.deduplicated(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_sell_rows_stream_equals_scans(spark, tmp_path):
    pos = frame(
        spark,
        [*[(i, "AB"[i % 2], "2024-01-01 00:00:00", 100.0, None) for i in range(1, 5)], (7, "A", "2024-01-01 00:00:00", 100.0, "2024-01-01 02:00:00"), (8, "A", "2024-01-01 00:00:00", None, None), (9, "GONE", "2024-01-01 00:00:00", 1.0, None)],
        "id bigint, symbol string, bought_at timestamp_ntz, price double, sold_at timestamp_ntz",
    )
    schema = "symbol string, close double, close_time timestamp_ntz"
    scans = [[("A", 130.0, h), ("B", b, h)] for h, b in enumerate((99.0, 91.0, 90.0, None, 140.0, 120.0, 95.0, 89.0, 88.0))]
    scans = [[(s, c, f"2024-01-01 {h:02d}:59:59") for s, c, h in scan] for scan in scans]
    regime = spark.createDataFrame([("risk_off",)], "label string")
    df = jobs.sells(feed(spark, str(tmp_path / "in"), [frame(spark, sum(scans[:4], []), schema)]), pos, regime=regime)
    run(spark, df, str(tmp_path / "s"))
    for i, s in enumerate((scans[4:6], scans[6:])):  # after a restart
        frame(spark, sum(s, []), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{4 + i}")
    got = run(spark, df, str(tmp_path / "s"))
    tracking, fired = schemas.empty(spark, "sell_tracking"), spark.createDataFrame([], "buy_id bigint, rule_triggered string, detected_at timestamp_ntz")
    want = []
    for scan in scans:
        now = ts(scan[0][2])
        _, found, tracking = transitions.sell_pass(pos.filter(F.col("sold_at").isNull() | (F.col("sold_at") > now)), frame(spark, scan, schema), tracking, fired, now, F.lit("risk_off"))
        found = found.drop("id")
        rows = found.collect()
        want += rows
        fired = spark.createDataFrame([*fired.collect(), *[(r.buy_id, r.rule_triggered, r.detected_at) for r in rows]], fired.schema)
        tracking = spark.createDataFrame(tracking.collect(), tracking.schema)
    assert sorted(map(str, got.select(found.columns).collect())) == sorted(map(str, want))
    assert {r.rule_triggered for r in want} >= {"take_profit", "trailing_stop", "stop_loss", "context_deterioration"}
    state = jobs.state_of(spark, str(tmp_path / "s" / "c"), "tracking").select("key.id", "value.high_watermark").collect()
    open_now = {r.id for r in pos.filter("sold_at is null").collect()}
    assert sorted(map(tuple, state)) == sorted((r.buy_id, r.high_watermark) for r in tracking.collect() if r.buy_id in open_now and r.high_watermark is not None)


def test_state_of_silent_positions_goes(spark, tmp_path):
    pos = frame(spark, [(1, "A", 100.0, None), (2, "B", 100.0, None)], "id bigint, symbol string, price double, sold_at timestamp_ntz")
    schema = "symbol string, close double, close_time timestamp_ntz"
    frames = [frame(spark, [("A", 99.0, "2024-01-01 00:00:00"), ("B", 99.0, "2024-01-01 00:00:00")], schema), frame(spark, [("B", 98.0, "2024-01-09 00:00:00")], schema)]
    run(spark, jobs.sells(feed(spark, str(tmp_path / "in"), frames), pos, days=7), str(tmp_path / "s"))
    assert [r.id for r in jobs.state_of(spark, str(tmp_path / "s" / "c"), "tracking").select("key.id").collect()] == [2]


def test_sell_stream_with_missing_prices(spark, tmp_path):
    bars = frame(spark, [bar(h, p) for h, p in enumerate([100.0, 1.0, 150.0, 120.0])], BAR)
    bars = bars.withColumn("close", F.when(F.col("close") > 1, F.col("close")))
    pos = frame(spark, [(1, "A", "2024-01-01 00:00:00", 100.0)], "id bigint, symbol string, bought_at timestamp_ntz, price double")
    ticks = bars.select(F.lit(1).cast("bigint").alias("id"), F.lit(100.0).alias("entry"), "open_time", "close")
    q = jobs.sell_watermarks(feed(spark, str(tmp_path / "in"), [ticks])).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.open_time, r.watermark, r.rule) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "o"))) == key(transitions.replay_sells(pos, bars))


def test_positions_share_rows_of_state(spark, tmp_path):
    pos = frame(spark, [(i if i else None, "A", 100.0 + i, "2024-01-01 03:00:00" if i % 5 == 1 else None) for i in range(40)], "id bigint, symbol string, price double, sold_at timestamp_ntz")
    scans = [("A", c, f"2024-01-0{1 + h // 12} {h % 12:02d}:59:59") for h, c in enumerate((130.0, None, 91.0, 150.0, 120.0, 99.0))]
    frames = [frame(spark, s, "symbol string, close double, close_time timestamp_ntz") for s in (scans[:2], scans[2:])]
    got = run(spark, jobs.sells(feed(spark, str(tmp_path / "in"), frames), pos, buckets=3), str(tmp_path / "s"))
    tracking, fired, want = schemas.empty(spark, "sell_tracking"), spark.createDataFrame([], "buy_id bigint, rule_triggered string, detected_at timestamp_ntz"), []
    for scan in scans:
        now, known = ts(scan[2]), pos.filter("id is not null")
        _, found, tracking = transitions.sell_pass(known.filter(F.col("sold_at").isNull() | (F.col("sold_at") > now)), frame(spark, [scan], "symbol string, close double, close_time timestamp_ntz"), tracking, fired, now)
        want += (rows := found.drop("id").collect())
        fired = spark.createDataFrame([*fired.collect(), *[(r.buy_id, r.rule_triggered, r.detected_at) for r in rows]], fired.schema)
        tracking = spark.createDataFrame(tracking.collect(), tracking.schema)
    assert want and sorted(map(str, got.filter("buy_id is not null").select(found.drop("id").columns).collect())) == sorted(map(str, want))
    assert {r.rule_triggered for r in got.filter("buy_id is null").collect()} == {"take_profit", "stop_loss", "trailing_stop"}
    stored = spark.read.format("statestore").option("stateVarName", "tracking").load(str(tmp_path / "s" / "c"))
    assert stored.count() <= 3 and jobs.state_of(spark, str(tmp_path / "s" / "c"), "tracking").count() == 32


def test_held_alerts_are_packed(spark, tmp_path):
    r, big = random.Random(3), 2**60
    rows = [(big + i if i else None, "A", f"2024-01-0{1 + r.randrange(4)} {r.randrange(24):02d}:{r.randrange(60):02d}:00", None, r.choice(("normal", "very_strong", None)), r.choice((None, *range(50, 90)))) for i in range(600)]
    frames = [frame(spark, rows[k::3], SIGNAL) for k in range(3)] + [frame(spark, [(1, "END", "2024-01-06 12:30:00", None, "normal", 1)], SIGNAL)]
    out = str(tmp_path / "a")
    df = jobs.alert(feed(spark, str(tmp_path / "in"), frames), delivered=F.col("id") % 5 != 0, delay="4 days")
    some = run(spark, df, out).count()  # up to the middle of the second day
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{out}/c").filter("key.symbol = 'A'").count()
    assert 0 < some < 600 and 0 < held < 20
    frame(spark, [(2, "END", "2024-03-01 00:00:00", None, "normal", 1)], SIGNAL).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    got = run(spark, df, out).filter("symbol = 'A'")
    want = alerts.alert_pass(frame(spark, rows, SIGNAL), frame(spark, [], "symbol string, sent_at timestamp_ntz, score int"), "detected_at", delivered=F.col("id") % 5 != 0)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
