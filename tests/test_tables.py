"""Ingestion, table transitions, evaluation and alerts on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import alerts, evaluation, expectancy, readers, reports, transitions
from tidemark.sources import candles as C


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def frame(spark, rows, schema):
    """Rows with times as text."""
    plain = schema.replace("timestamp_ntz", "string")
    df = spark.createDataFrame(rows, plain)
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (f.strip().split(" ") for f in schema.split(","))])


BAR = "symbol string, interval string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, close_time timestamp_ntz"


def bar(h, price, high=None, low=None, symbol="A", day=1):
    t = f"2024-01-{day:02d} {h:02d}:00:00"
    return (symbol, "1h", t, float(price), float(high or price), float(low or price), float(price), 1.0, f"2024-01-{day:02d} {h:02d}:59:59")


def test_ingest(spark):
    batch = frame(spark, [bar(h, h) for h in range(6)] + [bar(2, 99)], BAR)
    state = frame(spark, [("A", "1h", "2024-01-01 01:00:00")], "symbol string, interval string, last_open_time timestamp_ntz")
    got = C.incremental(batch, state, ts("2024-02-01 00:00:00"))
    assert sorted(r.open_time.hour for r in got.collect()) == [2, 2, 3, 4, 5]
    assert C.incremental(batch, state, ts("2024-01-01 01:00:00")).count() == 0
    assert sorted(r.open_time.hour for r in C.incremental(batch, state.limit(0), ts("2024-02-01 00:00:00"), 2).collect()) == [4, 5]
    new = C.new_bars(got, frame(spark, [bar(5, 5)], BAR))
    assert sorted((r.open_time.hour, r.open) for r in new.collect()) == [(2, 2.0), (3, 3.0), (4, 4.0)]
    assert C.new_bars(got, new.unionByName(frame(spark, [bar(5, 5)], BAR))).count() == 0
    assert C.advance_state(state, batch).first().last_open_time.hour == 5
    assert C.advance_state(state, batch.limit(0)).first().last_open_time.hour == 1
    assert {(r.symbol, r.n_new) for r in C.ingest_report(new).collect()} == {("A", 3), (None, 3)}
    raw = spark.createDataFrame([("A", "1h", ["0", "1", "2", "0.5", "1.5", "3", "3599999"]), ("A", "1h", ["x"])], C.RAW)
    parsed = C.parse_klines(raw)
    assert [r.bad for r in parsed.orderBy("bad").collect()] == [False, True]
    assert C.closed_bars(parsed, 3599999).count() == 1 and C.closed_bars(parsed, 3599998).count() == 0


def test_retention(spark):
    t = frame(spark, [bar(h, h) for h in range(7)] + [bar(h, h, symbol="B") for h in range(2)], BAR)
    kept = C.retention_split(t, {"1h": 3})
    assert kept.filter("not keep").count() == 4
    assert sorted(r.open_time.hour for r in kept.filter("keep and symbol = 'A'").collect()) == [4, 5, 6]
    assert C.retention_split(t, {"1h": 0}).filter("not keep").count() == 0 and C.retention_split(t, {}).filter("not keep").count() == 0


def test_signal_escalation(spark):
    rows = [(1, "A", "2024-01-01 00:01:00", "normal"), (2, "A", "2024-01-01 00:02:00", "strong"), (3, "A", "2024-01-01 00:03:00", "normal"), (4, "A", "2024-01-01 00:04:00", "strong"), (5, "A", "2024-01-01 00:05:00", "very_strong"), (6, "A", "2024-01-01 00:06:00", None)]
    c = frame(spark, rows, "id bigint, symbol string, detected_at timestamp_ntz, severity string").withColumn("candle_hour", ts("2024-01-01 00:00:00"))
    got = {r.id: r.reason for r in transitions.insert_outcomes(c).collect()}
    assert got == {1: "inserted", 2: "escalated", 3: "superseded", 4: "duplicate", 5: "escalated", 6: "below_threshold"}
    again = {r.id: r.reason for r in transitions.insert_outcomes(c, c).collect()}
    assert again[5] == "duplicate" and again[1] == "superseded"


def test_watchlist(spark):
    now = ts("2024-01-03 00:00:00")
    old = frame(spark, [(1, s, "watching", e) for s, e in (("A", "2024-01-03 00:00:00"), ("B", "2024-01-04 00:00:00"), ("C", "2024-01-04 00:00:00"), ("D", "2024-01-04 00:00:00"))], "id bigint, symbol string, status string, expires_at timestamp_ntz")
    names = [f.split(" ") for f in schemas.TABLES["watchlist"].split(", ")]
    old = old.select(*[F.col(n) if n in old.columns else F.lit(None).cast(t).alias(n) for n, t in names])
    scan = spark.createDataFrame(
        [("A", 40, None, None, False), ("B", 20, None, None, False), ("C", 55, None, 7, True), ("D", 55, None, 8, False), ("E", 36, None, None, False), ("F", 10, None, None, False), ("G", 90, "very_strong", 9, True)],
        "symbol string, score int, severity string, signal_id bigint, inserted boolean",
    )
    acts, table = transitions.watch_pass(transitions.expire_stale(old, now), scan, now)
    assert {r.symbol: r.action for r in acts.collect()} == {"A": "WATCH", "B": "EXPIRE", "C": "PROMOTE", "D": "PROMOTE", "E": "WATCH", "F": "IGNORE"}
    got = sorted((r.symbol, r.status, r.resolution_reason or "") for r in table.collect())
    assert got == [("A", "expired", "expired_stale"), ("A", "watching", ""), ("B", "expired", "below_floor"), ("C", "promoted", "promoted"), ("D", "watching", ""), ("E", "watching", "")]
    with pytest.raises(ValueError):
        transitions.watch_action(F.lit(1), F.lit(True), 30, 40)


def test_sell_rules(spark):
    def rule(price, top=None, regime=None):
        return spark.range(1).select(transitions.sell_rule(F.lit(100.0), F.lit(price), F.lit(top).cast("double"), F.lit(regime).cast("string")).alias("r")).first().r

    assert rule(92.0) == "stop_loss" and rule(92.1) is None and rule(92.0, 150.0) == "stop_loss"
    assert rule(120.0) == "take_profit" and rule(120.0, 140.0) == "trailing_stop" and rule(95.0, None, "risk_off") == "context_deterioration"
    assert rule(-1.0) is None


def test_sell_pass_cooldown_and_watermark(spark):
    pos = spark.createDataFrame([(1, "A", 100.0), (2, "A", 150.0), (3, "Z", 1.0)], "id bigint, symbol string, price double")
    closes = spark.createDataFrame([("A", 130.0)], "symbol string, close double")
    tracking = frame(spark, [("A", 1, 140.0, "2024-01-01 00:00:00")], "symbol string, buy_id bigint, high_watermark double, updated_at timestamp_ntz")
    fired = frame(spark, [(2, "stop_loss", "2024-01-02 18:00:00")], "buy_id bigint, rule_triggered string, detected_at timestamp_ntz")
    for now, ids in (("2024-01-03 00:00:00", [1, 2]), ("2024-01-02 23:59:59", [1])):
        judged, sells, moved = transitions.sell_pass(pos, closes, tracking, fired, ts(now))
        assert sorted(r.buy_id for r in sells.collect()) == ids
    assert {r.id: r.no_price for r in judged.collect()} == {1: False, 2: False, 3: True}
    assert sorted((r.buy_id, r.high_watermark, r.updated_at.day) for r in moved.collect()) == [(1, 140.0, 1), (2, 150.0, 2)]


def test_ledger(spark):
    signals = spark.createDataFrame([(5,)], "id bigint")
    rows = spark.createDataFrame([(1, 2.0, 10.0, None, None), (2, 0.0, 1.0, None, None), (3, 1.0, -1.0, None, None), (4, 1.0, 1.0, 0.0, None), (5, 1.0, 1.0, None, 6), (6, 1.0, 1.0, None, 5)], "id bigint, price double, amount_invested double, quantity double, signal_id bigint")
    got = {r.id: (r.error, r.quantity) for r in transitions.validate_buys(rows, signals).collect()}
    assert got[1] == (None, 5.0) and [got[k][0] for k in (2, 3, 4, 5, 6)] == ["price", "amount", "quantity", "signal", None]
    buys = frame(spark, [(1, "2024-01-02 00:00:00", None, None, None), (2, "2024-01-02 00:00:00", "2024-01-03 00:00:00", 1.0, None)], "id bigint, bought_at timestamp_ntz, sold_at timestamp_ntz, sold_price double, sold_note string")
    sales = frame(spark, [(1, "2024-01-05 00:00:00", 2.0, "b"), (1, "2024-01-04 00:00:00", 3.0, "a"), (2, "2024-01-04 00:00:00", 1.0, None), (9, "2024-01-04 00:00:00", 1.0, None), (1, "2024-01-01 00:00:00", 1.0, None)], "buy_id bigint, sold_at timestamp_ntz, sold_price double, sold_note string")
    stamped, judged = transitions.record_sales(buys, sales)
    assert {r.id: r.sold_price for r in stamped.collect()} == {1: 3.0, 2: 1.0}
    assert sorted((r.buy_id, r.error or "") for r in judged.collect()) == [(1, ""), (1, "already_sold"), (1, "time"), (2, "already_sold"), (9, "unknown")]
    with pytest.raises(ValueError):
        readers.buys(buys, "lost")


def test_signal_evaluation_known_values(spark):
    bars = [bar(0, 40, day=1), bar(0, 41, day=2), bar(0, 50, high=50, low=44, day=4), bar(0, 40, high=40, low=38, day=5), bar(0, 44, day=8), bar(0, 48, day=31)]
    signals = frame(spark, [(1, "A", "2024-01-01 00:00:00", 40.0), (2, "Z", "2024-01-01 00:00:00", 0.0)], "id bigint, symbol string, candle_hour timestamp_ntz, price_at_signal double")
    none = spark.createDataFrame([], "signal_id bigint")
    got = {r.signal_id: r for r in evaluation.evaluate_signals(signals, none, frame(spark, bars, BAR), ts("2024-02-01 00:00:00")).collect()}
    r = got[1]
    assert (r.price_24h_later, r.price_7d_later, r.price_30d_later) == (41.0, 44.0, 48.0)
    assert (r.max_gain_7d_pct, r.time_to_mfe_hours, r.max_loss_7d_pct, r.time_to_mae_hours, r.verdict) == (25.0, 72.0, -5.0, 96.0, "great")
    assert got[2].verdict == "pending" and got[2].max_gain_7d_pct is None
    done = spark.createDataFrame([(1,), (2,)], "signal_id bigint")
    assert evaluation.evaluate_signals(signals, done, frame(spark, bars, BAR), ts("2024-02-01 00:00:00")).count() == 0
    assert evaluation.evaluate_signals(signals, none, frame(spark, bars, BAR), ts("2024-01-30 23:59:59")).count() == 0


def test_expectancy(spark):
    schema = "severity string, regime_at_signal string, score int, dominant_trigger_timeframe string, return_7d_pct double, max_gain_7d_pct double, max_loss_7d_pct double, time_to_mfe_hours double, time_to_mae_hours double"
    rows = [("strong", None, 70, "7d", x, None, None, None, None) for x in (10.0, -5.0, 20.0, -10.0, None)]
    got = {(r.dimension, r.bucket): r for r in expectancy.report(spark.createDataFrame(rows, schema)).collect()}
    r = got["overall", "all"]
    assert (r["count"], r.win_rate, r.avg_win, r.avg_loss, r.expectancy, r.profit_factor) == (5, 50.0, 15.0, -7.5, 3.75, 2.0)
    assert set(got) == {("overall", "all"), ("severity", "strong"), ("trigger", "7d"), ("score", "65-79")}
    (r,) = expectancy.report(spark.createDataFrame([], schema)).collect()
    assert r["count"] == 0 and r.win_rate is None and r.profit_factor is None
    wins, losses = (expectancy.report(spark.createDataFrame([("a", None, 1, None, x, None, None, None, None)], schema)).first().profit_factor for x in (1.0, -1.0))
    assert wins is None and losses == 0.0


def test_alert_pass_chains(spark):
    rows = [(1, "A", "strong", 60, "2024-01-01 15:00:00"), (2, "A", "strong", 65, "2024-01-01 15:30:00"), (3, "A", "very_strong", 80, "2024-01-01 16:00:00"), (4, "A", "normal", 50, "2024-01-01 18:00:00"), (5, "A", "strong", 70, "2024-01-02 02:00:00"), (6, "A", "very_strong", 80, "2024-01-02 02:01:00")]
    p = frame(spark, rows, "id bigint, symbol string, severity string, score int, detected_at timestamp_ntz")
    none = frame(spark, [], "symbol string, sent_at timestamp_ntz, score int")
    got = {r.id: (r.action, r.reason) for r in alerts.alert_pass(p, none, "detected_at").collect()}
    assert got[1] == ("send_now", "fresh") and got[2] == ("skip_cooldown", "cooldown:30m<120m") and got[3] == ("send_now", "escalation_override")
    assert got[4] == ("send_now", "fresh") and got[5] == ("queue", "quiet_hours") and got[6] == ("send_now", "very_strong_bypass_quiet")
    failed = {r.id: r.action for r in alerts.alert_pass(p, none, "detected_at", delivered=F.col("id") > 1).collect()}
    assert failed[2] == "send_now"


def test_queue_flush_and_tags(spark):
    n = frame(spark, [(1, "2024-01-01 00:00:00", None, True, False, 0, None), (2, "2024-01-01 00:00:00", None, True, False, 1, "x")], "id bigint, created_at timestamp_ntz, sent_at timestamp_ntz, queued boolean, delivered boolean, delivery_attempts int, last_error string")
    res = spark.createDataFrame([(1, True, None), (2, False, "boom")], "id bigint, ok boolean, error string")
    got = {r.id: r for r in alerts.flush_queue(n, res, ts("2024-01-01 15:00:00")).collect()}
    assert got[1].delivered and not got[1].queued and got[1].delivery_attempts == 1
    assert not got[2].delivered and got[2].queued and (got[2].delivery_attempts, got[2].last_error) == (2, "boom")
    assert not any(r.delivered for r in alerts.flush_queue(n, res, ts("2024-01-01 02:00:00")).collect())
    assert spark.range(1).select(alerts.merge_tags(F.lit("a,b"), F.lit("b, c"))).first()[0] == "a,b,c"


def test_activity_prefers_signals_on_ties(spark):
    s = frame(spark, [(1, "A", "2024-01-01 00:00:00"), (2, "A", "2024-01-02 00:00:00")], "id bigint, symbol string, detected_at timestamp_ntz")
    got = [(r.kind, r.id) for r in reports.activity(s, s, 3).collect()]
    assert got == [("signal", 2), ("sell", 2), ("signal", 1)]


def test_raw_blocks_of_messages(spark):
    row = ("BTCUSDT", 71, "strong", "drop_7d=-12.3% | rsi_1h=18", "7d", 12.25, 18.5, None, 2.0, 0.0, 1.5e-05, 12345678.0, 25.5, None, "risk_off", 50.0, "hammer", 1.0, 0.00001234)
    names = "symbol score severity trigger_reason dominant_trigger_timeframe drop_trigger_pct rsi_1h rsi_4h rel_volume drop_24h_pct drop_7d_pct drop_30d_pct distance_from_30d_high_pct distance_from_180d_high_pct regime_at_signal price_at_signal reversal_pattern dist_support_pct support_level_price".split()
    kinds = {"symbol": "string", "score": "int", "severity": "string", "trigger_reason": "string", "dominant_trigger_timeframe": "string", "regime_at_signal": "string", "reversal_pattern": "string"}
    df = spark.createDataFrame([row], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
    got = df.select(alerts.title(F.col("symbol"), F.col("severity"), True).alias("t"), alerts.body(True).alias("b")).first()
    assert got.t == "🟡 Vale observar — BTC (BTCUSDT)"
    lines = ["BTC @ $50", "Variação 24h: estável", "• Queda de 12.2% em 7 dias", "• RSI em sobrevenda extrema (18)", "• Volume 2.0x acima do normal", "Mercado adverso (risk-off)", "", "Sinais moderados — acompanhe antes de agir.", ""]
    lines += ["--- debug ---", "pair=BTCUSDT score=71 severity=strong", "trigger=drop_7d=-12.3% | rsi_1h=18", "dom_tf=7d drop_trigger=12.25", "rsi_1h=18.5 rsi_4h=None", "rel_vol=2.0", "drop_24h=0.0 drop_7d=1.5e-05 drop_30d=12345678.0", "disc_30d=25.5 disc_180d=None", "regime=risk_off"]
    assert got.b == "\n".join(lines)
    sell = frame(spark, [("ETHUSDT", "stop_loss", "high", 7, 1234567.0, -8.125, None, None, "2024-01-01 10:00:00")], "symbol string, rule_triggered string, severity string, buy_id bigint, price_at_signal double, pnl_pct double, reason string, regime_at_signal string, detected_at timestamp_ntz")
    got = sell.select(alerts.sell_title(F.col("symbol"), F.col("rule_triggered"), True).alias("t"), alerts.sell_body(True).alias("b")).first()
    assert got.t == "🔴 Stop-loss acionado — ETH (ETHUSDT / stop_loss)"
    assert got.b.split("\n") == ["ETH @ $1.23457e+06", "Resultado: -8.12%", "", "Decisão sugerida: proteger capital — considere sair.", "", "--- debug ---", "pair=ETHUSDT rule=stop_loss severity=high", "buy_id=7 price=1234567.0 pnl=-8.125", "regime=None", "detected_at=2024-01-01T10:00:00Z"]
