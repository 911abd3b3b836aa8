"""The alert pass in blocks of a symbol equals one pass over the symbol."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.oracle import SF
from tests.test_tables import frame
from tidemark.operators import alerts
from tidemark.params import Alerts
from tidemark.plans import fixtures as X

MINUTE = 60_000_000


def one_pass(rows, at, score, p):
    return list(alerts.priors_in_order(rows, at, score, p))


def test_maps_of_blocks_equal_a_pass():
    r = random.Random(4)
    for _ in range(2000):
        p = Alerts(cooldown_minutes=r.choice((0, 1, 5, 30)), escalation_jump=r.choice((0, 1, 3, 10)))
        n = r.randrange(25)
        times = sorted(r.randrange(200) * MINUTE // r.choice((1, 2)) for _ in range(n))
        rows = [(None if r.random() < 0.05 and not i else t, None if r.random() < 0.1 else r.randrange(12), r.random() < 0.7) for i, t in enumerate(times)]
        cuts = sorted(r.randrange(n + 1) for _ in range(r.randrange(4)))
        prior = r.choice(((None, None), (r.randrange(-50, 250) * MINUTE, r.choice((None, 3, 9)))))
        state = prior
        for a, b in zip([0, *cuts], [*cuts, n]):
            can = [(alerts._NO_TIME if t is None else t, alerts._NO_SCORE if s is None else s) for t, s, c in rows[a:b] if c]
            m = alerts.send_map(np.array([c[0] for c in can], np.int64), np.array([c[1] for c in can], np.int64), p)
            state = alerts.after_block(m, *state, p)
        assert state == one_pass(rows, *prior, p)[-1], (rows, cuts, prior, p)


def test_hot_symbol_is_many_tasks(spark):
    r = random.Random(8)
    rows = [(i, "HOT" if r.random() < 0.9 else "B", f"2024-01-{1 + i // 200:02d} {r.randrange(24):02d}:{r.randrange(60):02d}:00", r.choice(("normal", "strong", "very_strong", None)), r.choice((None, *range(40, 100)))) for i in range(3000)]
    rows.append((9999, "HOT", None, "strong", 60))
    pending = frame(spark, rows, "id bigint, symbol string, detected_at timestamp_ntz, severity string, score int")
    priors = frame(spark, [("HOT", "2024-01-01 01:00:00", 70), ("GONE", "2024-01-01 00:00:00", 1)], "symbol string, sent_at timestamp_ntz, score int")
    cols = ["symbol", "id", "action", "reason", "override_cooldown", "bypass_quiet", "ok"]
    want = alerts.alert_pass(pending.withColumn("decided_at", F.col("detected_at")), priors, "decided_at", delivered=F.col("id") % 3 != 0)
    for hours in (1, 24, 24 * 365):
        got = alerts.alert_pass(pending, priors, "detected_at", delivered=F.col("id") % 3 != 0, block_hours=hours)
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_blocks_over_the_given_signals(spark):
    s = X.signals(spark, SF).filter("severity is not null")
    none = spark.createDataFrame([], "symbol string, sent_at timestamp_ntz, score int")
    got = alerts.alert_pass(s, none, "detected_at")
    want = alerts.alert_pass(s.withColumn("at", F.col("detected_at")), none, "at")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == s.count()
