"""Counters observed in the pass, ids of new rows and marks of sent sell signals."""

from pyspark.sql import functions as F

from tests.test_tables import frame
from tidemark import schemas
from tidemark.operators import alerts, reports, transitions


def test_counters_come_with_the_write(spark):
    seen = reports.ScanCounters()
    outcomes = frame(spark, [("inserted", True), ("escalated", True), ("duplicate", False), (None, None)], "reason string, inserted boolean")
    seen.of("outcomes", outcomes).write.format("noop").mode("overwrite").save()
    row = seen.row()
    assert (row["scored"], row["inserted"], row["escalated"], row["duplicates"], row["superseded"]) == (4, 2, 1, 1, 0)
    assert row["sent"] == row["expired_stale"] == 0  # parts that took no part
    assert seen.report(spark).columns == list(row)


def test_next_ids_are_dense_and_repeatable(spark):
    rows = spark.range(1000).select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("key"))
    for earlier, first in ((spark.createDataFrame([(41,), (7,)], "id long"), 42), (spark.createDataFrame([], "id long"), 1), (spark.createDataFrame([("x",)], "other string"), 1)):
        a, b = (sorted(map(tuple, transitions.with_next_ids(rows.repartition(n), earlier, ["key"]).collect())) for n in (1, 7))
        assert a == b and [r[0] for r in a] == list(range(first, first + 1000))
    assert transitions.with_next_ids(rows.limit(0), schemas.empty(spark, "watchlist"), ["key"]).count() == 0


def test_sends_mark_sell_signals(spark):
    sells = frame(spark, [(1, False), (2, False), (3, True), (4, None)], "id bigint, alerted boolean")
    got = alerts.sent_sells(sells, frame(spark, [(1, True), (1, True), (2, False), (None, True)], "id bigint, ok boolean"))
    assert {r.id: r.alerted for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}
