import pytest

from tests.oracle import SF, compare
from tidemark.plans import catalog, further, streams  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_do_not_depend_on_partitions(spark):
    a = sorted(map(str, catalog.expectancy_report(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, catalog.expectancy_report(spark, SF).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_new_blocks_equal_whole_windows(spark):
    """Frames over small blocks see what frames over the whole key see."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.plans import fixtures as X
    from tidemark.sources import candles as C

    bars = X.candles(X.ticks_events(spark, SF), "1h")
    keys = ["symbol", "interval"]
    want = bars.select("symbol", "open_time", F.sum("close").over(Window.partitionBy(*keys).orderBy("open_time").rowsBetween(-7, 0)).alias("s"))
    for size in (8, 50):
        rows = C.in_blocks(bars, 7, size=size)
        got = rows.select("own", "symbol", "open_time", F.sum("close").over(Window.partitionBy(*keys, "block").orderBy("open_time").rowsBetween(-7, 0)).alias("s")).filter("own").drop("own")
        key = lambda df: sorted((r.symbol, r.open_time, round(r.s, 6)) for r in df.collect())
        assert key(got) == key(want)
