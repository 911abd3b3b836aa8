"""The stored table of candles: pruned inserts and retention that leaves other files alone."""

import io
import uuid
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tests.test_tables import frame
from tidemark.schemas import TABLES
from tidemark.sources import bar_table as B
from tidemark.sources import candles as C


@pytest.fixture
def table(spark, tmp_path):
    base = f"t{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{tmp_path}'")
    B.create(spark, f"{base}.bars")
    yield f"{base}.bars"
    spark.sql(f"DROP DATABASE {base} CASCADE")


def bars(spark, days, symbols="AB", interval="1h", close=1.0):
    rows = [(s, interval, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} {h:02d}:00:00", 1.0, 2.0, 0.5, close, 1.0, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} {h:02d}:59:59") for s in symbols for d in days for h in (0, 12)]
    return frame(spark, rows, TABLES["candles"])


def files(spark, table):
    spark.catalog.refreshTable(table)
    return {(r[0], r[1], r[2].rsplit("/", 1)[-1]) for r in spark.table(table).select("interval", "month", F.input_file_name()).distinct().collect()}


def test_insert_reads_the_months_of_the_batch(spark, table):
    B.insert(spark, table, bars(spark, range(84)))
    B.insert(spark, table, bars(spark, range(84), interval="1d"))
    before = files(spark, table)
    batch = bars(spark, range(50, 60), close=9.0).unionByName(bars(spark, [90], close=9.0)).unionByName(bars(spark, [90], close=7.0))
    batch = batch.unionByName(bars(spark, [1]).withColumn("open_time", F.lit(None).cast("timestamp_ntz")))
    plan = io.StringIO()
    with redirect_stdout(plan):
        B.fresh(spark, table, batch).explain("formatted")
    scans = [x for x in plan.getvalue().splitlines() if "PartitionFilters" in x]
    assert any("2024-02" in x and "2024-04" in x and "2024-01" not in x for x in scans), plan.getvalue()
    B.insert(spark, table, batch)
    B.insert(spark, table, batch)  # a rerun adds nothing
    got = spark.table(table).filter("interval = '1h'")
    assert got.count() == 84 * 4 + 4 and {r.close for r in got.filter("month = '2024-04'").collect()} == {7.0}
    assert got.filter("month < '2024-04' and close <> 1").isEmpty()
    assert before <= files(spark, table)


def test_retention_rewrites_what_loses_rows(spark, table):
    whole = bars(spark, range(84)).unionByName(bars(spark, range(84), "A", "1d"))
    B.insert(spark, table, whole)
    before = files(spark, table)
    want = C.retention_split(whole, {"1h": 80, "1d": 0}).filter("keep").drop("keep")
    done = B.retain(spark, table, {"1h": 80, "1d": 0})
    assert sorted((r.month, r.n_deleted, r.n_kept) for r in done.collect()) == [("2024-01", 112, 0), ("2024-02", 64, 48)]
    spark.catalog.refreshTable(table)
    got = spark.table(table).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    after = files(spark, table)
    quiet = {f for f in before if f[0] == "1d" or f[1] == "2024-03"}
    assert quiet <= after and not {f for f in after if f[:2] == ("1h", "2024-01")} and not (before - quiet) & after
    assert B.retain(spark, table, {"1h": 80, "1d": 0}).count() == 0 and files(spark, table) == after


def test_many_partitions_go_in_few_statements(spark, table, monkeypatch):
    B.insert(spark, table, bars(spark, range(140), "ABCDE"))
    assert len(files(spark, table)) == 5  # a file for each month
    said, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: said.append(text) or sql(self, text, *a, **k))
    B.retain(spark, table, {"1h": 10})
    assert len([x for x in said if "DROP" in x]) == 1
    assert {f[1] for f in files(spark, table)} == {"2024-05"} and spark.table(table).count() == 50
