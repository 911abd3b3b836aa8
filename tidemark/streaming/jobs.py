"""Structured Streaming jobs that carry the batch operators.

Each job is a streaming DataFrame whose state Spark keeps: ``transformWithState``
on RocksDB, so a restart goes on from the checkpoint and a batch that is run
again gives the same rows.  No job lists or rewrites a table.  The rules are the
column rules of the batch operators; the state only adds what came before a row.

``start`` runs such a job with any sink.  Rows of a key within a micro-batch are
sorted, so their order in the files doesn't matter; ``maxFilesPerTrigger`` or
the like bounds what a batch brings.

Columns that only a state step sees end in an underscore: names that begin with
one are not kept on the way into it.

State goes when it is no longer needed: highest severities and
watches by event-time timers, positions at their sale or after a long silence,
held alerts when the watermark releases them.  The watermark's column is the
event time plus the allowed delay, so timers fire at the event time of the
newest row while rows up to the delay behind it still count.  Alerts alone are
held for the delay, as their order matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from ..operators import alerts, transitions
from ..params import Alerts, Scoring, Sell, Watch
from ..schemas import TABLES
from ..sources import candles as C

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: Parts of a symbol's positions in the join with its closes.
SPREAD = 32
#: No time or number, in arrays and packed rows of the state.
NONE = -(2**63)


def start(writer: DataStreamWriter, spark: SparkSession, partitions: int | None = None) -> StreamingQuery:
    """Start a query whose state is in RocksDB; the session's own settings stay as they are.

    ``partitions`` is the number of state partitions, which a checkpoint keeps
    for good (the session's shuffle partitions if not given).
    """
    wish = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
    if partitions:
        wish["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wish}
    try:
        for k, v in wish.items():
            spark.conf.set(k, v)
        return writer.start()  # takes a copy of the settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_files(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to Parquet files, each row exactly once over restarts."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A named value or map state of a checkpoint as a table (key, value or user_map_key and user_map_value).

    Positions, which are kept in buckets, come out as a row each.
    """
    table = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    if "value" not in table.columns or "id array<bigint>" not in _schema(table.select("value.*")):
        return table
    fields = [c for c, t in table.select("value.*").dtypes if t.startswith("array")]
    rows = table.select("value.*").select(F.inline(F.arrays_zip(*fields))).filter(~F.isnan("high_watermark"))
    return rows.select(F.struct("id").alias("key"), F.struct(*[F.nullif(F.col(c), F.lit(NONE)).alias(c) if c.endswith("_us") else F.col(c) for c in fields[1:]]).alias("value"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable", na_position="first", ignore_index=True)


def _value(state):
    """The fields of a value state; None if there is none."""
    return state.get() if state.exists() else None


def _none(v):
    return None if pd.isna(v) else v


def _with_event_time(df: DataFrame, time: str, delay: str, hold: bool = False) -> DataFrame:
    """Rows with a time, with its microseconds in ``us_`` and a watermark at the newest of them (``hold``: the delay behind it)."""
    us = alerts.micros(F.col(time))
    at = F.timestamp_micros(us)
    if not hold:
        at = at + F.expr(f"interval {delay}")
    return df.filter(F.col(time).isNotNull()).withColumns({"us_": us, "at_": at}).withWatermark("at_", delay)


# --- bars --------------------------------------------------------------------


class _Bars(StatefulProcessor):
    """The newest open time of a symbol and interval."""

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, ["us_", "close_time", "open", "high", "low", "close", "volume"]).drop_duplicates("us_")
        mark = _value(self.mark)
        fresh = rows if mark is None else rows[rows["us_"] > mark[0]]
        if len(fresh):
            self.mark.update((int(fresh["us_"].max()),))
        yield fresh.drop(columns="us_")

    def close(self) -> None:
        pass


def ingest(bars: DataFrame) -> DataFrame:
    """First-wins bars as they come; late and repeated ones are dropped.

    A bar at or before its key's mark is late, as in the batch ingest; of several
    rows of a bar in a batch the least by value stays.  Bars without a time are
    left out.  State: a mark for each symbol and interval.
    """
    rows = bars.filter(F.col("open_time").isNotNull()).withColumn("us_", alerts.micros(F.col("open_time")))
    return rows.groupBy(*C.KEY).transformWithStateInPandas(_Bars(), _schema(bars), "append", "None")


def deduplicated(bars: DataFrame, delay: str = "2 days") -> DataFrame:
    """Bars once each within an event-time watermark, without a table."""
    return bars.withColumn("at", F.col("open_time").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(C.BAR).drop("at")


# --- signals -------------------------------------------------------------------


class _Highest(StatefulProcessor):
    """The highest severity of a symbol and candle hour."""

    def __init__(self, days: float):
        self.keep = int(days * DAY_MS)

    def init(self, handle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", "rank int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, ["us_", "id"])
        old = _value(self.top)
        ranks = rows["rank_"].fillna(0).astype(int).to_numpy()
        tops = np.maximum.accumulate(np.concatenate([[old[0] if old else 0], ranks]))
        if tops[-1] > 0:
            self.top.update((int(tops[-1]),))
            if not old:
                self.handle.registerTimer(int(rows["us_"].iloc[-1]) // 1000 + self.keep)
        yield rows.drop(columns=["us_", "at_"]).assign(max_=pd.Series([int(t) or None for t in tops[:-1]], dtype="object"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.top.clear()
        return iter(())

    def close(self) -> None:
        pass


def insert_signals(candidates: DataFrame, days: float = 7, delay: str = "1 hour") -> DataFrame:
    """Outcomes of candidates against what was inserted before them.

    State: the highest severity of each symbol and candle hour; it goes when the
    newest candidate is ``days`` beyond its first ones.  Candidates without a
    time, or over ``delay`` behind the newest one of earlier batches, are left out.
    """
    ranked = candidates.withColumn("rank_", transitions.severity_rank(F.col("severity")))
    rows = _with_event_time(ranked, "detected_at", delay)
    kept = rows.groupBy("symbol", "candle_hour").transformWithStateInPandas(_Highest(days), _schema(ranked) + ", max_ int", "append", "EventTime")
    return transitions.with_outcome(kept.withColumnsRenamed({"rank_": "_rank", "max_": "_max"}))


class _Sends(StatefulProcessor):
    """The last send of a symbol, and its rows that the watermark has not reached.

    Rows are held as Arrow pieces by blocks of time, so a piece and not each row
    is an entry of the state; a release reads a block at a time.
    """

    #: Rows of a symbol that come together before they are cut into pieces, and microseconds of a block.
    ROWS, BLOCK = 1 << 18, DAY_MS * 1000
    HELD = ["us_", "id", "severity", "score", "now_us_", "ok", "can_"]

    def __init__(self, p: Alerts, names: list[str]):
        self.p, self.names = p, names

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block long, piece long", "rows binary")
        self.sent = handle.getValueState("sent", "us long, score long")
        self.due = handle.getValueState("due", "ms long, pieces long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for us, score in initialState[["sent_us", "sent_score"]].itertuples(index=False):
            self.sent.update(tuple(None if pd.isna(v) else int(v) for v in (us, score)))

    def _hold(self, rows: pd.DataFrame, pieces: int) -> int:
        """Rows written as a piece for each block; the number of the next piece."""
        for block, own in rows.groupby(rows["us_"] // self.BLOCK):
            batch, sink = pa.RecordBatch.from_pandas(own, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            self.held.updateValue((int(block), pieces), (sink.getvalue().to_pybytes(),))
            pieces += 1
        return pieces

    def _block(self, block: int, pieces: list[int]) -> pd.DataFrame:
        read = lambda n: pa.ipc.open_stream(bytes(self.held.getValue((block, n))[0])).read_pandas()
        return pd.concat([read(n) for n in pieces], ignore_index=True)

    def _wait(self, us: int, pieces: int) -> None:
        """A timer at the first held row."""
        ms, due = -(-us // 1000), _value(self.due)
        if due is not None and due[0] <= ms:
            ms = due[0]
        else:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(ms)
        self.due.update((ms, pieces))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = (_value(self.due) or (None, 0))[1]
        first, parts = [], []
        for part in rows:
            first.append(int(part["us_"].min()))
            parts.append(part[self.HELD])
            if sum(map(len, parts)) >= self.ROWS:
                pieces, parts = self._hold(pd.concat(parts), pieces), []
        if parts:
            pieces = self._hold(pd.concat(parts), pieces)
        self._wait(min(first), pieces)
        return iter(())

    def _passed(self, rows: pd.DataFrame, last: tuple) -> tuple[pd.DataFrame, tuple]:
        """Rows in order with the send before each, and the last send after them."""
        severity = pd.factorize(rows["severity"], sort=True)[0]
        rows = rows.iloc[np.lexsort([rows["ok"], rows["now_us_"], rows["score"], severity, rows["id"], rows["us_"]])]
        can = rows["can_"].to_numpy(bool)
        none = lambda c: [None if v == NONE else v for v in rows[c].to_numpy()[can].tolist()]
        sends = list(alerts.priors_in_order(zip(none("now_us_"), none("score"), can[can]), *last, self.p))
        before = np.array([[NONE if v is None else v for v in s] for s in sends], np.int64)[np.cumsum(can) - can]
        return rows.assign(_prior_us=before[:, 0], _prior_score=before[:, 1]), sends[-1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        blocks: dict[int, list[int]] = {}
        for block, piece in self.held.keys():
            blocks.setdefault(block, []).append(piece)
        pieces, last = _value(self.due)[1], _value(self.sent) or (None, None)
        self.due.clear()
        for block in sorted(blocks):
            held = self._block(block, sorted(blocks[block]))
            ready = held["us_"] <= reached
            if ready.any():
                for piece in blocks[block]:
                    self.held.removeKey((block, piece))
                out, last = self._passed(held[ready], last)
                if not ready.all():
                    pieces = self._hold(held[~ready], pieces)
                yield out.assign(symbol=key[0])[self.names]
            if not ready.all():
                self._wait(int(held["us_"][~ready].min()), pieces)
                break
        if last[0] is not None or last[1] is not None:
            self.sent.update(last)

    def close(self) -> None:
        pass


def alert(signals: DataFrame, p: Alerts = Alerts(), delivered=None, delay: str = "1 hour", priors: DataFrame | None = None, clock: str = "detected_at") -> DataFrame:
    """Decisions on signals that may come in any order.

    Rows are held until the watermark reaches them and then pass in order of
    time, so shuffled batches give the rows of ``alerts.alert_pass``.  A row that
    is more than ``delay`` behind the newest one is late and dropped; rows at the
    end of the input are held until something newer comes.  ``priors`` are sends
    from before the stream.  State: the last send and the held rows of a symbol,
    which are packed by days, so a release needs the memory of a day.
    """
    rows = alerts.judged(signals, clock, p, delivered).withColumnsRenamed({"_us": "now_us_", "_can": "can_"})
    rows = _with_event_time(rows, "detected_at", delay, hold=True)
    rows = rows.select("symbol", "us_", "severity", "ok", "can_", "at_", *[F.coalesce(c, F.lit(NONE)).alias(c) for c in ("id", "score", "now_us_")])
    out = "symbol string, id long, severity string, score long, now_us_ long, ok boolean, _prior_us long, _prior_score long"
    first = None
    if priors is not None:
        first = priors.select("symbol", alerts.micros(F.col("sent_at")).alias("sent_us"), F.col("score").cast("bigint").alias("sent_score")).groupBy("symbol")
    processor = _Sends(p, [c.split(" ")[0] for c in out.split(", ")])
    kept = rows.groupBy("symbol").transformWithStateInPandas(processor, out, "append", "EventTime", initialState=first)
    kept = kept.withColumns({c: F.nullif(F.col(c), F.lit(NONE)) for c in ("id", "score", "now_us_", "_prior_us", "_prior_score")})
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return alerts.decided(kept.withColumn("now", F.timestamp_add("MICROSECOND", F.col("now_us_"), zero)), p)


# --- watchlist -----------------------------------------------------------------

#: A version of a watch; the newest of each symbol and first_seen_at is its row of the watchlist.
WATCHES = (
    "symbol string, status string, first_us long, last_us long, last_score int, expires_us long, promoted_signal_id bigint, resolved_us long, "
    "resolution_reason string, version int"
)


class _Watch(StatefulProcessor):
    """The open watch of a symbol."""

    def __init__(self, p: Watch):
        self.keep = int(p.hours * HOUR_MS * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us long, last_us long, score int, expires_us long, version int")

    def _row(self, symbol: str, status: str, watch: tuple, signal=None, at=None, why=None) -> tuple:
        first, last, score, until, version = watch
        return symbol, status, first, last, score, until, signal, at, why, version

    def _ended(self, symbol: str, status: str, watch: tuple, at: int, why: str, signal=None) -> tuple:
        self.open.clear()
        self.handle.deleteTimer(-(-watch[3] // 1000))
        return self._row(symbol, status, (*watch[:4], watch[4] + 1), signal, at, why)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, watch = [], _value(self.open)
        for r in _ordered(rows, ["us_", "score", "signal_id"]).itertuples(index=False, name="Scan"):
            now, score, signal, inserted, with_watch, without = r[:6]
            now = int(now)
            if watch and watch[3] <= now:
                out.append(self._ended(key[0], "expired", watch, now, "expired_stale"))
                watch = None
            action = with_watch if watch else without
            if watch and action == "EXPIRE":
                out.append(self._ended(key[0], "expired", watch, now, "below_floor"))
                watch = None
            elif watch and action == "PROMOTE" and _none(inserted):
                out.append(self._ended(key[0], "promoted", watch, now, "promoted", _none(signal)))
                watch = None
            elif action == "WATCH":
                if watch:
                    self.handle.deleteTimer(-(-watch[3] // 1000))
                watch = (watch[0] if watch else now, now, _none(score), now + self.keep, watch[4] + 1 if watch else 0)
                self.open.update(watch)
                self.handle.registerTimer(-(-watch[3] // 1000))
                out.append(self._row(key[0], "watching", watch))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch, now = _value(self.open), timerValues.getCurrentWatermarkInMs() * 1000
        out = [self._ended(key[0], "expired", watch, now, "expired_stale")] if watch and watch[3] <= now else []
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in WATCHES.split(", ")], dtype="object")

    def close(self) -> None:
        pass


def watch(candidates: DataFrame, p: Watch = Watch(), s: Scoring = Scoring(), delay: str = "1 hour") -> DataFrame:
    """Versions of watches over scans, as they open, are refreshed and end.

    ``candidates`` has symbol, score, severity, signal_id, inserted and
    scanned_at; a candidate with a severity takes no part.  Each symbol's scans
    pass in order of time.  A watch that no scan of its symbol ends in time is
    ended by a timer, without a row for it; it is stamped with the newest scan by
    then, as a scan of the batch form stamps what it finds stale.  State: the open
    watch of a symbol.  ``watch_table`` makes the watchlist of the versions.
    """
    action = lambda has: transitions.watch_action(F.col("score"), F.lit(has), s.min_score, p.floor)
    rows = _with_event_time(candidates.filter(F.col("severity").isNull() & p.enabled), "scanned_at", delay)
    rows = rows.select("us_", "score", "signal_id", "inserted", action(True).alias("with_"), action(False).alias("without_"), "symbol", "at_")
    return rows.groupBy("symbol").transformWithStateInPandas(_Watch(p), WATCHES, "append", "EventTime")


def watch_table(versions: DataFrame) -> DataFrame:
    """The watchlist after all versions so far; ids by first_seen_at and symbol."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    time = lambda c: F.timestamp_add("MICROSECOND", c, zero)
    fields = [c for c in versions.columns if c not in ("symbol", "first_us", "version")]
    newest = versions.groupBy("symbol", "first_us").agg(F.max_by(F.struct(*fields), "version").alias("w"))
    rows = newest.select(
        "symbol",
        "w.status",
        time(F.col("first_us")).alias("first_seen_at"),
        time(F.col("w.last_us")).alias("last_seen_at"),
        "w.last_score",
        time(F.col("w.expires_us")).alias("expires_at"),
        "w.promoted_signal_id",
        time(F.col("w.resolved_us")).alias("resolved_at"),
        "w.resolution_reason",
    )
    names = [f.split(" ")[0] for f in TABLES["watchlist"].split(", ")]
    return C.numbered(rows, [], ["first_seen_at", "symbol"]).withColumn("id", F.col("n") + 1).select(*names)


# --- positions -----------------------------------------------------------------


class _Positions(StatefulProcessor):
    """The positions of a bucket: watermark, when each rule last gave a sell signal, and until when to keep it.

    They are one value of arrays, so a bucket is read and written once in a batch;
    each step of the rules takes the next row of all its positions.
    """

    STATE = "id array<long>, high_watermark array<double>, updated_us array<long>, until_ms array<long>, " + ", ".join(f"{r}_us array<long>" for r in transitions.SELL_RULES) + ", due_ms long"

    def __init__(self, p: Sell, days: float, names: list[str]):
        self.p, self.keep, self.names = p, int(days * DAY_MS), names

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracking", self.STATE)

    def _read(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int | None]:
        """Ids in order (those of the state and ``ids``), tops, their times, until, times of rules and the timer."""
        old = self.state.get()
        known = np.array(old[0] if old else [], np.int64)
        every = np.union1d(known, ids)
        top, times = np.full(len(every), np.nan), np.full((2 + len(transitions.SELL_RULES), len(every)), NONE, np.int64)
        if old:
            at = np.searchsorted(every, known)
            top[at] = np.array(old[1], float)
            times[:, at] = np.array(old[2:-1], np.int64)
        return every, top, times[0], times[1], times[2:], old[-1] if old else None

    def _write(self, ids, top, updated, until, fired, due: int | None) -> None:
        """The state, with a timer no later than the first position that may go."""
        first = int(until.min()) if len(ids) else None
        if due is not None and (first is None or first < due):
            self.handle.deleteTimer(due)
            due = None
        if first is None:
            self.state.clear()
            return
        if due is None:
            self.handle.registerTimer(first)
            due = first
        self.state.update((*[x.tolist() for x in (ids, top, updated, until, *fired)], due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, ["id", "us_", "now_price"])
        own, begin, count = np.unique(rows["id"].to_numpy(np.int64), return_index=True, return_counts=True)
        us, sold, rule, trailed = (rows[c].to_numpy(np.int64) for c in ("us_", "sold_us_", "rule", "trailed"))
        entry, close = rows["price"].to_numpy(float), rows["now_price"].to_numpy(float)
        ids, top, updated, until, fired, due = self._read(own)
        places = np.searchsorted(ids, own)
        place, live = np.repeat(places, count), np.ones(len(ids), bool)
        given, wait, fall = np.zeros(len(rows), np.int64), self.p.cooldown_hours * 3600, 1 - self.p.trailing / 100
        more = np.argsort(-count, kind="stable")
        for k in range(int(count.max())):
            more = more[: np.searchsorted(-count[more], -k, "left")]  # positions with a row of this number
            i = begin[more] + k
            live[place[i[sold[i] <= us[i]]]] = False
            i = i[live[place[i]] & (close[i] > 0)]
            j = place[i]
            found = np.where((top[j] > 0) & (close[i] <= top[j] * fall), trailed[i], rule[i])
            i_, j_, r_ = i[found > 0], j[found > 0], found[found > 0] - 1
            last = fired[r_, j_]
            fires = (last == NONE) | (wait <= 0) | ((us[i_] - np.where(last == NONE, us[i_], last)) // 1_000_000 >= wait)
            fired[r_[fires], j_[fires]] = us[i_[fires]]
            given[i_[fires]] = r_[fires] + 1
            high = np.fmax(np.fmax(top[j], entry[i]), close[i])
            rises = np.isnan(top[j]) | (high > top[j])
            top[j[rises]], updated[j[rises]] = high[rises], us[i[rises]]
        until[places] = np.maximum(until[places], us[begin + count - 1] // 1000 + self.keep)
        self._write(ids[live], top[live], updated[live], until[live], fired[:, live], due)
        out = rows[given > 0]
        yield out.assign(rule=np.array(transitions.SELL_RULES, object)[given[given > 0] - 1])[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, top, updated, until, fired, _ = self._read(np.zeros(0, np.int64))
        stay = until > timerValues.getCurrentWatermarkInMs()
        self._write(ids[stay], top[stay], updated[stay], until[stay], fired[:, stay], None)
        return iter(())

    def close(self) -> None:
        pass


def sells(closes: DataFrame, positions: DataFrame, p: Sell = Sell(), regime: DataFrame | None = None, days: float = 90, delay: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Sell rows, with every rule and its cooldown, as closes come; each close time is a scan.

    ``closes`` has symbol, close and close_time; ``positions`` is a table with id,
    symbol, price, sold_at (null: open) and perhaps bought_at, ``regime`` one with a row (label).
    Positions meet closes in a join of the stream with the table by symbol and one
    of ``SPREAD`` parts, so a symbol with many positions is many tasks.  State of
    each position: its watermark and the last time of each rule; it goes at the
    sale, or if no close has come for ``days``.  The positions of a bucket (a hash
    of the id, of ``buckets``, which a checkpoint keeps for good) share a row of
    state, so a batch costs a call to Python for each bucket and not for each position.
    """
    label = F.lit(None).cast("string")
    rows = closes.filter(F.lit(p.enabled)).withColumnRenamed("close", "now_price")
    if regime is not None:
        rows, label = rows.crossJoin(F.broadcast(regime.select(F.col("label").alias("regime_")).limit(1))), F.col("regime_")
    rows = _with_event_time(rows.withColumn("context_", label), "close_time", delay)
    since = alerts.micros(F.col("bought_at")) if "bought_at" in positions.columns else F.lit(None).cast("bigint")
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket_")
    sold = F.coalesce(alerts.micros(F.col("sold_at")), F.lit(2**63 - 1)).alias("sold_us_")
    held = positions.select(F.coalesce("id", F.lit(NONE)).alias("id"), "symbol", F.col("price").cast("double").alias("price"), sold, since.alias("since_"), bucket)
    held = held.withColumn("part_", F.col("bucket_") % SPREAD)
    rows = rows.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    rows = rows.join(held, ["symbol", "part_"]).filter(F.col("since_").isNull() | (F.col("us_") >= F.col("since_")))
    priced = F.when(F.col("now_price") > 0, F.col("now_price"))
    number = lambda top: F.coalesce(F.array_position(F.array(*map(F.lit, transitions.SELL_RULES)), transitions.sell_rule(F.col("price"), priced, top, F.col("context_"), p)), F.lit(0))
    names = "symbol string, id bigint, price double, now_price double, rule string, context_ string, us_ long"
    rows = rows.select("us_", "symbol", "id", "price", F.col("now_price").cast("double").alias("now_price"), "sold_us_", "context_", number(F.lit(None).cast("double")).alias("rule"), number(F.lit(float("inf"))).alias("trailed"), "at_", "bucket_")
    kept = rows.groupBy("bucket_").transformWithStateInPandas(_Positions(p, days, [c.split(" ")[0] for c in names.split(", ")]), names, "append", "EventTime")
    kept = kept.withColumn("id", F.when(F.col("id") != NONE, F.col("id")))
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return transitions.sell_rows(kept, F.timestamp_add("MICROSECOND", F.col("us_"), zero), F.col("context_"))


def sell_watermarks(ticks: DataFrame, p: Sell = Sell()) -> DataFrame:
    """Sell rules on each bar of a position, with its watermark as keyed state.

    ``ticks`` has id, entry, open_time and close; bars of a position come in
    order of time over batches, within a batch they are sorted.  The state is
    a running maximum; the rule itself is the column rule of the batch job.
    """
    schema = "id bigint, open_time timestamp_ntz, entry double, close double, watermark double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("open_time", kind="stable")
        tops = np.fmax.accumulate(np.concatenate([[np.nan if top is None else top], np.fmax(rows["entry"].astype(float), rows["close"].astype(float))]))
        state.update((None if np.isnan(tops[-1]) else float(tops[-1]),))
        marks = pd.Series(tops[:-1], index=rows.index, dtype="object").where(~np.isnan(tops[:-1]), None)
        yield pd.DataFrame({"id": key[0], "open_time": rows["open_time"], "entry": rows["entry"], "close": rows["close"], "watermark": marks})

    kept = ticks.groupBy("id").applyInPandasWithState(step, schema, "top double", "append", "NoTimeout")
    rule = transitions.sell_rule(F.col("entry"), F.col("close"), F.col("watermark"), F.lit(None).cast("string"), p)
    return kept.select("id", "open_time", "watermark", rule.alias("rule"))
