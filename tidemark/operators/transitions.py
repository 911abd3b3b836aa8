"""Merge-like transitions of the signal, watchlist and position tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Scoring, Sell, Watch
from . import scoring
from .readers import latest_close, max_severity


def with_next_ids(rows: DataFrame, earlier: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """``rows`` with ``id`` going on from the highest of ``earlier`` (1, if it has none or no such column).

    ``order`` tells rows apart.  Rows are numbered in buckets by its hash, each in
    a task of its own, and each bucket goes on where the one before it ends, so
    ids are dense and a rerun gives the same ones.
    """
    columns = rows.columns
    bare = rows.drop("id").withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    sizes = bare.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # a row for each bucket
    before = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    top = F.coalesce(F.max("id"), F.lit(0)) if "id" in earlier.columns else F.lit(0)
    start = earlier.agg(top.cast("bigint").alias("_start"))
    numbered = bare.withColumn("_n", inside).join(F.broadcast(sizes), "_b").crossJoin(F.broadcast(start))
    return numbered.withColumn("id", F.col("_start") + F.col("_before") + F.col("_n")).select(columns)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "very_strong", 3).when(severity == "strong", 2).when(severity == "normal", 1)


def insert_outcomes(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Candidates with ``reason`` and ``inserted``: what an insert in order of time gives.

    A candidate is compared with the highest severity of its symbol and candle
    hour, in the table or before it in the batch.
    """
    rank = severity_rank(F.col("severity"))
    before = Window.partitionBy("symbol", "candle_hour").orderBy("detected_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    c = candidates.withColumn("_rank", rank)
    if existing is not None:
        c = c.join(max_severity(existing), ["symbol", "candle_hour"], "left")
    else:
        c = c.withColumn("max_rank", F.lit(None).cast("int"))
    c = c.withColumn("_max", F.greatest("max_rank", F.max("_rank").over(before)))
    return with_outcome(c).drop("max_rank")


def with_outcome(c: DataFrame) -> DataFrame:
    """``reason`` and ``inserted`` from the rank of a candidate (``_rank``) and the highest before it (``_max``), which go."""
    reason = (
        F.when(F.col("_rank").isNull(), "below_threshold")
        .when(F.col("_max").isNull(), "inserted")
        .when(F.col("_max") == F.col("_rank"), "duplicate")
        .when(F.col("_max") > F.col("_rank"), "superseded")
        .otherwise("escalated")
    )
    return c.withColumn("reason", reason).withColumn("inserted", F.col("reason").isin("inserted", "escalated")).drop("_rank", "_max")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def watch_action(score: Column, has_watch: Column, min_score: int = 50, floor: int = 35) -> Column:
    if floor > min_score:
        raise ValueError("the floor must not be over the emit score")
    return F.when(score >= min_score, "PROMOTE").when(score < floor, F.when(has_watch, "EXPIRE").otherwise("IGNORE")).otherwise("WATCH")


def expire_stale(watchlist: DataFrame, now: Column, p: Watch = Watch()) -> DataFrame:
    """Active watches whose time is up by ``now`` are closed (none, if ``p`` is not enabled)."""
    stale = F.lit(p.enabled) & (F.col("status") == "watching") & (F.col("expires_at") <= now)
    return watchlist.withColumns(
        {
            "status": F.when(stale, "expired").otherwise(F.col("status")),
            "resolved_at": F.when(stale, now).otherwise(F.col("resolved_at")),
            "resolution_reason": F.when(stale, "expired_stale").otherwise(F.col("resolution_reason")),
        }
    )


def watch_pass(watchlist: DataFrame, candidates: DataFrame, now: Column, p: Watch = Watch(), s: Scoring = Scoring()) -> tuple[DataFrame, DataFrame]:
    """(actions, watchlist) of a scan; only candidates without a severity take part (none, if ``p`` is not enabled).

    ``candidates`` has symbol, score, severity, and ``signal_id`` with
    ``inserted`` for those that a promotion has inserted.
    """
    candidates = candidates if p.enabled else candidates.limit(0)
    active = watchlist.filter("status = 'watching'").select("symbol", F.col("id").alias("watch_id"), F.lit(True).alias("has_watch"))
    c = candidates.filter("severity is null").join(active, "symbol", "left")
    c = c.withColumn("action", watch_action(F.col("score"), F.col("has_watch").isNotNull(), s.min_score, p.floor))
    a = c.select("symbol", F.col("score").alias("_score"), "action", F.col("signal_id").alias("_signal"), F.col("inserted").alias("_inserted"))
    m = watchlist.join(a, "symbol", "left")
    live = F.col("status") == "watching"
    promote = live & (F.col("action") == "PROMOTE") & F.coalesce("_inserted", F.lit(False))
    expire, refresh = live & (F.col("action") == "EXPIRE"), live & (F.col("action") == "WATCH")
    until = F.timestamp_add("HOUR", F.lit(p.hours), now)
    done = promote | expire
    kept = m.withColumns(
        {
            "status": F.when(promote, "promoted").when(expire, "expired").otherwise(F.col("status")),
            "last_seen_at": F.when(refresh, now).otherwise(F.col("last_seen_at")),
            "last_score": F.when(refresh, F.col("_score")).otherwise(F.col("last_score")),
            "expires_at": F.when(refresh, until).otherwise(F.col("expires_at")),
            "promoted_signal_id": F.when(promote, F.col("_signal")).otherwise(F.col("promoted_signal_id")),
            "resolved_at": F.when(done, now).otherwise(F.col("resolved_at")),
            "resolution_reason": F.when(promote, "promoted").when(expire, "below_floor").otherwise(F.col("resolution_reason")),
        }
    ).select(watchlist.columns)
    fresh = c.filter("action = 'WATCH' and has_watch is null").select(
        F.lit(None).cast("bigint").alias("id"),
        "symbol",
        F.lit("watching").alias("status"),
        now.alias("first_seen_at"),
        now.alias("last_seen_at"),
        F.col("score").cast("int").alias("last_score"),
        until.alias("expires_at"),
        F.lit(None).cast("bigint").alias("promoted_signal_id"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_reason"),
    )
    return c, kept.unionByName(with_next_ids(fresh, watchlist, ["symbol"]))


def validate_buys(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """New buys with ``error`` (null if valid) and the quantity filled in."""
    known = signals.select(F.col("id").alias("_sid")).distinct()
    j = rows.join(known, F.col("signal_id") == F.col("_sid"), "left")
    error = (
        F.when(F.coalesce(F.col("price") <= 0, F.lit(True)), "price")
        .when(F.coalesce(F.col("amount_invested") <= 0, F.lit(True)), "amount")
        .when(F.col("quantity") <= 0, "quantity")
        .when(F.col("signal_id").isNotNull() & F.col("_sid").isNull(), "signal")
    )
    quantity = F.coalesce("quantity", F.try_divide(F.col("amount_invested"), F.col("price")))
    return j.withColumn("error", error).withColumn("quantity", quantity).drop("_sid")


def record_sales(buys: DataFrame, sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buys with sales stamped, sales with ``error``); a buy takes its first valid sale.

    ``sales`` has buy_id, sold_at, sold_price and sold_note.
    """
    b = buys.select(F.col("id").alias("buy_id"), "bought_at", F.col("sold_at").alias("_sold"))
    j = sales.join(b, "buy_id", "left")
    error = (
        F.when(F.col("bought_at").isNull(), "unknown")
        .when(F.col("_sold").isNotNull(), "already_sold")
        .when(F.coalesce(F.col("sold_price") <= 0, F.lit(True)), "price")
        .when(F.col("sold_at") < F.col("bought_at"), "time")
    )
    j = j.withColumn("error", error)
    order = Window.partitionBy("buy_id", F.col("error").isNull()).orderBy("sold_at", "sold_price", "sold_note")
    j = j.withColumn("error", F.coalesce("error", F.when(F.row_number().over(order) > 1, "already_sold")))
    good = j.filter("error is null").select(F.col("buy_id").alias("id"), F.col("sold_at").alias("_at"), F.col("sold_price").alias("_price"), F.col("sold_note").alias("_note"))
    stamped = buys.join(good, "id", "left").withColumns(
        {"sold_at": F.coalesce("sold_at", "_at"), "sold_price": F.coalesce("sold_price", "_price"), "sold_note": F.coalesce("sold_note", "_note")}
    )
    return stamped.select(buys.columns), j.drop("bought_at", "_sold")


#: Rules in the order in which they are tried.
SELL_RULES = ("stop_loss", "trailing_stop", "take_profit", "context_deterioration")


def sell_rule(entry: Column, price: Column, watermark: Column, regime: Column, p: Sell = Sell()) -> Column:
    """The first rule that fires; a watermark is one from earlier scans."""
    pnl = S.pct_change(entry, price)
    stop = price <= entry * (1 - p.stop_loss / 100)
    trail = (watermark > 0) & (price <= watermark * (1 - p.trailing / 100))
    gain = price >= entry * (1 + p.take_profit / 100)
    context = F.lit(p.context) & (regime == "risk_off") & (pnl < 0)
    rule = F.when(stop, "stop_loss").when(trail, "trailing_stop").when(gain, "take_profit").when(context, "context_deterioration")
    return F.when((entry > 0) & (price > 0), rule)


def sell_severity(rule: Column) -> Column:
    return F.when(rule == "stop_loss", "high").when(rule.isNotNull(), "medium")


def sell_rows(judged: DataFrame, now: Column, regime: Column) -> DataFrame:
    """Sell signals of positions (id, symbol, price) whose ``rule`` has fired at ``now_price``; they have no id yet (``with_next_ids``)."""
    return judged.select(
        F.lit(None).cast("bigint").alias("id"),
        "symbol",
        F.col("id").alias("buy_id"),
        now.alias("detected_at"),
        F.col("now_price").alias("price_at_signal"),
        F.col("rule").alias("rule_triggered"),
        sell_severity(F.col("rule")).alias("severity"),
        F.col("rule").alias("reason"),
        S.pct_change(F.col("price"), F.col("now_price")).alias("pnl_pct"),
        regime.alias("regime_at_signal"),
        F.lit(False).alias("alerted"),
    )


def sell_pass(
    positions: DataFrame, closes: DataFrame, tracking: DataFrame, fired: DataFrame, now: Column, regime: Column | None = None, p: Sell = Sell()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions judged, sell signals, tracking) of one scan.

    ``closes`` has symbol and close; ``fired`` earlier sell signals (new ones go on
    from its highest id).  A rule in
    its cooldown is suppressed and no lower rule takes its place.  Watermarks
    rise after the rules have been read, and only then is updated_at set.  If ``p``
    is not enabled no position is judged and nothing moves.
    """
    positions = positions if p.enabled else positions.limit(0)
    regime = F.lit(None).cast("string") if regime is None else regime
    j = positions.join(closes.select("symbol", F.col("close").alias("now_price")), "symbol", "left")
    j = j.join(tracking.select(F.col("buy_id").alias("id"), F.col("high_watermark").alias("watermark"), F.col("updated_at").alias("_updated")), "id", "left")
    priced = F.col("now_price") > 0
    j = j.withColumn("no_price", ~F.coalesce(priced, F.lit(False)))
    j = j.withColumn("rule", sell_rule(F.col("price"), F.when(priced, F.col("now_price")), F.col("watermark"), regime, p))
    last = fired.groupBy(F.col("buy_id").alias("id"), F.col("rule_triggered").alias("rule")).agg(F.max("detected_at").alias("_last"))
    j = j.join(last, ["id", "rule"], "left")
    cooling = F.lit(p.cooldown_hours > 0) & (F.timestamp_diff("SECOND", "_last", now) < p.cooldown_hours * 3600)
    j = j.withColumn("suppressed", F.col("rule").isNotNull() & F.coalesce(cooling, F.lit(False))).drop("_last")
    sells = with_next_ids(sell_rows(j.filter("rule is not null and not suppressed"), now, regime), fired, ["buy_id", "rule_triggered"])
    top = F.greatest("watermark", "price", F.when(priced, F.col("now_price")))
    rises = ~F.col("no_price") & (F.col("watermark").isNull() | (top > F.col("watermark")))
    moved = j.filter(~F.col("no_price") | F.col("watermark").isNotNull()).select(
        "symbol",
        F.col("id").alias("buy_id"),
        F.when(rises, top).otherwise(F.col("watermark")).alias("high_watermark"),
        F.when(rises, now).otherwise(F.col("_updated")).alias("updated_at"),
    )
    others = tracking.join(positions.select(F.col("id").alias("buy_id")), "buy_id", "left_anti")
    return j.drop("_updated"), sells, moved.unionByName(others.select(moved.columns))


def replay_sells(positions: DataFrame, bars: DataFrame, p: Sell = Sell(), days: int | None = None) -> DataFrame:
    """Rules at every bar from a buy on, with the watermark of the bars before.

    A position is followed up to its sale (``sold_at``, if ``positions`` has it)
    or the last bar; ``days`` gives all the same horizon instead.  Each row of
    ``positions`` is followed by itself.  What is highest from the day after a buy
    to a later day depends on the symbol and the two days only and is found once
    for them, so a position meets its days in a join and its bars are neither
    shuffled nor sorted.
    """
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bucket = lambda c: F.timestamp_diff("DAY", zero, S.floor_day(c))
    if days is not None:
        end = F.timestamp_add("DAY", F.lit(days), "bought_at")
    else:
        end = F.col("sold_at") if "sold_at" in positions.columns else F.lit(None).cast("timestamp_ntz")
    held = positions.select("id", "symbol", "bought_at", "price", end.alias("_end"))
    first, last = bucket(F.col("bought_at")), bucket(F.col("_end"))
    if days is None:  # the last bar of all symbols: one row, where a join by symbol would be one task for a hot one
        held = held.crossJoin(F.broadcast(bars.agg(F.max("open_time").alias("_last"))))
        last = bucket(F.least("_end", "_last"))
    held = held.filter(first <= last).withColumn("_from", first)
    paths = _day_paths(bars.select("symbol", "open_time", "close", bucket(F.col("open_time")).alias("_day")), held, days)
    # The hash table is that of the days, whichever side the planner takes for the smaller one.
    j = held.withColumn("_day", F.explode(F.sequence("_from", last))).join(paths.hint("shuffle_hash"), ["symbol", "_from", "_day"])
    # Of the first day only the bars from the buy on count, also before a bar.
    later, since = F.col("_day") > F.col("_from"), lambda b: b.open_time >= F.col("bought_at")
    closes = lambda found: F.array_max(F.transform(found, lambda b: b.close))
    earlier = lambda b: F.filter("_begin", lambda x: since(x) & (x.open_time < b.open_time))
    begun = F.transform(F.filter("_begin", since), lambda b, i: F.struct(b.open_time.alias("open_time"), b.close.alias("close"), closes(earlier(b)).alias("_before"), (i > 0).alias("_more")))
    j = j.select(
        "symbol",
        "id",
        "bought_at",
        "price",
        "_end",
        F.when(later, F.greatest(closes(F.filter("_begin", since)), "_top")).alias("_prior"),
        (later & (F.coalesce(F.exists("_begin", since), F.lit(False)) | (F.coalesce("_n", F.lit(0)) > 0))).alias("_any"),
        F.when(later, F.col("_bars")).otherwise(begun).alias("_bars"),
    )
    j = j.select("symbol", "id", "bought_at", "price", "_end", "_prior", "_any", F.inline("_bars"))
    j = j.filter(F.col("_end").isNull() | (F.col("open_time") < F.col("_end")))
    top = F.when(F.col("_any") | F.col("_more"), F.greatest("price", "_prior", "_before"))
    j = j.select("symbol", "id", "bought_at", "price", "open_time", "close", top.alias("watermark"))
    return j.withColumn("rule", sell_rule(F.col("price"), F.col("close"), F.col("watermark"), F.lit(None).cast("string"), p))


def _day_paths(bars: DataFrame, held: DataFrame, days: int | None) -> DataFrame:
    """A row for each symbol, day with bars (``_day``) and day of a buy up to ``days`` before it (``_from``).

    It has the bars of both days (``_bars``, ``_begin``), each with the highest
    close before it in its day, and of the days between the highest close
    (``_top``) and the number of bars (``_n``).
    """
    so_far = Window.partitionBy("symbol", "_day").orderBy("open_time", "close").rowsBetween(Window.unboundedPreceding, -1)
    bar = F.struct("open_time", "close", F.col("_b").alias("_before"), F.col("_m").alias("_more"))
    bars = bars.withColumns({"_b": F.max("close").over(so_far), "_m": F.count(F.lit(1)).over(so_far) > 0})
    table = bars.groupBy("symbol", "_day").agg(F.sort_array(F.collect_list(bar)).alias("_bars"), F.max("close").alias("_high"), F.count(F.lit(1)).alias("_count"))
    if days is not None:
        start = F.col("_day") - days
    else:
        table, start = table.join(held.groupBy("symbol").agg(F.min("_from").alias("_start")), "symbol"), F.col("_start")
    table = table.filter(start <= F.col("_day")).withColumn("_from", F.explode(F.sequence(start, F.col("_day"))))
    same, pair = F.col("_day") == F.col("_from"), Window.partitionBy("symbol", "_from").orderBy("_day")
    between = pair.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.first(F.when(same, F.col("_bars")), ignorenulls=True).over(pair.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top, n = F.max(F.when(~same, F.col("_high"))).over(between), F.sum(F.when(~same, F.col("_count"))).over(between)
    return table.select("symbol", "_from", "_day", "_bars", begin.alias("_begin"), top.alias("_top"), n.alias("_n"))


def monitor(positions: DataFrame, candles: DataFrame, tracking: DataFrame) -> DataFrame:
    """Open positions with close, pnl and drawdown from the watermark, in percent."""
    j = positions.join(latest_close(candles), "symbol", "left").join(tracking.select(F.col("buy_id").alias("id"), "high_watermark"), "id", "left")
    return j.select(
        "id",
        "symbol",
        "price",
        "high_watermark",
        "close",
        S.pct_change(F.col("price"), F.col("close")).alias("pnl_pct"),
        S.pct_change(F.col("high_watermark"), F.col("close")).alias("drawdown_pct"),
    )


def promoted_severity(score: Column, s: Scoring = Scoring()) -> Column:
    return scoring.severity_of(score, s)
