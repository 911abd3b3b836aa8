"""Alert decisions, the ordered alert pass, the outbox and message columns."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalars as S
from ..params import Alerts

#: Priorities, phrases and lines of the messages.
PRIORITY = {"normal": "default", "strong": "high", "very_strong": "max"}
SELL_PRIORITY = {"high": "max", "medium": "high"}
DECISION = {"very_strong": "🟢 Bom momento de compra", "strong": "🟡 Vale observar", "normal": "🟠 Melhor esperar"}
DECISION_DEFAULT = "🔴 Evitar entrada agora"
MEANING = {
    "very_strong": "Vários indicadores apontam oportunidade clara.",
    "strong": "Sinais moderados — acompanhe antes de agir.",
    "normal": "Sinal fraco — observe com cautela.",
}
MEANING_DEFAULT = "Condições desfavoráveis."
SELL_PHRASE = {
    "stop_loss": "🔴 Stop-loss acionado",
    "trailing_stop": "🟠 Trailing stop acionado",
    "take_profit": "🟢 Take-profit atingido",
    "context_deterioration": "🟡 Contexto deteriorando",
}
SELL_PHRASE_DEFAULT = "⚠️ Sinal de venda"
SELL_MEANING = {
    "stop_loss": "Decisão sugerida: proteger capital — considere sair.",
    "trailing_stop": "Decisão sugerida: travar lucro após recuo do topo.",
    "take_profit": "Decisão sugerida: realizar lucro parcial ou total.",
    "context_deterioration": "Decisão sugerida: reavaliar — contexto adverso.",
}
SELL_MEANING_DEFAULT = "Decisão sugerida: reavaliar a posição."


def is_cooling(minutes, p: Alerts):
    """Whether a send so many minutes away (a column or a number) still holds alerts back."""
    return minutes < p.cooldown_minutes


def is_jump(gain, p: Alerts):
    """Whether a score's gain (a column or a number) over the last send's overrides the cooldown."""
    return gain >= p.escalation_jump


def decide(score: Column, severity: Column, now: Column, prior_at: Column, prior_score: Column, p: Alerts = Alerts()) -> Column:
    """(action, reason, override_cooldown, bypass_quiet) of one signal."""
    elapsed = S.minutes_between(now, prior_at)
    cooling = F.coalesce(is_cooling(elapsed, p), F.lit(False))
    jump = F.coalesce(is_jump(score - prior_score, p), F.lit(False))
    override = cooling & jump
    skip = cooling & ~jump
    quiet = S.quiet_hours(now, p.timezone, p.quiet_start, p.quiet_end)
    loud = F.coalesce(severity == "very_strong", F.lit(False))
    action = F.when(skip, "skip_cooldown").when(quiet & ~loud, "queue").otherwise("send_now")
    reason = (
        F.when(skip, F.concat(F.lit("cooldown:"), F.floor(elapsed).cast("string"), F.lit(f"m<{p.cooldown_minutes}m")))
        .when(quiet & loud, "very_strong_bypass_quiet")
        .when(quiet, "quiet_hours")
        .when(override, "escalation_override")
        .otherwise("fresh")
    )
    return F.struct(action.alias("action"), reason.alias("reason"), (override & ~skip).alias("override_cooldown"), (quiet & loud & ~skip).alias("bypass_quiet"))


def prior_alerts(notifications: DataFrame, signals: DataFrame) -> DataFrame:
    """symbol, sent_at, score of each symbol's newest delivered alert (ties: highest id)."""
    sent = notifications.filter("delivered and sent_at is not null and signal_id is not null")
    j = sent.select("signal_id", "sent_at", F.col("id").alias("nid")).join(signals.select(F.col("id").alias("signal_id"), "symbol", "score"), "signal_id")
    return j.groupBy("symbol").agg(F.max_by(F.struct("sent_at", "score"), F.struct("sent_at", "nid")).alias("p")).select("symbol", "p.sent_at", "p.score")


#: Columns by which the signals of a symbol pass, and what the pass needs of each.
ORDER = ["detected_at", "id", "severity", "score", "now", "ok"]


def _zero() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _zero(), c)


def judged(pending: DataFrame, clock: str, p: Alerts, delivered: Column | None = None) -> DataFrame:
    """symbol and ``ORDER`` of pending signals, ``_us`` (``now`` in microseconds) and ``_can``: a send would count as prior."""
    ok = F.lit(True) if delivered is None else F.coalesce(delivered, F.lit(False))
    rows = pending.select("symbol", "detected_at", "id", "severity", F.col("score").cast("bigint").alias("score"), F.col(clock).alias("now"), ok.alias("ok"))
    loud = F.coalesce(F.col("severity") == "very_strong", F.lit(False))
    held_back = F.coalesce(S.quiet_hours(F.col("now"), p.timezone, p.quiet_start, p.quiet_end) & ~loud, F.lit(False))
    return rows.withColumns({"_us": micros(F.col("now")), "_can": F.col("ok") & ~held_back})


def decided(rows: DataFrame, p: Alerts) -> DataFrame:
    """Decisions on ``judged`` rows with the last send before each in ``_prior_us`` and ``_prior_score``."""
    d = decide(F.col("score"), F.col("severity"), F.col("now"), F.timestamp_add("MICROSECOND", F.col("_prior_us"), _zero()), F.col("_prior_score"), p)
    return rows.withColumn("_d", d).select("symbol", "id", "now", "_d.action", "_d.reason", "_d.override_cooldown", "_d.bypass_quiet", "ok")


def priors_in_order(rows: Iterable[tuple], at: int | None, score: int | None, p: Alerts) -> Iterator[tuple]:
    """The last send (microseconds, score) before each row (now, score, can), and after the last one."""
    for now, mark, can in rows:
        yield at, score
        cooling = now is not None and at is not None and is_cooling(abs(now - at) / 60e6, p)
        jump = mark is not None and score is not None and is_jump(mark - score, p)
        if can and (jump or not cooling):
            at, score = now, mark
    yield at, score


def _with_priors(batches: Iterator[pa.RecordBatch], group: list[str], p: Alerts) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and order, each with the last send before it; only that send is held."""
    last, at, score = object(), None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in (*group, "_us", "score", "_can", "_sent_us", "_sent_score")}
        keys, n, found = list(zip(*[columns[g] for g in group], strict=True)), 0, []
        for key, own in groupby(keys):
            size = sum(1 for _ in own)
            if key != last:
                last, at, score = key, columns["_sent_us"][n], columns["_sent_score"][n]
            rows = zip(*[columns[c][n : n + size] for c in ("_us", "score", "_can")], strict=True)
            *before, (at, score) = priors_in_order(rows, at, score, p)
            found += before
            n += size
        arrays = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "_prior_us", "_prior_score"])


#: Places in time of rows without a time, and scores of rows without a score.
_NO_TIME, _NO_SCORE = -(1 << 61), -(1 << 40)


def send_map(now: np.ndarray, score: np.ndarray, p: Alerts) -> dict[str, list[int]]:
    """What a block of rows that can send, in order of time, makes of the send before it.

    The first row that is sent is the first one beyond the cooldown of that send
    or, before it, the first with a jump over its score.  From there on the sends
    follow from the block alone; ``exit`` has the last of them for each first
    row.  Neighbours with one exit are one entry; each record of the scores
    starts an entry, so which of two entries comes first is known.
    """
    n, wait = len(now), int(p.cooldown_minutes * 60_000_000)
    levels = np.unique(score)
    first = np.full(len(levels) + 1, n)  # first later row with at least the score of a level
    by_time = np.where(now == _NO_TIME, np.arange(n) + 1, np.searchsorted(now, now + wait, "left"))
    over = np.where(score == _NO_SCORE, len(levels), np.searchsorted(levels, score + p.escalation_jump, "left"))
    at = np.searchsorted(levels, score)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        follow = min(max(int(by_time[i]), i + 1), int(first[over[i]]))
        if follow < n:
            last[i] = last[follow]
        first[: at[i] + 1] = i
    tops = np.maximum.accumulate(score) if n else score
    record = np.concatenate(([True], tops[1:] > tops[:-1])) if n else np.zeros(0, bool)
    begins = np.flatnonzero(record | np.concatenate(([True], last[1:] != last[:-1]))) if n else np.zeros(0, int)
    ends = np.append(begins[1:], n)[: len(begins)] - 1
    records = np.flatnonzero(record)
    return {
        "start": now[:1].tolist(),
        "until": now[ends].tolist(),
        "exit_us": now[last[begins]].tolist(),
        "exit_score": score[last[begins]].tolist(),
        "record": score[records].tolist(),
        "entry": np.searchsorted(begins, records).tolist(),
    }


def after_block(m: dict[str, list[int]], at: int | None, score: int | None, p: Alerts) -> tuple[int | None, int | None]:
    """The last send after a block, given the one before it."""
    wait, entries = int(p.cooldown_minutes * 60_000_000), len(m["until"])
    if not entries:
        return at, score
    if at is None or m["start"][0] <= at - wait:
        entry = 0
    else:
        entry = bisect_left(m["until"], at + wait)
    if score is not None:
        k = bisect_left(m["record"], score + p.escalation_jump)
        if k < len(m["record"]):
            entry = min(entry, m["entry"][k])
    if entry == entries:
        return at, score
    us, mark = m["exit_us"][entry], m["exit_score"][entry]
    return None if us == _NO_TIME else us, None if mark == _NO_SCORE else mark


def _block_priors(rows: DataFrame, priors: DataFrame, p: Alerts) -> DataFrame:
    """symbol, _block and the last send before each block of a symbol.

    Each block becomes a small map from send to send in a task of its own; the
    maps of a symbol, a row for each block, are then applied one after another.
    """
    lists = ["start", "until", "exit_us", "exit_score", "record", "entry"]

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["_can"]].sort_values(ORDER, kind="stable", na_position="first")
        numbers = lambda c, none: np.array([none if pd.isna(v) else v for v in part[c]], np.int64)
        made = send_map(numbers("_us", _NO_TIME), numbers("score", _NO_SCORE), p)
        return pd.DataFrame({"symbol": [key[0]], "_block": [key[1]], **{k: [made[k]] for k in lists}})

    def walk(maps: pd.DataFrame) -> pd.DataFrame:
        maps, out = maps.sort_values("_block"), []
        at, score = (None if pd.isna(v) else int(v) for v in maps[["_sent_us", "_sent_score"]].iloc[0])
        for row in maps.itertuples(index=False):
            out.append((row[0], row[1], at, score))
            at, score = after_block({k: list(v) for k, v in zip(lists, row[2:8])}, at, score, p)
        out = pd.DataFrame(out, columns=["symbol", "_block", "_sent_us", "_sent_score"])
        return out.astype({"_sent_us": "Int64", "_sent_score": "Int64"})

    schema = "symbol string, _block long, " + ", ".join(f"{k} array<long>" for k in lists)
    maps = rows.groupBy("symbol", "_block").applyInPandas(build, schema)
    maps = maps.join(priors, "symbol", "left")
    return maps.groupBy("symbol").applyInPandas(walk, "symbol string, _block long, _sent_us long, _sent_score long")


def alert_pass(pending: DataFrame, priors: DataFrame, clock: str, p: Alerts = Alerts(), delivered: Column | None = None, block_hours: int = 24) -> DataFrame:
    """Decisions on pending signals in order; a send is the prior of later rows.

    ``pending`` has id, symbol, severity, score, detected_at and ``clock``, the
    time at which a row is decided.  ``delivered`` tells whether a send
    succeeds (all do if not given); a failed one is no prior.  The rows of a
    symbol pass by detected_at and id.  With ``detected_at`` as the clock, each
    ``block_hours`` of a symbol go to a task of their own: the send before a
    block is known from the small maps of the blocks before it.  With another
    clock, whose times need not rise, the rows of a symbol pass through one task
    that holds the last send.
    """
    rows = judged(pending, clock, p, delivered)
    sent = priors.select("symbol", micros(F.col("sent_at")).alias("_sent_us"), F.col("score").cast("bigint").alias("_sent_score"))
    if clock == "detected_at":
        group = ["symbol", "_block"]
        rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("_us") / (block_hours * 3_600_000_000)), F.lit(_NO_TIME)).cast("long"))
        sent = _block_priors(rows, sent, p)
    else:
        group = ["symbol"]
    ordered = rows.repartition(*group).join(sent, group, "left").sortWithinPartitions(*group, *ORDER)
    schema = StructType([*ordered.schema.fields, StructField("_prior_us", LongType()), StructField("_prior_score", LongType())])
    return decided(ordered.mapInArrow(lambda batches: _with_priors(batches, group, p), schema), p)


def _with_results(decisions: DataFrame, results: DataFrame | None) -> DataFrame:
    """Decisions with ``_why`` and ``_error`` of a failed send; ``results`` has signal_id, reason and error."""
    if results is None:
        return decisions.withColumns({"_why": F.lit("error"), "_error": F.lit(None).cast("string")})
    r = results.select(F.col("signal_id").alias("_sid"), F.col("reason").alias("_why"), F.col("error").alias("_error"))
    return decisions.join(r, F.col("id") == F.col("_sid"), "left").drop("_sid")


def outbox(decisions: DataFrame, signals: DataFrame, results: DataFrame | None = None, tags: str = "", debug: bool = False) -> DataFrame:
    """Notification rows: queued, delivered or failed; skipped signals have none.

    ``results`` tells why sends failed; ``tags`` are the default tags.
    """
    d = _with_results(decisions, results).filter("action <> 'skip_cooldown'")
    j = d.select("id", "now", "action", "bypass_quiet", "ok", "_why", "_error").join(signals, "id")
    send = F.col("action") == "send_now"
    good = send & F.col("ok")
    return j.select(
        F.col("now").alias("created_at"),
        F.when(good, F.col("now")).alias("sent_at"),
        "symbol",
        F.col("id").alias("signal_id"),
        title(F.col("symbol"), F.col("severity"), debug).alias("title"),
        body(debug).alias("body"),
        S.label(F.col("severity"), PRIORITY, F.lit("default")).alias("priority"),
        F.lit(tags).alias("tags"),
        (~send).alias("queued"),
        "bypass_quiet",
        good.alias("delivered"),
        F.when(send, 1).otherwise(0).alias("delivery_attempts"),
        F.when(send & ~F.col("ok"), F.concat(F.col("_why"), F.lit(":"), F.coalesce("_error", F.lit("")))).alias("last_error"),
    )


def marked(decisions: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """id, alerted and alert_skipped_reason of decided signals."""
    failed = F.concat(F.lit("send_failed:"), F.col("_why"))
    reason = F.when(F.col("action") == "skip_cooldown", F.col("reason")).when(F.col("action") == "queue", "quiet_hours").when(~F.col("ok"), failed)
    return _with_results(decisions, results).select("id", F.lit(True).alias("alerted"), reason.alias("alert_skipped_reason"))


def flush_queue(notifications: DataFrame, results: DataFrame, now: Column, p: Alerts = Alerts(), with_tried: bool = False) -> DataFrame:
    """Queued rows with their delivery results; nothing moves in quiet hours.

    ``results`` has id, ok and error.  ``with_tried`` adds ``tried``: whether a
    row was sent in this flush.
    """
    quiet = S.quiet_hours(now, p.timezone, p.quiet_start, p.quiet_end)
    r = results.select(F.col("id").alias("_id"), F.col("ok").alias("_ok"), F.col("error").alias("_error"))
    j = notifications.join(r, F.col("id") == F.col("_id"), "left")
    tried = F.col("queued") & ~F.col("delivered") & F.col("_id").isNotNull() & ~quiet
    good, bad = tried & F.col("_ok"), tried & ~F.col("_ok")
    moved = {"tried": F.coalesce(tried, F.lit(False))} if with_tried else {}
    return j.withColumns(
        moved
        | {
            "delivered": F.col("delivered") | F.coalesce(good, F.lit(False)),
            "queued": F.col("queued") & ~F.coalesce(good, F.lit(False)),
            "sent_at": F.when(good, now).otherwise(F.col("sent_at")),
            "delivery_attempts": F.col("delivery_attempts") + F.when(tried, 1).otherwise(0),
            "last_error": F.when(bad, F.col("_error")).when(good, F.lit(None).cast("string")).otherwise(F.col("last_error")),
        }
    ).select(*notifications.columns, *moved)


def sent_sells(sells: DataFrame, results: DataFrame) -> DataFrame:
    """Sell signals with ``alerted``: true once a send has succeeded.

    ``results`` has id (of the sell signal) and ok; a signal without a result, or
    whose send failed, keeps its flag and can be sent again.
    """
    good = results.filter("ok").select(F.col("id").alias("_id")).distinct()
    j = sells.join(good, F.col("id") == F.col("_id"), "left")
    return j.withColumn("alerted", F.coalesce("alerted", F.lit(False)) | F.col("_id").isNotNull()).select(sells.columns)


def merge_tags(defaults: Column, more: Column) -> Column:
    """Comma-separated tags: defaults first, each once."""
    both = F.concat(F.split(F.coalesce(defaults, F.lit("")), ","), F.split(F.coalesce(more, F.lit("")), ","))
    return F.array_join(F.array_distinct(F.array_remove(F.transform(both, lambda t: F.trim(t)), "")), ",")


def pattern_of(breakdown: Column) -> Column:
    """The reversal pattern in a breakdown; null on broken JSON."""
    return F.get_json_object(breakdown, "$.reversal_pattern.pattern")


def reasons(limit: int = 3) -> Column:
    """The most telling reasons of a signal row, most relevant first."""
    c = F.col
    given = lambda text: F.when(text != "", text)
    frame = S.label(given(c("dominant_trigger_timeframe")), S.TIMEFRAMES, given(c("dominant_trigger_timeframe")))
    oversold = F.when(c("rsi_1h") <= 20, "RSI em sobrevenda extrema (").otherwise("RSI em sobrevenda (")
    pattern = given(c("reversal_pattern"))
    lines = F.array(
        F.when((c("drop_trigger_pct") > 0) & frame.isNotNull(), F.concat(F.lit("Queda de "), S.fixed(c("drop_trigger_pct"), 1), F.lit("% em "), frame)),
        F.when(c("rsi_1h") <= 30, F.concat(oversold, S.fixed(c("rsi_1h"), 0), F.lit(")"))),
        F.when(c("rel_volume") >= 1.5, F.concat(F.lit("Volume "), S.fixed(c("rel_volume"), 1), F.lit("x acima do normal"))),
        F.concat(F.lit("Padrão de reversão: "), S.label(pattern, S.PATTERNS, pattern)),
        F.when((c("dist_support_pct") < 5) & c("support_level_price").isNotNull(), F.concat(F.lit("Próximo do suporte em $"), S.general(c("support_level_price")))),
        F.coalesce(
            F.when(c("distance_from_180d_high_pct") > 20, F.concat(S.fixed(c("distance_from_180d_high_pct"), 0), F.lit("% abaixo da máxima de 6 meses"))),
            F.when(c("distance_from_30d_high_pct") > 20, F.concat(S.fixed(c("distance_from_30d_high_pct"), 0), F.lit("% abaixo da máxima de 30 dias"))),
        ),
    )
    return F.slice(F.filter(lines, lambda x: x.isNotNull()), 1, limit)


def title(symbol: Column, severity: Column, debug: bool = False) -> Column:
    tail = [F.lit(" ("), symbol, F.lit(")")] if debug else []
    return F.concat(S.label(severity, DECISION, F.lit(DECISION_DEFAULT)), F.lit(" — "), S.friendly_name(symbol), *tail)


#: Fixed layout of the raw block: lines of (name, column).
DEBUG = [
    [("pair", "symbol"), ("score", "score"), ("severity", "severity")],
    [("trigger", "trigger_reason")],
    [("dom_tf", "dominant_trigger_timeframe"), ("drop_trigger", "drop_trigger_pct")],
    [("rsi_1h", "rsi_1h"), ("rsi_4h", "rsi_4h")],
    [("rel_vol", "rel_volume")],
    [("drop_24h", "drop_24h_pct"), ("drop_7d", "drop_7d_pct"), ("drop_30d", "drop_30d_pct")],
    [("disc_30d", "distance_from_30d_high_pct"), ("disc_180d", "distance_from_180d_high_pct")],
    [("regime", "regime_at_signal")],
]
SELL_DEBUG = [
    [("pair", "symbol"), ("rule", "rule_triggered"), ("severity", "severity")],
    [("buy_id", "buy_id"), ("price", "price_at_signal"), ("pnl", "pnl_pct")],
    [("regime", "regime_at_signal")],
    [("detected_at", "detected_at")],
]


def raw_block(layout: list[list[tuple[str, str]]]) -> Column:
    """The columns of a layout as name=value, under a separator; times in ISO form."""
    value = lambda c: F.coalesce(S.utc_iso(F.col(c)), F.lit("None")) if c == "detected_at" else S.plain(F.col(c))
    lines = [F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), value(c)) for name, c in line]) for line in layout]
    return F.concat_ws("\n", F.lit("\n--- debug ---"), *lines)


def body(debug: bool = False) -> Column:
    """Message body of a signal row."""
    drop = F.col("drop_24h_pct")
    return F.concat_ws(
        "\n",
        F.concat(S.friendly_name(F.col("symbol")), F.lit(" @ $"), S.general(F.col("price_at_signal"))),
        F.when(drop > 0, F.concat(F.lit("Variação 24h: -"), S.fixed(drop, 1), F.lit("%"))).when(drop.isNotNull(), "Variação 24h: estável"),
        F.transform(reasons(), lambda r: F.concat(F.lit("• "), r)),
        S.label(F.col("regime_at_signal"), S.REGIMES),
        F.lit(""),
        S.label(F.col("severity"), MEANING, F.lit(MEANING_DEFAULT)),
        *([raw_block(DEBUG)] if debug else []),
    )


def sell_title(symbol: Column, rule: Column, debug: bool = False) -> Column:
    tail = [F.lit(" ("), symbol, F.lit(" / "), rule, F.lit(")")] if debug else []
    return F.concat(S.label(rule, SELL_PHRASE, F.lit(SELL_PHRASE_DEFAULT)), F.lit(" — "), S.friendly_name(symbol), *tail)


def sell_body(debug: bool = False) -> Column:
    """Message body of a sell signal row."""
    pnl = F.col("pnl_pct")
    return F.concat_ws(
        "\n",
        F.concat(S.friendly_name(F.col("symbol")), F.lit(" @ $"), S.general(F.col("price_at_signal"))),
        F.concat(F.lit("Resultado: "), F.when(pnl >= 0, "+").otherwise(""), S.fixed(pnl, 2), F.lit("%")),
        F.when(F.length("reason") > 0, F.concat(F.lit("• "), F.col("reason"))),
        S.label(F.col("regime_at_signal"), S.REGIMES),
        F.lit(""),
        S.label(F.col("rule_triggered"), SELL_MEANING, F.lit(SELL_MEANING_DEFAULT)),
        *([raw_block(SELL_DEBUG)] if debug else []),
    )


def sell_priority(severity: Column) -> Column:
    return S.label(severity, SELL_PRIORITY, F.lit("default"))


def last_sent(decisions: DataFrame) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("now"), F.desc("id"))
    return decisions.filter("action = 'send_now' and ok").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("symbol", F.col("now").alias("sent_at"))
