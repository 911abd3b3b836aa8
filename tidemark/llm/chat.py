"""Chat formatting from an event log.

The log of a conversation is folded into final messages and rendered.  Events:
``start`` opens a message (``text`` is empty), ``delta`` appends to it,
``edit`` replaces what it holds, ``regenerate`` empties it for new deltas.  The
fold is relational: of each message only the events from its last replacing one
on count, and their texts are joined in order of ``seq``.

Template: every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside texts and roles lose their first character to a character reference, and
``&`` itself is escaped, so that escaping is reversible and no rendered text
holds a control string.  The loss mask lists the spans of assistant texts.

Only built-in functions run on the executors.  One conversation is one output
row, so its final text must fit a row; its log is reduced before it is gathered.

Edge cases: null text is empty, a null role is the empty role, a null
conversation id is a conversation of its own; events with equal ``seq`` follow
their kind and text; an empty log gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in common use treat as control.
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for first, name in (("<", "&lt;"), ("[", "&lsqb;")):
        tails = "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == first)
        text = F.regexp_replace(text, f"{_quoted(first)}(?={tails})", name)
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&NewLine;"))


def unescape(text: Column) -> Column:
    for name, char in (("&NewLine;", "\n"), ("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """An event log that ends with the rows as messages.

    Messages in turn are streamed in two deltas, regenerated after a draft, or
    edited after a delta.  Rows are messages in order of turn; equal turns
    follow role and text.
    """
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.select("conv", "role", "text", F.row_number().over(by).cast("bigint").alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda k, kind, t: F.struct((F.col("message") * 5 + k).alias("seq"), F.lit(kind).alias("event"), t.alias("text"))
    start = event(0, "start", F.lit(""))
    kind = F.col("message") % 3
    log = (
        F.when(kind == 0, F.array(start, event(1, "delta", first), event(2, "delta", rest)))
        .when(kind == 1, F.array(start, event(1, "delta", rest), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest)))
        .otherwise(F.array(start, event(1, "delta", first), event(2, "edit", F.col("text"))))
    )
    return rows.select("conv", "message", "role", F.inline(log))


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv, message, role, text) of a log.

    The log has conv, message, seq, event, role, text.  The role is that of the
    message's first event.
    """
    replaces = F.col("event").isin("start", "edit", "regenerate")
    by = Window.partitionBy("conv", "message")
    log = log.repartition("conv").withColumn("_last", F.max(F.when(replaces, F.col("seq"))).over(by))
    log = log.withColumn("_live", F.col("_last").isNull() | (F.col("seq") >= F.col("_last")))
    part = F.when(F.col("_live") & (F.col("event") != "regenerate"), F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text")))
    return log.groupBy("conv", "message").agg(
        F.min_by("role", "seq").alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv, ``formatted`` and ``loss_mask`` for every conversation.

    A mask entry is a span [start, end) of code points of ``formatted``, with
    the number and the start of its turn, so that readers need not scan from
    the beginning.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    m = messages.select("conv", "message", (role == "assistant").alias("trained"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    m = m.withColumn("size", F.length("head").cast("bigint") + F.length("body") + len(END) + 1)
    by = Window.partitionBy("conv").orderBy("message")
    m = m.withColumn("turn_start", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    m = m.withColumn("turn", F.row_number().over(by))
    start = F.col("turn_start") + F.length("head")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(END + "\n")).alias("piece"))))
    mask = F.collect_list(
        F.when(F.col("trained"), F.struct(start.alias("start"), (start + F.length("body")).alias("end"), "turn", "turn_start"))
    )
    done = m.groupBy("conv").agg(turns.alias("turns"), F.sort_array(mask).alias("loss_mask"))
    return done.select("conv", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, ``turns`` (role, text) and ``loss_text``, parsed from the output."""
    pieces = F.slice(F.split("formatted", _quoted(START), -1), 2, 2**31 - 1)
    split = formatted.select("conv", "formatted", "loss_mask", pieces.alias("pieces"))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)
    turns = F.transform(
        "pieces", lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text"))
    )
    masked = F.transform(
        "loss_mask",
        lambda s: unescape(
            F.substring(
                F.get(F.col("pieces"), s["turn"] - 1),
                (s["start"] - s["turn_start"] - len(START) + 1).cast("int"),
                (s["end"] - s["start"]).cast("int"),
            )
        ),
    )
    return split.select("conv", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
