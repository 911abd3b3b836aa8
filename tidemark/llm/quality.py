"""Quality rules judged per document and per host.

Every document gets counts and rule failures from column expressions; failures
are summed per host, each host's failure rate is shrunk towards an empirical
beta prior, and the host verdicts are joined back.  Only built-in functions run
on the executors.

Edge cases: a null or empty text has no words, so it fails the length rule; a
null host is a host of its own; repeated rows are judged one by one; an empty
table gives an empty result; columns of the input keep their names and values,
and clashing helper names get a trailing underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_hot, words_of, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["base", "symbols", "dup_lines", "word_length"]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    ``symbol_share`` and ``dup_line_share`` are shares of words; mean word
    length is in code points.  A host is rejected when the lower end
    (``host_z`` standard deviations) of its shrunk rate of failing documents
    is over ``host_rate``.
    """

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    symbol_share: float = 0.5
    dup_line_percent: int = 30
    min_word_length: float = 1.5
    max_word_length: float = 40.0
    host_rate: float = 0.5
    host_z: float = 2.0


def repeated_words(df: DataFrame, words: str, out: str, window: int = 5) -> DataFrame:
    """Add the number of words in windows that occur twice or more in the row.

    Windows are compared by a 64-bit hash of their words within one row.  Only
    rows with a repeated hash are sorted.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    h, s, p = (free_name(df, x) for x in ("_hashes", "_sorted", "_starts"))
    w, n = F.col(f"`{words}`"), F.size(F.col(f"`{words}`"))
    hashes = F.when(
        n >= window,
        F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, hashes.alias(h))
    repeated = F.size(F.array_distinct(F.col(h))) < F.size(F.col(h))
    ranked = F.when(repeated, F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.select(*keep, ranked.alias(s))
    twice = F.filter(
        F.col(s),
        lambda x, i: F.coalesce(x["h"] == F.get(F.col(s), i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(F.col(s), i + 1)["h"], F.lit(False)),
    )
    df = df.select(*keep, F.when(F.size(F.col(s)) > 0, F.sort_array(F.transform(twice, lambda x: x["i"]))).alias(p))
    covered = F.aggregate(
        F.transform(F.col(p), lambda x, k: F.least(F.lit(window), F.coalesce(F.get(F.col(p), k + 1) - x, F.lit(window)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return df.select(*keep, F.coalesce(covered, F.lit(0).cast("bigint")).alias(out))


def with_counts(df: DataFrame, text: str | Column = "text", rules: Rules = Rules(), out: str = "counts") -> DataFrame:
    """Add the struct ``out`` of the fields ``COUNTS`` to every row.

    A column that is called ``out`` already is replaced; all others stay.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    t = F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit(""))
    w, lines, part, repeated = (free_name(df, x) for x in ("_words", "_lines", "_part", "_repeated"))
    df = df.select(
        *keep,
        words_of(t).alias(w),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias(part),
    )
    df = df.select(
        *keep,
        F.col(w),
        F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.col(part).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        ).alias(part),
    )
    counted = repeated_words(df, w, repeated, rules.window)
    return counted.select(*keep, F.col(part).withField("n_repeat_words", F.col(repeated)).alias(out))


def failures(rules: Rules = Rules(), counts: str = "counts") -> dict[str, Column]:
    """Rule name to a condition on the struct of counts; true is a failure."""
    c = lambda name: F.col(f"`{counts}`.{name}")
    words, chars = c("n_words"), c("word_chars")
    return {
        "base": (words < rules.min_words) | (100 * c("n_repeat_words") > rules.repeat_percent * words),
        "symbols": c("n_symbols") > rules.symbol_share * words,
        "dup_lines": 100 * c("n_dup_lines") > rules.dup_line_percent * words,
        "word_length": (chars < rules.min_word_length * words) | (chars > rules.max_word_length * words),
    }


def host_rates(counted: DataFrame, host: str | Column = "source", rules: Rules = Rules(), counts: str = "counts") -> DataFrame:
    """Per host: documents, failing documents per rule, shrunk rate, verdict.

    ``rate`` is the posterior mean of the share of documents that fail any
    rule, under a beta prior fitted to all hosts by moments; ``host_rejected``
    compares its lower end with the limit.
    """
    flags = failures(rules, counts)
    host = F.col(f"`{host}`") if isinstance(host, str) else host
    any_rule = F.greatest(*[f.cast("int") for f in flags.values()])
    hosts = written(
        counted.groupBy(host.alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(any_rule).alias("n_failed"),
            *[F.sum(f.cast("int")).alias(f"failed_{k}") for k, f in flags.items()],
        ),
        "hosts",
    )
    share = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(share), F.var_samp(share)).first()  # two numbers, whatever the input
    m = min(max(m if m is not None else 0.5, 1e-3), 1 - 1e-3)
    strength = min(max(m * (1 - m) / v - 1, 1.0), 1e4) if v else 10.0
    a, b = F.col("n_failed") + m * strength, F.col("n_docs") - F.col("n_failed") + (1 - m) * strength
    low = a / (a + b) - rules.host_z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("*", (a / (a + b)).alias("rate"), (low > rules.host_rate).alias("host_rejected"))


#: Rejected hosts (a name each) that are broadcast; more go through ``join_hot``.
BROADCAST_HOSTS = 100_000


def judge(
    counted: DataFrame,
    hosts: DataFrame,
    host: str | Column = "source",
    rules: Rules = Rules(),
    counts: str = "counts",
    out: str = "verdict",
    broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """Add the struct ``out`` of ``base_failed``, ``host_rejected`` and ``kept`` to counted rows.

    A document goes if it fails the base rule or the symbol rule itself, or if
    its host is rejected.  Rows meet rejected hosts only.  Up to
    ``broadcast_hosts`` of them are broadcast, and no row moves; of more, the
    frequent ones are, and the rows of no other host are many.
    """
    flags = failures(rules, counts)
    own, flag, size = (free_name(counted, c) for c in ("_host", "_rejected", "_docs"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(own)  # noqa: E731 (a null host is one)
    verdicts = hosts.filter("host_rejected").select(named(F.col("host")), F.lit(True).alias(flag), F.col("n_docs").alias(size))
    host = F.col(f"`{host}`") if isinstance(host, str) else host
    rows = counted.select("*", named(host))
    if verdicts.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(verdicts.drop(size)), own, "left")
    else:
        joined = join_hot(rows, verdicts, [own], size, hosts.agg(F.sum("n_docs")).first()[0], "left")
    rejected = F.coalesce(F.col(flag), F.lit(False))
    verdict = F.struct(
        flags["base"].alias("base_failed"),
        rejected.alias("host_rejected"),
        (~flags["base"] & ~flags["symbols"] & ~rejected).alias("kept"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns if c.lower() != out.lower()], verdict.alias(out))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns untouched.

    Rows are counted once: they are written with their counts, and both the
    host rates and the verdicts are read from there.
    """
    rows = docs.select(F.struct("*").alias("row"))
    counted = written(with_counts(rows, F.col(f"row.`{text}`"), rules), "counted")
    source = F.col(f"row.`{host}`")
    judged = judge(counted, host_rates(counted, source, rules), source, rules)
    return judged.filter("verdict.kept").select("row.*")
