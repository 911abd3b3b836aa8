"""Toxicity grades by cumulative-link ordinal regression on sparse word counts.

One weight vector is shared by ordered thresholds: P(grade >= k) is the
logistic of the weighted words less threshold k.  A document's expected
severity is the sum of these probabilities.

Labels are whole numbers from 0 (not toxic) up, with a threshold for each grade.
Labels that say only toxic or not carry no severity; their toxic documents are
graded 1 to ``grades`` by how much telling language they have (quantiles of the
toxic sample).  Which words tell is decided on the other half of the sample, so
no document's grade rests on its own label.  The words found there are mostly
those that the model has as features too, so such grades are a stand-in for
severity, made of counts of the same language; they test nothing.

The model is fitted on at most about ``max_labelled`` labelled documents,
chosen by a hash of their id; near copies among them count once.  Features are
at most ``max_features`` words that toxic documents use significantly more: the
likelihood ratio of a word's counts must be so unlikely that among all words of
the sample ``chance`` are expected to reach it.  The bar thus follows the size
of the sample, and there is no least number of documents.

Edge cases: null and empty texts have no features and get the severity of the
empty text; with no toxic label or no telling word every severity is that of a
model without features; repeated rows are scored one by one; of labels of one
document that disagree the highest counts, null labels don't; further columns
pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: bytes | None) -> list[str]:
    return _LETTERS.findall((text or b"").decode().lower())


#: Lengths of the word beginnings that are features besides whole words.
STEMS = (5, 7)


def features_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a star: inflected forms share them."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def counted(found: list[str], known: dict | None = None) -> Counter[str]:
    """How often each feature (of ``known``, if given) occurs."""
    counts: Counter[str] = Counter()
    for w, n in Counter(found).items():
        for f in features_of(w):
            if known is None or f in known:
                counts[f] += n
    return counts


def strength(count: int) -> float:
    """Value of a feature that occurs."""
    return math.log2(1 + count)


@dataclass(frozen=True)
class Settings:
    """``chance``: features expected to be chosen by chance.

    ``ridge``: the penalty on weights.  ``cut``: probability of grade 1 or more
    that makes a document toxic.
    """

    max_labelled: int = 10_000
    max_features: int = 512
    chance: float = 1.0
    ridge: float = 1e-5
    grades: int = 3
    steps: int = 1500
    cut: float = 0.4


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, counts: dict[str, int]) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        score = math.fsum(w * strength(counts[t]) for t, w in self.weights.items() if t in counts)
        return [1 / (1 + math.exp(min(max(t - score, -500), 500))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum likelihood (Adam on all rows).

    Weights stay at zero or above, since features are chosen for pointing at
    toxic texts; thresholds are kept in order through positive gaps.
    """
    both, n_each = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)  # equal rows once, with their number
    x, y, share = both[:, :-1], both[:, -1].astype(int), n_each / n_each.sum()
    n, d = x.shape
    w, first, gaps = np.zeros(d), np.array([2.0]), np.zeros(grades - 1)
    params = np.concatenate([w, first, gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, theta = params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])
        z = x @ w
        # P(y = k) = above[k] - above[k + 1]
        above = np.column_stack([np.ones(n), *[sigmoid(z - t) for t in theta], np.zeros(n)])
        rows = np.arange(n)
        p = np.maximum(above[rows, y] - above[rows, y + 1], 1e-12)
        slope = above * (1 - above)
        up, down = slope[rows, y] / p, slope[rows, y + 1] / p
        grad_z = -(up - down) * share
        up, down = up * share, down * share
        grad_t = np.array([np.sum(np.where(y == k, up, 0) - np.where(y == k - 1, down, 0)) for k in range(1, grades + 1)])
        grad = np.concatenate([x.T @ grad_z + ridge * w, [grad_t.sum()], np.exp(params[d + 1 :]) * np.cumsum(grad_t[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        params[:d] = np.maximum(params[:d], 0)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def sample(docs: DataFrame, labels: DataFrame, settings: Settings, label: str = "toxic") -> DataFrame:
    """(grade, half, words, counts) of the labelled documents that the model is fitted on."""
    total = labels.count()
    share = min(1.0, settings.max_labelled / max(total, 1))
    chosen = labels.filter(F.col(label).isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("_grade"))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about max_labelled rows of two numbers

    def make():
        def work(texts):
            for t in texts:
                found = words(t)
                least = min((hash_of(found[i : i + 5]) for i in range(max(1, len(found) - 4))), default=0) if found else 0
                counts = counted(found)
                yield list(counts), list(counts.values()), least

        return work

    rows = map_rows(picked, ["text"], "words array<string>, counts array<int>, least long", make, keep=["_grade"])
    # near copies share the least hash of their five-word shingles more often than not
    return rows.groupBy("least", "_grade").agg(F.min(F.struct("words", "counts")).alias("w")).select(F.col("_grade").alias("grade"), F.pmod("least", F.lit(2)).cast("int").alias("half"), "w.words", "w.counts")


def hash_of(gram: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(gram)) >> 1


def telling(stats: DataFrame, a: str, b: str, toxic: int, clean: int, settings: Settings) -> list[str]:
    """The words that toxic documents use more, best first; columns ``a`` and ``b`` count the toxic and the other documents with a word."""
    stats = stats.select("word", F.expr(a).alias("a"), F.expr(b).alias("b")).filter("a + b > 0")
    bar = NormalDist().inv_cdf(1 - min(0.5, settings.chance / max(stats.count(), 1)))
    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    part = lambda seen, share, of: F.when(seen > 0, seen * F.log(seen * (toxic + clean) / (share * of))).otherwise(0.0)
    rest = toxic + clean - both
    ratio = part(a, toxic, both) + part(b, clean, both) + part(toxic - a, toxic, rest) + part(clean - b, clean, rest)
    z = F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))
    best = stats.filter(a * clean > b * toxic).select("word", z.alias("z")).filter(F.col("z") >= bar)
    return [r.word for r in best.orderBy(F.desc("z"), "word").limit(settings.max_features).collect()]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic") -> Model:
    """The model of the grades in column ``label`` of ``labels`` (doc_id, label)."""
    rows = written(sample(docs, labels, settings, label), "labelled")
    is_toxic = F.col("grade") > 0
    n = {(r.half, r.t): r["count"] for r in rows.groupBy("half", is_toxic.alias("t")).count().collect()}
    total = lambda t, halves=(0, 1): sum(n.get((h, t), 0) for h in halves)
    seen = rows.select("grade", "half", F.explode("words").alias("word"))
    stats = seen.groupBy("word").agg(*[F.count_if((is_toxic if k == "a" else ~is_toxic) & (F.col("half") == h)).alias(f"{k}{h}") for k in "ab" for h in (0, 1)])
    stats = written(stats, "word_counts")
    features = telling(stats, "a0 + a1", "b0 + b1", total(True), total(False), settings)
    others = [set(telling(stats, f"a{1 - h}", f"b{1 - h}", total(True, (1 - h,)), total(False, (1 - h,)), settings)) for h in (0, 1)]
    known = sorted({*features, *others[0], *others[1]})
    pairs = F.arrays_zip("words", "counts")
    kept = F.filter(pairs, lambda p: p["words"].isin(known)) if known else F.slice(pairs, 1, 0)
    local = rows.select("grade", "half", kept.alias("found")).collect()  # bounded by the sample
    if not local:
        return Model({}, (2.0,))
    place = {w: i for i, w in enumerate(features)}
    x = np.zeros((len(local), len(features)))
    for i, r in enumerate(local):
        for w, c in r.found:
            if w in place:
                x[i, place[w]] = strength(c)
    y = np.array([max(r.grade, 0) for r in local], int)
    if y.max() == 1 and settings.grades > 1:
        amount = np.array([sum(c / len(STEMS) if w.endswith("*") else c for w, c in r.found if w in others[r.half]) for r in local])
        toxic = y == 1
        marked = amount[toxic & (amount > 0)]
        if len(marked):
            cuts = np.quantile(marked, np.arange(1, settings.grades) / settings.grades)
            y[toxic] = 1 + np.searchsorted(cuts, amount[toxic], side="left")
    weights, thresholds = fit_ordinal(x, y, max(int(y.max()), 1), settings.ridge, settings.steps)
    return Model(dict(zip(features, weights.tolist(), strict=True)), tuple(thresholds.tolist()))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``keep``, expected_severity, p_toxic and toxic for every text."""

    def make():
        known = model.weights

        def work(texts):
            for t in texts:
                p = model.at_least(counted(words(t), known))
                yield math.fsum(p), p[0], p[0] >= settings.cut

        return work

    return map_rows(docs, [text], "expected_severity double, p_toxic double, toxic boolean", make, keep=keep)
