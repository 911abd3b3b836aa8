"""Toxicity on small samples."""

import math
import random

import numpy as np

from tidemark.llm import toxicity


def test_toxicity_with_about_ten_toxic_labels(spark):
    r = random.Random(5)
    plain = ["".join(r.choices("abdefgilmnoprstuv", k=r.randint(4, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(140):
        words = r.choices(plain, k=60)
        if i % 8 == 0:
            words[10:10] = [("zwurk", "quixel", "hyxop")[(i // 8 + k) % 3] for k in range(2)]
        rows.append((i, " ".join(words)))
        if i < 88:
            labels.append((i, int(i % 8 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"zwurk", "quixel", "hyxop"} <= set(model.weights)
    got = {x.doc_id: x.toxic for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(got[i] for i in range(0, 140, 8)) and sum(got.values()) <= 20


def loss(params, x, y, grades, ridge):
    """Negative log likelihood row by row, with the penalty."""
    d = x.shape[1]
    w, cuts = params[:d], [-math.inf, *params[d:], math.inf]
    total = 0.0
    for row, k in zip(x, y, strict=True):
        z = float(row @ w)
        above = lambda t: 1.0 if t == -math.inf else 0.0 if t == math.inf else 1 / (1 + math.exp(t - z))
        total -= math.log(above(cuts[k]) - above(cuts[k + 1]))
    return total / len(y) + ridge / 2 * float(w @ w)


def test_fit_is_the_likeliest_by_brute_force():
    r = np.random.default_rng(7)
    x = r.integers(0, 3, (300, 3)).astype(float)
    z = x @ np.array([1.5, 0.7, 0.0]) + r.logistic(size=300)
    y = np.searchsorted([1.5, 3.0, 4.5], z)
    w, cuts = toxicity.fit_ordinal(x, y, 3, 1e-3, 3000)
    best = np.concatenate([w, cuts])
    least = loss(best, x, y, 3, 1e-3)
    assert list(cuts) == sorted(cuts) and w[0] > w[1] > w[2] >= 0
    for i in range(len(best)):  # no step along an axis or a random direction is better
        for h in (0.02, -0.02):
            other = best.copy()
            other[i] += h
            assert other[i] < 0 and i < 3 or loss(other, x, y, 3, 1e-3) >= least - 1e-7
    for _ in range(200):
        other = best + r.normal(0, 0.05, len(best))
        other[:3] = np.maximum(other[:3], 0)
        assert loss(other, x, y, 3, 1e-3) >= least - 1e-7


def test_grades_of_labels_are_learned(spark):
    r = random.Random(2)
    plain = ["".join(r.choices("abdefgilmnoprstuv", k=r.randint(4, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, grade = r.choices(plain, k=40), (0, 0, 0, 1, 2, 3)[i % 6]
        words += ["mild"] * (grade == 1) + ["mild", "harsh"] * (grade == 2) + ["mild", "harsh", "brutal"] * (grade == 3)
        rows.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, grade))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, level int")
    model = toxicity.fit(docs, marks, label="level")
    assert len(model.thresholds) == 3
    held = {x.doc_id: x.expected_severity for x in toxicity.score(docs, model, ["doc_id"]).collect() if x.doc_id >= 600}
    mean = [np.mean([v for i, v in held.items() if (0, 0, 0, 1, 2, 3)[i % 6] == g]) for g in range(4)]
    assert mean[0] < 0.2 and all(a + 0.5 < b for a, b in zip(mean, mean[1:], strict=False))
