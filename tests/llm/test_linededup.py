"""Line dedup against brute force, with edge cases."""

import random

from tidemark.llm import linededup

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def slow(texts, min_docs, min_chars=1):
    keys = [[x.strip(WHITE).translate(FOLD) for x in (t or "").split("\n")] for t in texts]
    docs = {}
    for own in keys:
        for k in set(own):
            docs[k] = docs.get(k, 0) + 1
    out = []
    for t, own in zip(texts, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own) if len(k) < min_chars or docs[k] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_edge_cases(spark):
    shared = ["Shared LINE", "\tshared line\r", "  ", "É Upper", "é upper", " shared line", "x" * 5000]
    r = random.Random(3)
    texts = [None, "", " ", "\n", "\n\n", "a\n", "\na", "shared line", "shared line", "a\n\nb\n \nc"]
    texts += ["\n".join(r.choice(shared + [f"own {i}", "", f"pair {i // 2}"]) for _ in range(r.randrange(1, 12))) for i in range(40)]
    texts += ["shared line\n" * 20_000]
    rows = [(i if i % 7 else None, t, i % 3, "kept", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, h1 string, at int")
    for least, chars, most in ((2, 1, 10**6), (2, 1, 0), (10, 1, 10), (3, 4, 0)):
        got = linededup.drop_frequent_lines(docs.repartition(3), ["doc_id"], min_docs=least, min_chars=chars, broadcast_keys=most)
        assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
        want = [(r[0], x[2], r[2], r[3], r[4], x[0], x[1]) for r, x in zip(rows, slow(texts, least, chars))]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert linededup.drop_frequent_lines(docs.limit(0), ["doc_id"]).count() == 0


def test_repeated_rows_are_documents(spark):
    docs = spark.createDataFrame([(1, "same\nrow")] * 3 + [(2, "row\nother")], "doc_id long, text string")
    got = linededup.drop_frequent_lines(docs, ["doc_id"], min_docs=3)
    assert sorted(r.text for r in got.collect()) == ["", "", "", "other"]
    assert sorted(r.text for r in linededup.drop_frequent_lines(docs, ["doc_id"], min_docs=4).collect()) == ["other", "same", "same", "same"]


def test_hot_keys_are_dealt_evenly(spark):
    """Of more keys than are broadcast the hottest are; their rows go on under keys of their own."""
    texts = ["\n".join(["everywhere", f"some {i % 40}", f"own {i}"]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = linededup.drop_frequent_lines(docs, ["doc_id"], min_docs=10, broadcast_keys=5)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(i, f"own {i}") for i in range(400)]
