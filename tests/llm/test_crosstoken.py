"""Cross-tokenizer alignment against brute force, with edge cases."""

import hashlib

import numpy as np
import pytest

from tests.oracle import SF
from tidemark.llm import crosstoken, mphf, queries


def slow(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    files = crosstoken.default_files()
    a_lib, b_lib = Tokenizer.from_file(files[0]), SentencePieceProcessor(model_file=files[1])
    a_lib.encode_special_tokens = True
    letters = crosstoken.byte_letters()

    def spans(tokens, whole):
        ends, at = [], 0
        for _, b in tokens:
            at += len(b)
            ends.append(at)
        return ends if b"".join(b for _, b in tokens) == whole else None

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    out, counts = [], {}
    for t in texts:
        groups = []
        if t:
            e = a_lib.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in x)) for i, x in zip(e.ids, e.tokens)]
            b = [(i, piece(i)) for i in b_lib.encode(t)]
            ea, eb = spans(a, b" " + t.encode()), spans(b, b" " + t.encode())
            if ea and eb:
                cuts, i, j = sorted(set(ea) & set(eb)), 0, 0
                for c in cuts:
                    i2, j2 = i, j
                    while i2 < len(ea) and ea[i2] <= c:
                        i2 += 1
                    while j2 < len(eb) and eb[j2] <= c:
                        j2 += 1
                    groups.append(([x for x, _ in a[i:i2]], [x for x, _ in b[j:j2]]))
                    i, j = i2, j2
        out.append(groups)
        for p in {(x, y) for g in groups for x in g[0] for y in g[1]}:
            counts[p] = counts.get(p, 0) + 1
    peak = {}
    for (x, _), n in counts.items():
        peak[x] = max(peak.get(x, 0), n)
    rows = []
    for groups in out:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == peak[p[0]] for p in links), sum(counts[p] for p in links), told))
    return rows


TEXTS = [None, "", " ", "one", "one", "Two words", "two  spaces", "tab\tand\nline\n", "ünïcödé ñandú", "日本語のテキスト", "ﬁ ligature", "é decomposed é", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ piece", "𝔘𝔫𝔦 🙂🙂", "\x00 nul", " " * 3000 + "x", "a" * 5000, "12345 67,890.00"]


def test_edge_cases_and_both_ways_of_lookup(spark):
    rows = [(i if i % 5 else None, t, 3) for i, t in enumerate(TEXTS + TEXTS[3:8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int").repartition(3)
    want = sorted(((r[0], r[1], r[2], *x) for r, x in zip(rows, slow([r[1] for r in rows]))), key=str)
    for resident, shard, least in ((1 << 20, 1 << 18, 1 << 21), (40, 16, 5), (0, 7, 1)):
        got = crosstoken.align(docs, resident=resident, shard=shard, least=least)
        assert got.columns == [*docs.columns, *crosstoken.COUNTED]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert crosstoken.align(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        crosstoken.align(docs.withColumnRenamed("pair", "N_links"))


def test_links_of_endless_groups_come_in_blocks(monkeypatch):
    kinds, lengths = ("<u2", "<u2"), (np.array([2, 3]), np.array([3, 4]))
    one = crosstoken.Aligned([np.zeros(300, "<u2").tobytes()], [np.zeros(200, "<u2").tobytes()], kinds, lengths)
    whole = [x.tolist() for x in one.pairs()]
    monkeypatch.setattr(crosstoken, "BLOCK", 3)
    assert [x.tolist() for x in one.pairs()] == whole


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 20_000))
    made = mphf.PerfectHash.build(keys)
    again = mphf.PerfectHash.from_bytes(made.to_bytes())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys))) and made.size == len(keys)
    ordered = np.empty(len(keys), "<i8")
    ordered[made.index(keys)] = keys
    table = mphf.CountTable(made.to_bytes(), ordered.tobytes(), (ordered * 3).tobytes())
    assert (table.find(keys) == keys * 3).all() and not table.find(keys + 1)[~np.isin(keys + 1, keys)].any()
    with pytest.raises(ValueError):
        mphf.PerfectHash.build(np.array([5, 5, 6]))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: r for d, r in zip(docs, slow([d.text for d in docs]))}
    got = queries.queries()["op12_cross_tokens"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == want[r.doc_id][:6]
        assert r.groups_sha256 == (hashlib.sha256(want[r.doc_id][6].encode()).hexdigest() if want[r.doc_id][6] else "")
