"""Queries against their SQL or, where SQL can't say it, against brute force over whole tables."""

import hashlib
import re

import pytest

from tests.llm.test_documents import classes, doc_words, slow_base, slow_print
from tests.oracle import SF, compare
from tidemark.llm import bpe, queries, secrets


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_query(spark, texts):
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = doc_words(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    sizes = {len(x) for x in windows}
    for r in queries.queries()["op1_decontamination"](spark, SF).collect():
        w, hit, items = doc_words(texts[r.doc_id]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= own
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == digest(",".join(sorted(items)))


def test_op2_query(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in queries.queries()["op2_bpe"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(raw), digest(library.decode(ids, skip_special_tokens=False)))


def test_op7_query(spark, texts):
    encoding = secrets.vocabulary(None)
    for r in queries.queries()["op7_secret_scan"](spark, SF).collect():
        t = texts[r.doc_id] or ""
        base = slow_base(t)
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
        more = [(a, 3, b) for a, b in runs if not any(s <= a and b <= e for s, _, e in base) and secrets.is_random(t[a:b], encoding, 2.0, 1.6)]
        told = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == digest(told(base)) and r.spans == told(base + more)


def test_op9_query(spark, texts):
    prints = {i: slow_print(t) for i, t in texts.items()}
    root = classes(prints)
    got = queries.queries()["op9_simhash_groups"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", root[i]) for i, f in prints.items()}
