"""Operators on documents against brute-force versions, with edge cases."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash, toxicity
from tidemark.llm.common import shared_dir

R = random.Random(11)
VOCAB = ["alpha", "Beta", "gamma", "é", "ñandú", "delta.", "x", "the", "of", "--", "42", "ÀB"]


def sentence(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [sentence(60) for _ in range(6)]
    out = [None, "", " \t\n", "one", "one two three", base[0], base[0], base[0] + " end", base[1].upper(), base[2] + "\n" + base[2]]
    out += [" ".join(w if R.random() > 0.03 else "zz" for w in base[3].split()) for _ in range(8)]
    return out + [sentence(3000), "a\x0bb\x0cc d\u00a0e", "For " * 200, "line\nline\n\nline\n x"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # clashing names: columns of the operators' own making are there already
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, 1, "r", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, row string, fp int")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts(docs, texts):
    got = {r.doc_id: r for r in quality.with_counts(docs).collect()}
    for i, t in enumerate(texts):
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        hit = {k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i].counts[c] for c in quality.COUNTS) == want, i
        assert got[i].n_words == 1 and got[i].row == "r"


def test_quality_keeps_rows_and_columns(spark, docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 20 - 2} | set(range(10, 18)) - {99}
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_host_verdict_reaches_clean_documents(spark):
    bad = [(i, "too short", "bad.example") for i in range(60)] + [(100, sentence(50), "bad.example")]
    good = [(200 + i, " ".join(f"w{i}x{k}" for k in range(50)), "good.example") for i in range(60)]
    kept = quality.keep_good(spark.createDataFrame(bad + good, "doc_id long, text string, source string"))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in good}


def test_many_rejected_hosts_meet_rows_without_a_broadcast_of_all(spark):
    bad = [(i, "too short", f"bad{i % 4}" if i % 2 else None) for i in range(400)] + [(1000 + i, sentence(50), "bad1") for i in range(3)]
    good = [(2000 + i, " ".join(f"w{i}x{k}" for k in range(50)), "good") for i in range(300)]
    counted = quality.with_counts(spark.createDataFrame(bad + good, "doc_id long, text string, source string"))
    hosts = quality.host_rates(counted)
    few, many = (quality.judge(counted, hosts, broadcast_hosts=n).select("doc_id", "verdict.*").collect() for n in (10, 0))
    assert sorted(few) == sorted(many)
    assert {r.doc_id for r in few if r.kept} == {r[0] for r in good} and sum(r.host_rejected for r in few) == 403


def slow_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(grams))


def classes(prints, radius=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups(docs, texts):
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp % 2**64 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == classes(prints)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(prints).values()))
    assert simhash.groups(docs.limit(0)).count() == 0


def test_keep_first_keeps_unlinked_texts_of_one_id(spark):
    other = " ".join(f"w{i}" for i in range(40))
    for parts in (1, 5):
        rows = [(1, "same words here now and then", "b"), (1, "same words here now and then", "b"), (1, other, "c"), (2, other, "d"), (None, other, "e"), (None, None, "f"), (3, None, "g"), (4, "", "h")]
        table = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(parts)
        kept = sorted(map(tuple, simhash.keep_first(table).collect()), key=str)
        assert kept == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)


def test_groups_with_a_hot_text_and_a_hot_component(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(900)] + [(1000 + i, " ".join(words[:-1] + [f"x{i}"])) for i in range(400)] + [(5000 + i, sentence(30)) for i in range(200)]
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    distinct = {}
    for i, f in sorted(prints.items()):
        distinct.setdefault(f, i)
    root = classes({i: f for f, i in distinct.items()})
    assert got == {i: root[distinct[f]] for i, f in prints.items()}


@pytest.mark.parametrize("split_over", [20_000, 8])
def test_covering_finds_every_link(spark, split_over):
    """Chains and dense balls, with buckets split down to a few members."""
    values = set()
    for _ in range(3):
        x = R.getrandbits(64)
        for _ in range(10):
            values.add(x)
            for b in R.sample(range(64), R.randint(1, 5)):
                x ^= 1 << b
    values |= {0, 1, 3, 7, 2**64 - 1}
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    found = simhash.components(simhash.links(fps, 4, split_over))
    got = {r.node % 2**64: r.root for r in found.collect()}
    want = classes({v: v for v in values})
    pair = {}
    for v in values:
        pair.setdefault(want[v], set()).add(got.get(v, v))
    sizes = {c: sum(want[v] == c for v in values) for c in set(want.values())}
    for c, roots in pair.items():
        assert len(roots) == 1 or sizes[c] == 1
    assert len({frozenset(r) for r in pair.values()}) == len(pair)


def test_masks_cover_every_radius_4_difference():
    tables = simhash.masks(4)
    for _ in range(5000):
        x = 0
        for b in R.sample(range(64), 4):
            x |= 1 << b
        assert any(x & m == 0 for m in tables)


def test_bit_counts():
    for n in (1, 2, 3, 7, 100):
        h = np.array([R.getrandbits(64) for _ in range(n)], np.uint64)
        assert simhash.bit_counts(h).tolist() == [sum(int(x) >> b & 1 for x in h) for b in range(64)]


def doc_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


@pytest.mark.parametrize("shard,block", [(10**6, 10**6), (40, 25)])
def test_decontamination(spark, shard, block):
    items = [(i, sentence(n)) for i, n in enumerate((14, 30, 12, 4, 1))] + [(9, None), (10, ""), (11, "--"), (12, "a a a a a a a a a a a a")]
    items += [(1, sentence(12)), (None, sentence(11)), (0, items[0][1]), (None, items[3][1])]  # every row is an item
    docs = [None, "", "--", sentence(80), re.sub("[a-z]", lambda m: m[0].upper(), items[0][1]) + "!", "x1 " + items[1][1] + " y1 " + items[1][1], items[3][1], " ".join(items[0][1].split()[:9]), "q a" + " a" * 40]
    docs += [sentence(20) + " " + items[2][1] + " " + sentence(20) for _ in range(5)] + [docs[5], items[9][1] + " " + items[1][1] + " x " + items[10][1]]
    windows = {}
    for n, (_, t) in enumerate(items):
        w = doc_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(n)
    rows = spark.createDataFrame(list(enumerate(docs)), "n_words long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(rows, table, shard_words=shard, block_words=block).select("row.n_words", "found.spans", "found.items", decontaminate.n_hit().alias("n")).collect()
    for r in found:
        w, hit, names = doc_words(docs[r[0]]), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                own = windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if own:
                    hit |= set(range(k, k + n))
                    names |= own
        assert {x for a, b in r.spans for x in range(a, b)} == hit and r.n == len(hit)
        assert sorted(r["items"], key=str) == sorted((None if items[n][0] is None else str(items[n][0]) for n in names), key=str)
    clean = decontaminate.clean(rows, table)
    assert clean.columns == rows.columns
    left = {r.n_words: r.text for r in clean.collect()}
    assert left[0] is None and left[1] == "" and left[2] == "--" and 4 not in left
    assert items[1][1] not in left[5] and "x1" in left[5] and "y1" in left[5]
    assert decontaminate.clean(rows.limit(0), table).count() == 0
    assert decontaminate.clean(rows, table.limit(0)).count() == len(docs)


def test_decontamination_by_many_blocks_copies_nothing(spark):
    """One pass, no table of its own and the same result, however many blocks the test set has."""
    items = spark.createDataFrame([(i, sentence(30)) for i in range(40)], "item_id long, text string")
    texts = [sentence(25) + " " + r.text + " " + sentence(25) for r in items.collect()] + [sentence(200) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = set(os.listdir(shared_dir(spark)))
    few, many = (decontaminate.find(docs, items, block_words=n) for n in (10**6, 30))
    got = [sorted((r.row.doc_id, r.found.n_words, [tuple(s) for s in r.found.spans], sorted(r.found["items"])) for r in f.collect()) for f in (few, many)]
    assert got[0] == got[1] and all(str(i) in r[3] for i, r in enumerate(got[0][:40]))
    assert set(os.listdir(shared_dir(spark))) == before
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and decontaminate.clean(docs, items, block_words=30).count() == 60


def test_fm_index_counts_and_locates():
    for _ in range(20):
        s = np.array([R.randint(0, 3) for _ in range(R.randint(1, 200))] + [0])
        index = decontaminate.FmIndex(s, 3)
        for n in (1, 2, 3, 5):
            p = np.array([[R.randint(1, 3) for _ in range(n)] for _ in range(10)])
            lo, hi = index.search(p)
            for row, a, b in zip(p, lo, hi, strict=True):
                want = [i for i in range(len(s) - n + 1) if s[i : i + n].tolist() == row.tolist()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_secrets(spark):
    ts = [None, "", 'password = "hunter22"', "TOKEN:token:abcdefgh", "secret=abc", "AKIA" + "A" * 16 + "b", "AKIAshort", "f" * 24 + "g", "f" * 23, "é api_key: 'a.b_c-9'"]
    ts += ["ſecret=abcdef", "id xK9fQ2vTz7LwPq4RmB8nYc3HdJ6s end", "uuid 123e4567-e89b-12d3-a456-426614174000", "a/long/path/of/plain/words/only", "token=" + "x9" * 40_000]
    rows = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(rows, ["doc_id"]).collect()}
    assert got[2] == [("assign", 0, 20)]
    assert got[3] == [] or [s[0] for s in got[3]] == ["assign"]
    assert got[4] == [] and got[5] == [("access", 0, 20)] and got[6] == [] and got[7] == [("hex", 0, 24)] and got[8] == []
    assert got[9] == [("assign", 2, 19)] and got[10] == []
    assert got[11] == [("random", 3, 31)] and got[12] == [] and got[13] == []
    masked = {r.doc_id: r.text for r in secrets.mask(rows).collect()}
    assert masked[0] is None and masked[2] == '[assign]"' and masked[11] == "id [random] end" and masked[4] == ts[4]
    assert secrets.mask(rows.limit(0)).columns == ["doc_id", "text"]


def slow_base(text):
    """The base kinds character by character."""
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey")

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def value(at):
        at += at < len(text) and text[at] in "\"'"
        at = run(at, " ")
        if at >= len(text) or text[at] not in ":=":
            return None
        at = run(at + 1, " ")
        at += at < len(text) and text[at] in "\"'"
        end = run(at, WIDE)
        return (at, end) if end > at else None

    WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    at = 0
    while at < len(text):
        found = [value(at + len(k)) for k in keys if low.startswith(k, at)]
        found = [f for f in found if f]
        if found:
            if found[0][1] - found[0][0] >= 6:
                out.append((at, 0, found[0][1]))
            at = found[0][1]
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at + 4, WIDE[:26] + WIDE[52:62]) if text.startswith("AKIA", at) else at
        if end > at + 4:
            out += [(at, 1, end)] * (end - at >= 20)
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, "0123456789abcdef")
        out += [(at, 2, end)] * (end - at >= 24)
        at = max(end, at + 1)
    return sorted(out)


def test_secrets_against_brute_force(spark):
    encoding = secrets.vocabulary(None)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_run = lambda k: "".join(R.choice(alphabet) for _ in range(k))
    parts = ["token", "TOKEN", "Api_Key", "apikey", "password", "=", ":", " ", "  ", '"', "'", "AKIA", "A" * 16, "0" * 24, "f" * 23, "é", "\n", ".", "-", "x", "some plain words"]
    texts = ["", None] + ["".join(R.choice(parts) if R.random() < 0.9 else random_run(R.randint(5, 40)) for _ in range(R.randint(1, 25))) for _ in range(1500)]
    for t in texts:
        got = secrets.spans(t or "", encoding)
        base = [s for s in got if s[1] != 3]
        assert base == slow_base(t or ""), ascii(t)
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or "")]
        want = [(a, 3, b) for a, b in runs if not any(s <= a and b <= e for s, _, e in base) and secrets.is_random(t[a:b], encoding, 2.0, 1.6)]
        assert [s for s in got if s[1] == 3] == want, ascii(t)


def test_secrets_in_long_texts_and_without_digits(spark):
    encoding = secrets.vocabulary(None)
    text = " ".join(f"token=abc{i:06d} xK9fQ2vTz7LwPq4RmB8nYc3HdJ{i % 10}s" for i in range(50_000))
    assert len(secrets.spans(text, encoding)) == 100_000
    assert secrets.spans("key KqZbXwVtRmYpLdJhGfSnCz end", encoding) and not secrets.spans("use getUserNameFromDatabaseTable here", encoding)
    table = spark.createDataFrame([(1, "token=abcdefgh", "x")], "doc_id long, text string, spans string")
    assert secrets.scan(table, table.columns).columns == ["doc_id", "text", "spans", "spans_"]


def test_bpe_is_exact(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    parts = ["a", "th", "ing", "'s", "'LL", " ", "\x1c", "\x85", "é", "\u0301", "Σ", "ΑΣ ", "İ", "ß", "<|endoftext|>", "<|start", "日本", "1", "²", "!!", "\U0001f600", "\u1c89", "\ua7cb", "\n"]
    cases = ["", "Hello world", "x" * 3000] + ["".join(R.choice(parts) for _ in range(R.randint(1, 15))) for _ in range(3000)]
    for t in cases:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, ascii(t)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    rows = spark.createDataFrame([(1, None, 5), (2, cases[1], 5), (2, cases[1], 5)], "doc_id long, text string, n_tokens int")
    got = bpe.digests(rows, ["doc_id"], with_ids=True).orderBy("doc_id").collect()
    assert got[0].n_tokens == 0 and got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].ids == library.encode(cases[1], add_special_tokens=False).ids and got[1] == got[2]
    ids = bpe.encode(rows, ["doc_id"])
    assert {r.decoded for r in bpe.decode(ids, ["doc_id"]).collect()} == {"", library.decode(got[1].ids, skip_special_tokens=False)}
    assert bpe.digests(rows.limit(0), ["doc_id"]).count() == 0


def test_toxicity_held_out(spark):
    bad, good = ["nasty", "vile", "foul"], [a + b for a in "bcdfghjk" for b in ("ala", "emo", "iru", "opo", "usi")]
    rows, labels = [], []
    for i in range(600):
        w = [R.choice(good) for _ in range(R.randint(20, 60))]
        toxic = i % 4 == 0
        for _ in range(R.choice((1, 3, 8)) if toxic else 0):
            w.insert(R.randrange(len(w)), R.choice(bad))
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "vile " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = range(400, 600)
    assert sum(got[i].toxic == (i % 4 == 0) for i in held) >= 190
    assert not got[900].toxic and not got[901].toxic and got[902].toxic
    assert got[902].expected_severity > got[900].expected_severity
    assert list(model.thresholds) == sorted(model.thresholds)
    none = toxicity.fit(docs, marks.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, none, ["doc_id"]).collect())
