import re
import statistics

import corpus_pipeline
from tests.llm.test_documents import classes, doc_words, slow_base, slow_print
from tidemark.llm import bpe, decontaminate, quality, queries, secrets
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    assert all(d.columns == docs.columns for d in seen[:-1])
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find(seen[3], items).filter(decontaminate.n_hit() > 0).count() == 0
    ids = {r.doc_id: r.n_tokens for r in seen[5].collect()}
    own = bpe.WordBpe(bpe.default_vocabulary())
    assert ids == {r.doc_id: len(own.encode(r.text)) for r in seen[4].collect()}


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


def slow_kept(rows, rules=quality.Rules()):
    """Rows that the quality rules keep, by the definitions."""
    fails, own = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeated = len({k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(5)})
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, n = sum(map(len, w)), len(w)
        base = n < 10 or 100 * repeated > 20 * n
        symbols = len(re.findall(r"[#*$%&|<>]", r.text or "")) > 0.5 * n
        own.append(base or symbols)
        fails.append(base or symbols or 100 * (len(lines) - len(set(lines))) > 30 * n or not 1.5 * n <= chars <= 40 * n)
    hosts = {}
    for r, f in zip(rows, fails, strict=True):
        hosts.setdefault(r.source, []).append(f)
    shares = [sum(f) / len(f) for f in hosts.values()]
    m, v = min(max(statistics.fmean(shares), 1e-3), 1 - 1e-3), statistics.variance(shares) if len(shares) > 1 else 0
    s = min(max(m * (1 - m) / v - 1, 1.0), 1e4) if v else 10.0
    rejected = set()
    for h, f in hosts.items():
        a, b = sum(f) + m * s, len(f) - sum(f) + (1 - m) * s
        if a / (a + b) - 2 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 > 0.5:
            rejected.add(h)
    return [r for r, bad in zip(rows, own, strict=True) if not bad and r.source not in rejected]


def test_run_against_brute_force(spark):
    """run() over whole tables: every stage by its definition, one after another."""
    from tokenizers import Tokenizer

    docs = slow_kept(spark.read.parquet(f"{SF}/documents.parquet").collect())
    root = classes({r.doc_id: slow_print(r.text) for r in docs})
    docs = {r.doc_id: r.text for r in docs if root[r.doc_id] == r.doc_id}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = doc_words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    encoding, library = secrets.vocabulary(None), Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for i, t in docs.items():
        w, hit = doc_words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit:
            if len(hit) == len(w):
                continue
            places = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.encode())]
            raw, at, parts = t.encode(), 0, []
            for k in range(len(w)):
                if k in hit and k - 1 not in hit:
                    parts.append(raw[at : places[k][0]])
                if k in hit and k + 1 not in hit:
                    at = places[k][1]
            t = b"\n".join([*parts, raw[at:]]).decode()
        base = slow_base(t)
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
        more = [(a, 3, b) for a, b in runs if not any(s <= a and b <= e for s, _, e in base) and secrets.is_random(t[a:b], encoding, 2.0, 1.6)]
        assert not more  # none in these documents
        out, at = [], 0
        for a, k, b in sorted(base, key=lambda x: (x[0], -x[2])):
            if a >= at:
                out += [t[at:a], f"[{secrets.KINDS[k]}]"]
            at = max(at, b)
        t = "".join([*out, t[at:]])
        want[i] = library.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert got == want


def sentence(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Each stage keeps its rows and all columns; the columns have the names of the operators' helpers."""
    texts = [sentence(k) for k in range(6)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (3, None), (4, ""), (5, texts[3] + " token=abcdef123"), (6, texts[4] + "\n" + texts[5])]
    extra = ["row", "found", "fp", "counts", "verdict", "_id", "_digest", "spans", "_masked", "words", "n_words", "root"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else "s", 0, *extra) for k, (i, t) in enumerate(rows)], schema)
    items = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(str(items))
    seen, want = docs, rows
    key = lambda rs: sorted(((r[0], r[1]) for r in rs), key=str)
    want = [
        [r for r in rows if r[1]],
        [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), rows[8], rows[9]],
        [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), rows[8], (6, texts[4] + "\n\n")],
        [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (5, texts[3] + " [assign]"), (6, texts[4] + "\n\n")],
    ]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        seen = written(stage(spark, seen, str(tmp_path)), name)
        assert seen.columns == docs.columns
        got = seen.collect()
        assert key(got) == key(expected), name
        assert all(tuple(r)[5:] == tuple(extra) for r in got)
    ids = corpus_pipeline.STAGES[4][1](spark, seen, str(tmp_path)).collect()
    assert len(ids) == 6 and all(r.n_tokens == len(r.ids) > 0 for r in ids)
    for _, stage in corpus_pipeline.STAGES:  # an empty table gives an empty table
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
