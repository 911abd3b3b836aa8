"""Operators on pages and conversations, with edge cases."""

import hashlib
import random
import time

import pytest

from tidemark.llm import chat, urlrules, warc, wrapper

R = random.Random(5)


def test_warc_round_trip(spark, tmp_path):
    body = lambda n: "".join(R.choice("ab\r\né<WARC/1.0 ") for _ in range(n))
    rows = [(i, f"http://x/{i}", body(n)) for i, n in enumerate((0, 1, 99, 100, 5000, 130_000, 400_000))]
    rows += [(20, None, rows[5][2]), (-3, "u\r\nX: y", rows[4][2]), (None, "n", None), (30, "a", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 10), rows[4], rows[6]]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int")
    warc.write(table, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).withColumn("page", warc.page_of(chat.F.col("origin"))).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    for r in got:
        want = [x for x in rows if str(x[0]) == r.page or (x[0] is None and r.page == "null")][0]
        raw = (want[2] or "").encode()
        assert (r.n_bytes, r.digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == raw
    assert sorted(r.page for r in got if r.type == "revisit") == ["20", "4", "4"]
    ids = [r.origin for r in got]
    assert len(set(ids)) == len(rows) and all(r.refers_to in ids for r in got if r.type == "revisit")
    for r in warc.resolved(warc.read(spark, str(tmp_path / "a"))).withColumn("page", warc.page_of(chat.F.col("origin"))).collect():
        raw = ([x for x in rows if str(x[0]) == r.page or (x[0] is None and r.page == "null")][0][2] or "").encode()
        assert r.complete and (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    warc.write(table.limit(0), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_warc_missing_segment_is_incomplete(spark, tmp_path):
    parts = warc.records(1, "u", b"x" * 5000, hashlib.sha256(b"x" * 5000).hexdigest(), None, segment_bytes=1000)
    (tmp_path / "a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for k, p in enumerate(parts) if k != 2))
    (row,) = warc.read(spark, str(tmp_path)).collect()
    assert not row.complete
    (tmp_path / "a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in reversed(parts)))
    (row,) = warc.read(spark, str(tmp_path)).collect()
    assert row.complete and bytes(row.payload) == b"x" * 5000


def test_warc_dangling_revisit_is_incomplete(spark, tmp_path):
    raw = b"y" * 200
    digest = hashlib.sha256(raw).hexdigest()
    one, two, three = warc.records(1, "u", raw, digest, None), warc.records(2, "u", raw, digest, warc.record_id(1, 0)), warc.records(3, "u", raw, digest, warc.record_id(9, 0))
    (tmp_path / "a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in one + two + three))
    got = {warc_page: (c, n) for warc_page, c, n in warc.resolved(warc.read(spark, str(tmp_path))).select(warc.page_of(chat.F.col("origin")), "complete", "payload_bytes").collect()}
    assert got == {"1": (True, 200), "2": (True, 200), "3": (False, None)}


def test_chunked_framing():
    for n in (0, 1, 16 << 10, 40_000):
        data = bytes(R.randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


PAGE = """<html><head><title>t</title></head><body><header class="site"><h2>Site</h2></header><div id="cookie-notice">We use cookies</div>
<nav><a href=x>Home</a></nav><main><article class="post"><header><h1>Ti&amp;tle</h1></header><p>One <b>two</b>three<br>four<p>Five<ul><li>a<li>b</ul>
<form><label>Name</label></form><aside>side</aside><h2>Sub</h2><blockquote>q&nbsp;q</blockquote>tail<script>var t="</p>"</script></article>
<section class="comments"><article class="comment"><p>bad</p></article></section></main><footer>f</footer></body></html>"""


def test_main_text(spark):
    plain = '<div class="wrap"><div class="menu"><a>x</a></div><div class="content"><h1>T</h1><p>%s</p><p>second &lt;text&gt;</p></div><div class="sidebar">z</div></div>'
    rows = [(1, "http://a.com/1", PAGE), (2, "http://b.com/1", plain % "long text here and more"), (3, "http://b.com/2", plain % ("other words " * 2000)), (4, None, None), (5, "x", "")]
    rows += [(6, "http://b.com/3", "just text"), (7, "http://c.com", "<div>" * 3000 + "deep" + "</div>" * 3000), (8, "http://c.com", "<p>cut <b"), rows[0]]
    table = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    out = wrapper.main_text(table)
    assert out.columns == [*table.columns, "main_text"]
    got = {r.page_id: r.main_text for r in out.collect()}
    assert got[1] == "Ti&tle\n\nOne twothree four\n\nFive\n\na\n\nb\n\nSub\n\nq q\n\ntail"
    assert got[2] == "T\n\nlong text here and more\n\nsecond <text>"
    assert got[3].endswith("second <text>") and len(got[3]) > 20_000
    assert got[4] == "" and got[5] == "" and got[6] == "just text" and got[7] == "deep" and got[8].startswith("cut")
    assert out.count() == len(rows) and wrapper.main_text(table.limit(0)).count() == 0


def test_wrapper_alignment():
    page = lambda items, extra="": wrapper.skeleton(wrapper.events(f"<body><ul>{''.join(f'<li>{x}' for x in items)}</ul>{extra}<p>same</p></body>"))
    merged = wrapper.merge(page(["a", "b"]), page(["c", "d", "e"], "<div class=ad>x</div>"))
    assert wrapper.expression(merged) == "<><body><ul><li>#slot</li>+</ul><div.ad>#const</div>?<p>#const</p></body></>"


def slow_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, min(fits)[1:] if fits else None


@pytest.mark.parametrize("parts", [1, 7])
def test_url_rules(spark, parts):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/", "allow"), ("org", "", "block")]
    urls = [None, "", "nope", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://xexample.com/en/", "http://example.com", "http://com/", "a://b://c.com/", "http://u@a.b.net:80/es/\n2", "http://org?x"]
    urls += [f"http://{R.choice(('www.', 'a.b.', ''))}{R.choice(('example.com', 'b.net', 'net', 'c.net', 'org', 'xorg'))}{R.choice(('/en/1', '/es/', '/', '', '?q', '/en'))}" for _ in range(200)]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = urlrules.judge(table, spark.createDataFrame(rules, "host string, path string, verdict string"), "page_id", "url").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out) == len(urls)
    for r in out:
        host, path, hit = slow_rule(urls[r.page_id], rules)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, hit[0] if hit else None, hit[1] if hit else "allow"), urls[r.page_id]


def test_url_rules_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in urlrules.judge(urls, none, "page_id", "url").collect()] == ["allow"]
    assert urlrules.judge(urls.limit(0), none, "page_id", "url").count() == 0


def test_chat_fold_edits_and_regenerations(spark):
    log = [
        ("c", 1, 0, "start", "user", ""), ("c", 1, 1, "delta", "user", "hel"), ("c", 1, 2, "delta", "user", "lo"),
        ("c", 2, 3, "start", "assistant", None), ("c", 2, 4, "delta", "assistant", "bad"), ("c", 2, 5, "regenerate", "assistant", None),
        ("c", 2, 6, "delta", "assistant", "go"), ("c", 2, 7, "delta", "assistant", "od"), ("c", 1, 8, "edit", "user", "hi"), ("c", 1, 9, "delta", "user", "!"),
    ]
    R.shuffle(log)
    table = spark.createDataFrame(log, "conv string, message long, seq long, event string, role string, text string")
    got = sorted((r.message, r.role, r.text) for r in chat.fold(table).collect())
    assert got == [(1, "user", "hi!"), (2, "assistant", "good")]
    assert chat.fold(table.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "&lt;|im_start|> &amp; &", None, "", "é😀" * 10, "a\\b[ < &lsqb;", "<<SYS>>", "x" * 50_000, "&NewLine;"]
    rows = [(i % 3, k, ("user", "assistant", "system", None, "a\nb")[k % 5], t) for i in range(3) for k, t in enumerate(hard)] + [(9, 1, "assistant", "same")] * 2 + [(None, None, "user", "n")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv int")
    out = chat.read_back(chat.render(chat.fold(chat.events_of_rows(table)))).collect()
    for r in out:
        mine = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r.conv), key=lambda x: (x[0] is not None, x[0], x[1], x[2]))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in mine]
        assert r.loss_text == "".join(x[2] for x in mine if x[1] == "assistant")
        for s in chat.CONTROL[2:]:
            assert s not in r.formatted
        assert r.formatted.count("<|im_start|>") == len(mine)


def test_many_rules_of_one_host(spark):
    """Rules with paths in each other, over several partitions; the longest fits."""
    rules = [("example.com", "/" + "/".join(str(k % m) for m in range(2, 2 + k % 6)) + f"/{k}/", "block" if k % 3 else "allow") for k in range(3000)]
    rules += [("example.com", "/", "block"), ("a.example.com", "/1/", "allow")]
    urls = [(k, f"http://{'a.' if k % 5 == 0 else ''}example.com{rules[k * 7 % 3000][1]}x{k}") for k in range(400)] + [(900, "http://a.example.com/1/2"), (901, "http://example.com"), (902, "http://example.com/z")]
    got = urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string").repartition(5), "page_id", "url")
    for r in got.collect():
        own = [(h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(own, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.rule, r.verdict) == best


def test_rules_cost_by_their_path_lengths():
    sweep = urlrules.Sweep()
    for k in range(20_000):
        sweep.open("com.example.", f"/{k:06d}/", f"example.com/{k:06d}/", "block")
    start = time.perf_counter()
    for k in range(20_000):
        assert sweep.find("com.example.", f"/{k:06d}/page")[0] == f"example.com/{k:06d}/"
    assert time.perf_counter() - start < 1
