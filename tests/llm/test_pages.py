"""Operators 2 and 9."""

import base64
import hashlib

import pytest

from reelspark.llm import html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><!-- x --><div class="ad top">Buy {n}</div>
<article><h1>Title {n} &amp; more</h1><p>Share this page<p>First  <b>bold</b>&nbsp;text&#33; {n}<br>next<p>Second {n} &lt;b&gt;<form>Name <input></form>
<aside>side {n}</aside><ul><li>one {n}<li>two {n}</ul><section class="comments"><p>reader {n}</p></section></article>
<div id="cookie-notice">Cookies {n}</div><footer>&copy; {n}</footer></body></html>"""


def expected(n, template):
    lines = [f"Title {n} & more", "Share this page", f"First bold text! {n} next", f"Second {n} <b>", f"one {n}", f"two {n}"]
    return "\n".join(x for x in lines if not (template and x.startswith("Share")))


def test_main_text_by_markup():
    assert html_text.main_text(PAGE.format(n=7), None) == expected(7, False)
    assert html_text.main_text("", None) == "" and html_text.main_text(None, None) == ""
    assert html_text.main_text("plain &amp; bare", None) == "plain & bare"
    assert html_text.main_text("<p>a<p>b<div>c</div>d", None) == "a\nb\nc\nd"
    assert html_text.main_text("<body><p>x<script>if (a<b) {}", None) == "x"
    assert html_text.main_text("<div>" * 3000 + "deep", None) == "deep"
    assert html_text.main_text("<p>" + "word " * 50_000 + "</p>", None).count(" ") == 49_999


def test_wrapper_finds_template_and_content():
    w = html_text.induce([PAGE.format(n=i) for i in range(5)])
    assert [t for _, t in w["template"] if "Share" in t] == ["Share this page"]
    assert w["content"].endswith("/article")
    assert html_text.main_text(PAGE.format(n=99), w) == expected(99, True)
    # without an article element the place of the varying text is the content
    plain = "<html><body><div class='top'>Site</div><div class='x'>Links</div><div class='c'><p>long text {n} here and there</p><p>b {n}</p></div></body></html>"
    w = html_text.induce([plain.format(n=i) for i in range(5)])
    assert w["content"].endswith("/div.c")
    assert html_text.main_text(plain.format(n=9), w) == "long text 9 here and there\nb 9"


def test_simple_tree_matching():
    a = html_text.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>")
    b = html_text.parse("<div><ul><li>y</li><li>z</li></ul><p>2</p></div>")
    assert html_text.align(a, b)[0] == 1 + 1 + 2 + 1  # root, div, list with one item, one paragraph


def test_extract(spark):
    rows = [(i, f"http://hot.example/{i}", PAGE.format(n=i), "x") for i in range(40)]
    rows += [(100, "http://one.example/", PAGE.format(n=100), "x"), (101, None, PAGE.format(n=101), "x"),
             (102, "http://hot.example/e", None, "x"), (103, "http://hot.example/f", "", "x"), (None, "bad url", "<p>q", "x"),
             (5, "http://hot.example/5", PAGE.format(n=5), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()]
    assert len(got) == len(rows)
    by = {p: t for p, _, t, _ in got}
    assert by[3] == expected(3, True) and by[100] == expected(100, False) and by[101] == expected(101, False)
    assert by[102] == by[103] == "" and by[None] == "q"
    assert all(n == len(t) for *_, t, n in got)
    assert html_text.extract(pages.limit(0)).collect() == []


def b32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_archive_round_trip(spark, tmp_path):
    same = "copy" * 10
    split = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3
    htmls = {1: "<p>é 你好 🙂</p>", 2: same, 3: None, 4: "", 5: same, 6: split, 7: "ü" * 5000, 8: same, 9: "\r\n\r\n", 10: "a\r\n\r\nWARC/1"}
    rows = [(k, f"http://h/\r\n{k}" if k == 1 else f"http://h/{k}", v, 1) for k, v in htmls.items()] + [(None, None, "null id", 1), (7, "u", "ü" * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = str(tmp_path / "warc")
    warc.write(pages, path, chunk_bytes=64)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok)
                 for r in warc.read(spark, path).collect())
    first = {}
    want = []
    for p, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (h or "").encode()
        f = first.setdefault(b, p)
        revisit = p is not None and f is not None and p > f
        want.append((p or 0, len(b), b32(b), "revisit" if revisit else "response", f if revisit else None, None if revisit else True))
    assert got == sorted(want, key=lambda x: x[:4]) or sorted(map(str, got)) == sorted(map(str, want))
    # chunk rows: none is larger than asked for, and together they are the payload
    chunks = [c for c in warc.read_chunks(spark, path).collect() if c.page_id == 6]
    assert max(len(c.chunk) for c in chunks) <= 64
    assert b"".join(bytes(c.chunk) for c in sorted(chunks, key=lambda c: c.chunk_no)) == split.encode()


def test_payloads_around_the_separator(spark, tmp_path):
    """The version string at the start, the end, across and right at chunk borders; behind blank lines of all kinds."""
    sep = "\r\n\r\nWARC/1.1"
    texts = ["WARC/1.1 is the format", "z" * 64 + "WARC/1.1 tail", "a" + sep, sep, sep * 5, "WARC/1.1" * 40, "WARC/1.WARC/1.1\r\n\r\n",
             "\r\n\r\n" * 30 + "WARC/1.1", "WARC/1", "\r\n", "\n\r\n\r\nWARC/1.1x", "WARC-Type: response\r\n" * 9]
    texts += ["y" * k + sep + " behind" for k in range(40, 80)] + ["y" * k + "WARC/1.1" + "\r\n\r\n" * 8 for k in range(50, 70)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(5)
    path = str(tmp_path / "sep")
    warc.write(pages, path, chunk_bytes=64)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.digest_ok) for r in warc.read(spark, path).collect()}
    assert got == {i: (len(t.encode()), b32(t.encode()), True) for i, t in enumerate(texts)}
    parts = {}
    for c in warc.read_chunks(spark, path).collect():
        parts.setdefault(c.page_id, {})[c.chunk_no] = bytes(c.chunk)
    assert {i: b"".join(p[k] for k in sorted(p)).decode() for i, p in parts.items()} == dict(enumerate(texts))


@pytest.mark.parametrize("chunk_bytes", [64, 65_536])
def test_a_damaged_record_raises(spark, tmp_path, chunk_bytes):
    pages = spark.createDataFrame([(1, "u", "intact"), (2, "u", "q" * 300)], "page_id long, url string, html string")
    path = tmp_path / "damaged"
    warc.write(pages.coalesce(1), str(path), chunk_bytes=chunk_bytes)
    for p in path.glob("part-*"):
        p.write_bytes(p.read_bytes().replace(b"qqq", b"qxq", 1))
    for p in path.glob(".*.crc"):
        p.unlink()
    with pytest.raises(Exception, match="page 2 does not have its declared digest"):
        warc.read(spark, str(path)).collect()
    assert {r.page_id: r.digest_ok for r in warc.read(spark, str(path), verify=False).collect()} == {1: True, 2: False}


def test_empty_archive_and_small_payloads(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).collect() == []
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "b"), revisit_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "b")).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_the_wrapper_counts_every_page_of_a_host(spark):
    """Two layouts on one host, a box on some pages, a page without it and a page of over 600 elements: all count."""
    box = "<div class='x9'><p>Read all about it</p></div>"
    one = "<html><body>{box}<div class='c'><p>story {n} in a long line of words</p><p>Ask the editor</p></div></body></html>"
    two = "<html><body><div class='t'>Links</div><div class='d'><p>tale {n} told in a long line</p><p>Write to us</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", one.format(n=i, box=box if i % 3 else "")) for i in range(60)]
    rows += [(100 + i, f"http://h.example/{100 + i}", two.format(n=i)) for i in range(40)]
    rows += [(200, "http://h.example/200", one.format(n=200, box=box) .replace("<p>Ask", "<p>more</p>" * 700 + "<p>Ask"))]
    rows += [(300 + i, f"http://copy.example/{i}", one.format(n=1, box="")) for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all("Read all" not in t and "Ask the" not in t and "Write to" not in t for p, t in got.items() if p < 300)
    assert got[7] == "story 7 in a long line of words" and got[105].splitlines()[-1] == "tale 5 told in a long line"
    assert got[200].count("more") == 700
    assert got[300] == "story 1 in a long line of words\nAsk the editor"  # copies are one page, which has no template


def test_every_distinct_page_and_text_is_counted(spark, monkeypatch):
    """Pages that share a hash are two pages; a text of one page has its count as well."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(1).cast("long"))
    rows = [("h", f"<body><p>same</p><div>page {i % 5}</div></body>") for i in range(15)] + [("", "<p>x"), ("h", ""), ("h", None)]
    pages = spark.createDataFrame(rows, "host string, html string")
    got = {(r.path, r.hash): r.n for r in html_text.page_counts(pages).collect()}
    assert got["", ""] == 5
    assert got["/body/p", html_text.text_hash("same")] == 5
    assert all(got["/body/div", html_text.text_hash(f"page {i}")] == 1 for i in range(5))
