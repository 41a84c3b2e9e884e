from __future__ import annotations

import time
from itertools import product

import numpy as np
import pytest

from meterline.llm import html_main as h
from meterline.llm import warc
from meterline.llm.dom import joined, parse


@pytest.fixture(scope="module")
def model():
    return h.train()


def text(html: str) -> str:
    page = parse(html)
    return joined(page, [i for i, t in enumerate(page.tag) if not t])


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a<p>b", "a\n\nb"), ("<p>a <b>b\n c</b>&amp;d</p>", "a b c&d"), ("a<br>b", "a b"), ("<ul><li>x<li>y</ul>", "x\n\ny"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<script>var t='</p>';</script>x", "x"), ("x<!-- y --><style>z</style>", "x"), ("<p><b>a<p>b</b>c", "a\n\nbc"), ("</div>a</p>", "a"), ("<a href='x>y'>t</a>", "t"), ("<a href=\"x>t</a>", "t"),
        ("", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<!-- never closed", ""), ("<p>&nbsp;a&#33;</p>", "a!"), ("<title>t</title>x", "x"), ("<textarea>q</textarea>x", "x"), ("<b" * 2000, ""),
    ],
)
def test_blocks_of_markup(html, expected):
    assert text(html).replace("<b" * 2000, "") == expected


def test_marginals_equal_enumeration():
    page = parse("<div class=nav><a>x</a></div><p>y <i>z</i></p>")
    forest = h.Forest([page])
    random = np.random.default_rng(0)
    weight, pair = random.normal(size=len(h.NAMES)), random.normal(size=(h.KINDS, 2, 2))
    n = len(page.parent)
    unary = np.bincount(forest.rows, weight[forest.columns], n)
    total, single = 0.0, np.zeros((n, 2))
    for s in product((0, 1), repeat=n):
        p = np.exp(sum(unary[i] * s[i] for i in range(n)) + sum(pair[forest.kind[i], s[page.parent[i]], s[i]] for i in range(1, n)))
        total += p
        single[np.arange(n), list(s)] += p
    assert np.allclose(forest.marginals(weight, pair)[0], single / total)


def test_unseen_labelled_pages(model):
    random = np.random.default_rng(1000)
    pages = [parse(h.labelled_page(random)) for _ in range(200)]
    q = h.Forest(pages).marginals(*model)[0][:, 1]
    label = np.concatenate([h.truth(p) for p in pages])
    is_text = np.array([not t for p in pages for t in p.tag])
    assert ((q >= 0.5) == label)[is_text].mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>x()</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies. Please agree.</div><main><article><h1>The title</h1><p>First   paragraph with <a href=/x>a link</a> &amp; more text.</p><div class="ad">Buy this now. It is good.</div>
<p>Second paragraph.<br>With a break.</p><form><label>Name</label><input></form></article><section class="comments"><h3>Comments</h3><p>I liked this article. It is true.</p></section></main>
<aside class="sidebar"><p>Other things you may read. Many of them.</p></aside><footer>&copy; Site. All rights reserved.</footer></body></html>"""


def test_main_text_of_a_page(model):
    assert h.main_texts([PAGE, ""], model) == ["The title\n\nFirst paragraph with a link & more text.\n\nSecond paragraph. With a break.", ""]


PROSE = "The committee met for three days in spring. It heard a dozen witnesses, and wrote down what they said."


@pytest.mark.parametrize("name", ["comment-on-policy", "promotion-history", "alert-systems", "footer-design-basics", "cookieRecipes", "history_of_advertisement", "menu-planning", "social-theory", "related-rates"])
@pytest.mark.parametrize("html", ["<article><h1>Title here</h1><p>{p}</p><section class='{n}'><p>{p}</p></section><p>{p}</p></article>", "<div id='{n}'><p>{p}</p><p>{p}</p></div>", "<body><nav><a href=/>Home</a></nav><main><div class='{n}'>{p}</div><p>{p}</p></main><footer>Old Firm</footer></body>"])
def test_words_of_parts_may_name_what_a_text_is_about(model, html, name):
    (got,) = h.main_texts([html.format(n=name, p=PROSE)], model)
    assert got.count(PROSE) == html.count("{p}") and "Home" not in got and "Old Firm" not in got


@pytest.mark.parametrize("name", ["comments", "comment-list", "site-footer", "cookie-notice", "ad-slot", "js-ad-container", "newsletter-box", "left-sidebar", "related-posts", "promo_2", "topAdvert"])
def test_whole_names_of_parts_still_count(model, name):
    (got,) = h.main_texts([f"<article><h1>Title here</h1><p>{PROSE}</p><div class='{name}'><p>Another text that is long enough. It isn't part of it.</p></div><p>{PROSE}</p></article>"], model)
    assert got.count(PROSE) == 2 and "Another" not in got


def test_odd_pages(spark):
    rows = [(1, "http://a", PAGE), (1, "http://a", PAGE), (2, None, None), (None, "http://b", ""), (3, "http://c", "plain " * 20000), (4, "http://d", "<div>" * 3000 + "deep text here. It is.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars", "'x' as record_id", "'y' as block")
    got = h.main_text(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, None)} == {""}
    assert h.main_text(pages.limit(0)).count() == 0
    derived = warc.derive(warc.responses(pages))
    assert derived.count() == 12 and warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_every_page_of_the_table_has_its_article(spark, data):
    import re
    from html import unescape

    for r in h.main_text(spark.read.parquet(f"{data}/pages.parquet")).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y\n", "<title>T</title><p>one<p>two <a href='/b'>l</a>"), (2, None, None), (3, "http://c", "a\r\n\r\nWARC/1.1\r\n\r\nb")]
    responses = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    records = responses.unionByName(warc.derive(responses))
    warc.write(records, str(tmp_path / "out"))
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df.drop("page_id").collect())
    again = warc.read(spark, str(tmp_path / "out"))
    assert plain(again) == plain(records)
    assert plain(warc.derive(again)) == plain(warc.derive(responses))  # from files as from the table


def test_warc_files_are_cut_at_records_and_indexed(spark, tmp_path, data):
    import gzip
    import zlib

    pages = spark.read.parquet(f"{data}/pages.parquet")
    records = warc.responses(pages).unionByName(warc.derive(warc.responses(pages)))
    folder = str(tmp_path / "out")
    warc.write(records.coalesce(1), folder)
    whole = {r.record_id: r.block for r in records.collect()}
    (file,) = (tmp_path / "out").glob("part-*")
    assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\nWARC-Type: ") == len(whole)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(file.stat().st_size // 7, 1)))
    try:
        read, places = warc.read(spark, folder), warc.index(spark, folder)
        assert read.rdd.getNumPartitions() >= 7
        assert {r.record_id: r.block for r in read.collect()} == whole and read.count() == records.count()
        found = places.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert {r.record_id for r in found} == set(whole) and {r.file.split("/")[-1] for r in found} == {file.name}
    with file.open("rb") as f:
        for r in found[::17]:
            f.seek(r.place)
            unzip = zlib.decompressobj(31)
            text = (unzip.decompress(f.read(r.length)) + unzip.flush()).decode()
            assert unzip.eof and not unzip.unused_data and r.record_id in text
            assert text.split("\r\n\r\n", 1)[1].removesuffix("\r\n\r\n") == whole[r.record_id]


@pytest.mark.parametrize("form", ["members", "one", "plain"])
def test_warc_files_of_others(spark, tmp_path, form):
    import gzip

    def record(name: bytes, block: bytes, *more: bytes) -> bytes:
        return b"\r\n".join([b"WARC/1.0", b"warc-type: response", b"WARC-Record-ID: <" + name + b">", *more, b"", block]) + b"\r\n\r\n"

    length = lambda b: b"content-length: %d" % len(b)
    nested = record(b"x", b"in", length(b"in")) + record(b"y", b"", length(b""))  # a block that holds records
    blocks = {b"a": b"", b"b": nested, b"c": b"\xff\r\n\r\n", b"d": b"long " * 50_000}
    parts = [record(n, b, length(b), b"WARC-Target-URI: http://h/\r\n  folded") for n, b in blocks.items()]
    parts.append(record(b"e", b"no length"))
    parts.append(record(b"f", b"cut", b"Content-Length: 100")[:-4])
    (tmp_path / "in").mkdir()
    for i in range(3):
        data = b"".join(map(gzip.compress, parts)) if form == "members" else gzip.compress(b"".join(parts)) if form == "one" else b"".join(parts)
        (tmp_path / "in" / f"{i}.warc{'' if form == 'plain' else '.gz'}").write_bytes(data)
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    got = sorted((r.record_id, r.block, r.target_uri) for r in warc.read(spark, str(tmp_path / "in")).collect())
    blocks |= {b"e": b"no length", b"f": b"cut"}
    want = [(f"<{n.decode()}>", b.decode("utf-8", "replace"), "http://h/ folded" if n in b"abcd" else None) for n, b in blocks.items()]
    assert got == sorted(want * 3, key=lambda x: x[0])


def test_warc_of_no_records(spark, tmp_path):
    records = warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))
    warc.write(records, str(tmp_path / "out"))
    assert warc.read(spark, str(tmp_path / "out")).count() == 0 and warc.index(spark, str(tmp_path / "out")).count() == 0


def test_warc_links_and_digests(spark):
    import base64
    import hashlib
    import json

    response = warc.responses(spark.createDataFrame([(1, "http://a/p", "<title>T</title><p>one<p>two <a href='/b'>l</a>")], "page_id long, url string, html string"))
    source = response.first()
    by = {r.record_type: r for r in warc.derive(response).collect()}
    assert {r.refers_to for r in by.values()} == {source.record_id} and {r.source_digest for r in by.values()} == {source.payload_digest}
    assert all(r.payload_digest == r.block_digest == warc.digest(r.block.encode()) for r in by.values())
    assert by["conversion"].block == "one\n\ntwo l"
    assert by["conversion"].block_digest == "sha1:" + base64.b32encode(hashlib.sha1(b"one\n\ntwo l").digest()).decode()
    meta = json.loads(by["metadata"].block)
    assert meta["links"] == [{"element": "a", "url": "http://a/b"}] and meta["title"] == "T" and meta["http-headers"]["Content-Type"].startswith("text/html")
    assert len({source.record_id, *(r.record_id for r in by.values())}) == 3


def test_iframes_are_links():
    page = parse("<p>a<iframe src='/x'><a href='/raw'>no</a></iframe>b<a href='y'>c</a>")
    assert warc.outlinks(page, "http://h/") == [{"element": "iframe", "url": "http://h/x"}, {"element": "a", "url": "http://h/y"}]
    assert "no" not in "".join(page.text)


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<a b " * 100_000, "<a b " * 100_000 + ">", "<b>" * 1000 + "<table>" + "<i></b>" * 50_000, '<a "> "' * 100_000, "<p><b>" * 50_000, "</u>" * 100_000, "<script></script " * 50_000, "<!-- <!--" * 50_000, "<a b='" * 100_000],
    ids=["nested", "closed", "unclosed", "late", "scoped", "quotes", "paragraphs", "ends", "raw", "comments", "apostrophes"],
)
def test_deep_and_broken_pages_take_linear_time(html, model):
    began = time.perf_counter()
    h.main_texts([html], model)
    assert time.perf_counter() - began < 10


def test_quotes_that_never_close_are_plain_after_some():
    assert text('<a "> "' * 20).count('"') >= 19
    assert text("<a t='x>y'>u</a>" * 50) == "u" * 50
