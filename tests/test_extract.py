"""Extraction on hand-written pages and crawling against a queue model."""

import random
from collections import deque
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagelore.config import CrawlConfig
from pagelore.operators.extract import extract_pages, is_html_response
from pagelore.operators.frontier import crawl, crawl_lists, crawl_metadata, latest_documents, walk_links
from pagelore.sources import tables
from pagelore.sources.fetch import fetch_from_table, fetch_over_http
from pagelore.sources.html_nodes import html_nodes


@pytest.fixture(scope="module")
def extract(spark):
    def run(*pages):
        rows = [(i, p if isinstance(p, tuple) else ("https://h.example/a/b", p)) for i, p in enumerate(pages)]
        df = spark.createDataFrame([(i, u, h) for i, (u, h) in rows], "i int, url string, html string")
        return [r.asDict(True) for r in sorted(extract_pages(df).collect(), key=lambda r: r.i)]

    return run


def shape(doc):
    return [(s["heading"], s["level"], s["paragraphs"], s["bullets"]) for s in doc["sections"]]


def test_metadata_and_links(extract):
    head = ('<head><TITLE> A.B &amp; <!-- c --> c </TITLE><meta name="description" content=" d,e "><meta name=description content=x>'
            '<link rel="alternate Canonical" HREF="../x/?q=1#f"></head>')
    body = ('<body><nav><a href="/n/">N <b>av</b></a></nav><a href="#t">t</a><a href="mailto:q">q</a><a href="TEL:1">T</a><a href=" ">e</a>'
            '<a href="/n">again</a><a>none</a><a href=\' c.html?x=1 \'>C<script>s</script></a><a href="//O.example/p/">o</a></body>')
    d, = extract(f"<html>{head}{body}</html>")
    assert (d["title"], d["description"], d["canonical_url"], d["page_type"]) == ("A. B & c", "d, e", "https://h.example/x", "general")
    assert [(k["url"], k["text"]) for k in d["links"]] == [
        ("https://h.example/n", "N av"), ("tel://1", "T"),
        ("https://h.example/a/c.html", "C"), ("https://o.example/p", "o")]


def test_sections(extract):
    d, = extract("""<body><main><p>intro <i>one</i></p><h2>First<br>part</h2><p>para.two</p><p>para.two</p><ul><li>b1</li><li>b2</li><li>b1</li></ul>
      <div>Founder &amp; CEO</div><div class="x"><div>In ner</div><p>deep</p></div><h2> </h2><span>label</span>
      <h3>Contact us</h3><p>gone</p><h2>Last</h2><p>Tell us what you're dealing with.</p></main><p>outside</p></body>""")
    assert shape(d) == [
        ("", 0, ["intro one"], []),
        ("First part", 2, ["para. two", "Founder & CEO", "In ner", "deep", "label"], ["b1", "b2"]),
        ("Last", 2, [], [])]
    assert d["sections"][1]["content"] == "First part\npara. two\nFounder & CEO\nIn ner\ndeep\nlabel\nb1\nb2"
    assert d["content"] == "intro one\n\n" + d["sections"][1]["content"] + "\n\nLast"
    assert d["word_count"] == len(d["content"].split()) and d["sections"][1]["word_count"] == 13
    assert [(h["level"], h["text"]) for h in d["headings"]] == [(2, "First part"), (3, "Contact us"), (2, "Last")]


def test_removed_and_noisy_parts(extract):
    d, e, f = extract(
        '<body><header><p>h</p></header><article class="menu"><p>kept</p><div class="a Site-Nav b"><p>x</p><h1>y</h1></div>'
        '<div class="menu_item"><p>under</p></div><form><p>f</p></form><svg><title>s</title></svg></article></body>',
        '<body><main><article class="footer"><p>inside noise</p></article><p>ok</p></main></body>',
        '<body><main class="navbar"><p>still root</p></main></body>')
    assert shape(d) == [("", 0, ["kept", "under"], [])] and d["headings"] == []
    assert shape(e) == [("", 0, ["ok"], [])]
    assert shape(f) == [("", 0, ["still root"], [])]


def test_unclosed_and_stray_tags(extract):
    d, = extract("<body><article><p>one<p>two</p></b><p>three</article><p>after</body>")
    assert shape(d) == [("", 0, ["one two three", "two", "three"], [])]


def test_labels_have_limits(extract):
    long_words, long_chars = " ".join(["w"] * 13), "c" * 121
    d, = extract(f"<body><div>{long_words}</div><span>{long_chars}</span><span>{'x ' * 12}</span><div><p>a</p>b</div></body>")
    assert shape(d) == [("", 0, [("x " * 12).strip(), "a"], [])]


def test_heading_span_repeats_unless_adjacent(extract):
    d, = extract("<body><h1><span>Big</span></h1><p>x</p></body>")
    assert shape(d) == [("Big", 1, ["Big", "x"], [])]
    assert d["sections"][0]["content"] == "Big\nx"


def test_fallback_and_empty(extract):
    d, e, g = extract("<body><table><tr><td>cell one</td><td>cell.two</td></tr></table><h2>Next step</h2></body>", "plain", "")
    assert d["content"] == "cell one cell. two Next step" and shape(d) == [("", 0, [d["content"]], [])]
    for x in (e, g):
        assert x["sections"] == [] and x["word_count"] == 0 and x["canonical_url"] == "https://h.example/a/b"


def test_content_type(evaluate):
    assert evaluate(is_html_response, ["Text/HTML; charset=x", "application/xhtml+xml", "application/pdf", None]) == [
        True, True, False, False]


HOST = "www.h.example"


def _site(seed, n=40):
    rnd = random.Random(seed)
    pages = {}
    for i in range(n):
        links = [f"/p{rnd.randrange(n + 6)}" + rnd.choice(["", "/", "#x"]) for _ in range(rnd.randint(0, 5))]
        links += rnd.choice([[], ["/pic.jpg"], ["https://other.example/"], ["mailto:x"]])
        thin = rnd.random() < 0.2
        body = " ".join(f"w{i}x{j}" for j in range(5 if thin else 30))
        pages[f"https://{HOST}/p{i}" if i else f"https://{HOST}/"] = (
            "<body><p>" + body + "</p>" + "".join(f'<a href="{k}">k</a>' for k in links) + "</body>", links, thin)
    return pages


def _queue_model(pages, cap):
    queue, visited, saved, failed = deque([f"https://{HOST}/"]), [], [], []
    while queue and len(visited) < cap:
        url = queue.popleft()
        if url in visited:
            continue
        visited.append(url)
        if url not in pages:
            failed.append(url)
            continue
        _, links, thin = pages[url]
        if thin:
            continue
        saved.append(url)
        for k in links:
            if k.startswith("/") and not k.endswith(".jpg"):
                path = k.split("#")[0].rstrip("/") or "/"
                target = f"https://{HOST}{path}"
                if target not in visited and target not in queue:
                    queue.append(target)
    return visited, saved, failed


@pytest.mark.parametrize("seed, cap", [(1, 1000), (2, 9), (6, 17)])
def test_crawl_is_a_capped_queue(spark, seed, cap):
    site = _site(seed)
    pages = spark.createDataFrame([(u, h) for u, (h, _, _) in site.items()], "url string, html string")
    cfg = CrawlConfig(canonical_host=HOST, bare_host="h.example", max_pages=cap)
    result = crawl(spark, lambda front: fetch_from_table(front, pages, cfg), cfg)
    log = result.log.collect()
    visited, saved, failed = _queue_model(site, cap)
    assert [r.url for r in sorted(log, key=lambda r: (r["round"], r.seq))] == visited
    assert {r.url for r in log if r.saved} == set(saved) and {r.url for r in log if r.error} == set(failed)
    assert {r.url for r in result.documents.select("url").collect()} == set(saved)
    meta = crawl_metadata(result.log, cfg, datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 6)).first()
    assert (meta.pages_visited, meta.pages_saved, meta.pages_failed) == (len(visited), len(saved), len(failed))
    assert meta.visited_urls == sorted(visited) and [f.url for f in meta.failed_urls] == failed
    assert meta.started_at == "2024-01-02T03:04:05Z"


def test_fetching_over_http_reports_every_failure(spark):
    def get(url, headers, timeout):
        if url.endswith("boom"):
            raise OSError("no route")
        kind = "application/pdf" if url.endswith("pdf") else "text/html"
        final = "https://elsewhere.example/" if url.endswith("away") else url
        return {"final_url": final, "html": f"<body><p>{'word ' * 25}</p></body>", "status_code": 200, "encoding": "utf-8", "content_type": kind}

    cfg = CrawlConfig(canonical_host=HOST, delay_seconds=0, max_pages=None)
    seeds = spark.createDataFrame([(f"https://{HOST}/{p}",) for p in ("boom", "x.pdf", "away", "good")], "url string")
    result = crawl(spark, lambda front: fetch_over_http(front, cfg, get), cfg, seeds)
    errors = {r.url.rsplit("/", 1)[1]: r.error for r in result.log.collect()}
    assert errors == {"boom": "OSError: no route", "x.pdf": "ValueError: Unsupported content type: application/pdf",
                      "away": "ValueError: Redirected to unsupported URL", "good": None}
    named = latest_documents(result.documents.unionByName(result.documents.withColumn("seq", F.lit(10**9)))).collect()
    assert len(named) == 1 and named[0].file.startswith("good__") and named[0].seq == 10**9


def test_walk_handles_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in walk_links(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert walk_links(edges, seeds, 1).count() == 2


def test_charset_of_a_page():
    from pagelore.sources.fetch import page_charset

    latin = "<meta charset='ISO-8859-1'><p>caf\xe9".encode("latin-1")
    assert latin.decode(page_charset(latin, None)).endswith("caf\xe9")
    assert page_charset(latin, "utf-8") == "utf-8" and page_charset(b"<p>x", None) == "utf-8"
    assert page_charset(b"<p>x", "no-such-charset") == "utf-8" and page_charset(b"\xef\xbb\xbfx", None) == "utf-8-sig"


def test_many_links_take_their_first_anchor(spark):
    import time

    links = "".join(f"<a href='/p{i % 4000}'>t{i}</a>" for i in range(16_000))
    page = spark.createDataFrame([("https://www.h.example/", f"<body>{links}")], "url string, html string")
    start = time.time()
    found = extract_pages(page).first().links
    assert [(k.url.rsplit("/", 1)[1], k.text) for k in found] == [(f"p{i}", f"t{i}") for i in range(4000)]
    assert time.time() - start < 60


def test_received_bytes_are_kept(spark, tmp_path):
    body = "<body><p>caf\u00e9 ".encode("latin-1") + b"word " * 25 + b"</p>\xff\x00</body>"

    def get(url, headers, timeout):
        return {"final_url": url, "html": body.decode("latin-1"), "body": body, "status_code": 200, "encoding": "iso8859-1", "content_type": "text/html"}

    cfg = CrawlConfig(canonical_host=HOST, delay_seconds=0, max_pages=None)
    seeds = spark.createDataFrame([(f"https://{HOST}/{p}",) for p in ("a", "b")], "url string")
    result = crawl(spark, lambda front: fetch_over_http(front, cfg, get), cfg, seeds)
    tables.write_raw_pages(result.pages, str(tmp_path / "html"))
    kept = tables.read_raw_pages(spark, str(tmp_path / "html")).collect()
    assert len(kept) == 2 and {bytes(r.body) for r in kept} == {body}
    # Without bytes, the text as UTF-8.
    tables.write_raw_pages(result.pages.drop("body"), str(tmp_path / "text"))
    assert {bytes(r.body) for r in tables.read_raw_pages(spark, str(tmp_path / "text")).collect()} == {body.decode("latin-1").encode()}


def test_lists_of_an_unlimited_crawl(spark):
    log = spark.createDataFrame(
        [("u/b", "u/b", 0, 1, True, None), ("u/a", "u/b", 0, 0, True, None), ("u/z", None, 1, 0, False, "E: x"), ("u/c", None, 0, 2, False, "E: y")],
        "url string, final_url string, round int, seq long, saved boolean, error string",
    )
    lists = {name: [tuple(r) for r in rows.collect()] for name, rows in crawl_lists(log).items()}
    assert lists == {"visited_urls": [("u/a",), ("u/b",), ("u/c",), ("u/z",)], "saved_urls": [("u/b",)],
                     "failed_urls": [("u/c", "E: y"), ("u/z", "E: x")]}


def test_cdata_is_text(spark):
    page = "<main><svg><text>a<![CDATA[ x < y ]]>b</text></svg></main>"
    nodes = spark.createDataFrame([(page,)], "html string").select(html_nodes(F.col("html")).alias("n")).first().n
    assert [t.text for t in nodes.texts] == ["a", "x < y", "b"]


def test_nodes_of_a_batch_are_held_part_by_part(monkeypatch):
    """Python objects grow with a part of the batch, not with the batch; the nodes stay the same."""
    import tracemalloc

    import pyarrow as pa

    from pagelore.sources import html_nodes as h

    made = []
    monkeypatch.setattr(h.F, "arrow_udf", lambda f, kind: lambda column: made.append(f))
    h.html_nodes(None)
    page = "<title>t</title>" + "<p>a <a href='/x'>b</a></p>" * 40

    def peak(n):
        pages = pa.array([None if i % 97 == 0 else f"{page}<i>{i}</i>" for i in range(n)], pa.string())
        tracemalloc.start()
        nodes = made[0](pages)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(nodes) == n
        return held, nodes

    small, _ = peak(400)
    large, nodes = peak(4000)
    assert large < 2 * small
    assert nodes[97].as_py() is None and nodes[3999].as_py()["texts"][-1] == {"text": "3999", "hidden": False}
    assert len(made[0](pa.array([], pa.string()))) == 0
