"""Pacing of requests and pages as a data source."""

import time

import pytest

from pagelore.config import CrawlConfig
from pagelore.sources.fetch import COLUMNS, Pace, PageSource, fetch_from_table, fetch_over_http


class FakeClock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def wait(self, seconds):
        self.now += seconds


def given_out(pause, urls, first=0.0, batches=1):
    clock = FakeClock()
    pace = Pace(pause, first, clock, clock.wait)
    size = -(-len(urls) // batches)
    return [(round(clock.now, 6), u) for k in range(batches) for u in pace.order(urls[k * size : (k + 1) * size])]


def test_hosts_are_asked_in_turn():
    urls = ["http://a/1", "http://a/2", "http://a/3", "http://b/1", "http://B/2", "http://c/1"]
    assert given_out(10, urls) == [
        (0, "http://a/1"), (0, "http://b/1"), (0, "http://c/1"), (10, "http://a/2"), (10, "http://B/2"), (20, "http://a/3"),
    ]
    assert given_out(0, urls) == [(0, u) for u in urls]
    assert given_out(5, []) == []
    # What cannot be split has no host; such URLs wait for each other.
    assert given_out(5, ["http://[x", "", "http://a/"]) == [(0, "http://[x"), (0, "http://a/"), (5, "")]


def test_the_pause_holds_across_batches_and_from_the_start():
    urls = ["http://a/1", "http://a/2", "http://b/1", "http://a/3"]
    assert given_out(10, urls, first=3, batches=2) == [(3, "http://a/1"), (13, "http://a/2"), (13, "http://b/1"), (23, "http://a/3")]
    for batches in (1, 2, 4):
        times = [t for t, u in given_out(7, urls, batches=batches) if u.startswith("http://a/")]
        assert all(b - a >= 7 for a, b in zip(times, times[1:]))


def source(get):
    return type("FakePages", (PageSource,), {"get": staticmethod(get)})


def test_pages_are_a_data_source(spark):
    def get(url, headers, timeout):
        if url.endswith("boom"):
            raise OSError("no route")
        sent = ",".join(f"{k}={v}" for k, v in sorted(headers.items()))
        return {"final_url": url + "#", "html": f"{sent} {timeout}", "body": b"\xff\x00", "status_code": 200,
                "encoding": "utf-8", "content_type": "text/html"}

    spark.dataSource.register(source(get))
    urls = [f"https://h{i % 3}.example/{i}" for i in range(9)] + ["https://h0.example/boom", "", "https://h0.example/0"]
    read = spark.read.format("pages").option("urls", "\n".join(urls)).option("header.X-Token", "t").option("delay", 0).option("timeout", 2)
    df = read.option("groups", 2).load()
    assert df.columns == COLUMNS
    assert df.rdd.getNumPartitions() == 2
    rows = {r.url: r for r in df.collect()}
    assert set(rows) == {u for u in urls if u} and df.count() == 10
    assert rows["https://h0.example/boom"].error == "OSError: no route" and rows["https://h0.example/boom"].html is None
    good = rows["https://h1.example/1"]
    assert good.final_url.endswith("#") and bytes(good.body) == b"\xff\x00" and good.error is None
    assert "X-Token=t" in good.html and "User-Agent=" in good.html and good.html.endswith(" 2.0")


def test_one_task_asks_all_pages_of_a_host():
    urls = [f"https://h{i}.example/{k}" for i in range(7) for k in range(i + 1)]
    reader = PageSource({"urls": "\n".join(urls), "groups": "3"}).reader(None)
    groups = [p.urls for p in reader.partitions()]
    assert sorted(u for g in groups for u in g) == sorted(urls)
    hosts = [{u.split("/")[2] for u in g} for g in groups]
    assert sum(map(len, hosts)) == 7 == len(set().union(*hosts))
    assert max(map(len, groups)) - min(map(len, groups)) <= 2
    assert len(PageSource({"urls": "https://a/", "groups": "3"}).reader(None).partitions()) == 1


@pytest.mark.parametrize("options", [{}, {"urls": " \n"}, {"urls": "u", "groups": "0"}, {"urls": "u", "delay": "-1"}, {"urls": "u", "timeout": "0"}])
def test_wrong_options_are_named(options):
    with pytest.raises(ValueError):
        PageSource(options).reader(None)


def test_requests_of_a_host_keep_their_distance(spark):
    def get(url, headers, timeout):
        return {"final_url": url, "html": str(time.time()), "status_code": 200}

    urls = spark.createDataFrame([(f"https://h{i % 2}.example/{i}",) for i in range(12)], "url string")
    cfg = CrawlConfig(canonical_host="h0.example", delay_seconds=0.4, fetch_parallelism=2)
    rows = fetch_over_http(urls, cfg, get).collect()
    assert len(rows) == 12 and not any(r.error for r in rows)
    for host in ("h0", "h1"):
        times = sorted(float(r.html) for r in rows if f"//{host}." in r.url)
        # In all one request per delay: n requests take at least about n - 2 delays.
        assert times[-1] - times[0] >= 0.4 * (len(times) - 3)


def test_stored_pages_that_are_not_asked_for_are_not_shuffled(spark):
    """Pages meet a small frontier before they are compared; repeated and absent URLs answer as before."""
    cfg = CrawlConfig(canonical_host="kb.example.org", bare_host="example.org", max_pages=None)
    host = cfg.canonical_host
    rows = [(f"https://{host}/p/{i % 40}" + "/" * (i // 40), f"html {i}") for i in range(80)]
    pages = spark.createDataFrame(rows, "url string, html string")
    asked = spark.createDataFrame([(f"https://{host}/p/{i}",) for i in (3, 3, 7, 99)], "url string")
    got = fetch_from_table(asked, pages, cfg)
    found = sorted((r.url.rsplit("/", 1)[1], r.html, r.status_code) for r in got.collect())
    assert found == [("3", "html 3", 200)] * 2 + [("7", "html 7", 200), ("99", None, 404)]
    assert "Join LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
