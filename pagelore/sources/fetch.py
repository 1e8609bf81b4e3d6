"""Getting pages for a frontier: over HTTP, or from a stored table."""

from __future__ import annotations

import codecs
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagelore.config import CrawlConfig
from pagelore.functions.urls import crawl_url
from pagelore.operators.first_wins import first_per_key

ANSWER = (
    "url string, final_url string, html string, body binary, status_code int, encoding string,"
    " content_type string, error string"
)

#: A transport: URL, headers and timeout to the fields of an answer.
Get = Callable[[str, dict[str, str], float], dict]

# Pages held in memory before they are handed on.
_PAGES_AT_ONCE = 64


_META_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)


def page_charset(body: bytes, told: str | None) -> str:
    """The charset of a page: its byte order mark, else the header's word, else the page's own, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return name
    named = _META_CHARSET.search(body[:4096])
    for name in (told, named and named[1].decode("ascii")):
        try:
            if name:
                return codecs.lookup(name).name
        except LookupError:
            continue
    return "utf-8"


def http_get(url: str, headers: dict[str, str], timeout: float) -> dict:
    """One GET with redirects; raises on an error status."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=timeout) as response:
        body = response.read()
        encoding = page_charset(body, response.headers.get_content_charset())
        return {
            "final_url": response.geturl(),
            "html": body.decode(encoding, errors="replace"),
            "body": body,
            "status_code": response.status,
            "encoding": encoding,
            "content_type": response.headers.get("Content-Type", ""),
        }


COLUMNS = [c.strip().split(" ")[0] for c in ANSWER.split(",")]


class Pace:
    """One request per host and ``pause`` seconds, and other hosts' requests in between.

    A host's first request waits ``first`` seconds, so that tasks which share a host do
    not all begin at once.
    """

    def __init__(self, pause: float, first: float = 0.0, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> None:
        self.pause, self.clock, self.wait = pause, clock, wait
        self.begin = clock() + first
        self.due: dict[str, float] = {}

    def order(self, urls: Iterable[str]) -> Iterator[str]:
        """``urls``, each given out when its host may be asked; those of one host in their order."""
        if self.pause <= 0:
            yield from urls
            return
        queues: dict[str, deque[str]] = {}
        for url in urls:
            queues.setdefault(host_of(url), deque()).append(url)
        turns = [(self.due.get(host, self.begin), host) for host in queues]
        heapify(turns)
        while turns:
            due, host = heappop(turns)
            if due > self.clock():
                self.wait(due - self.clock())
            yield queues[host].popleft()
            self.due[host] = self.clock() + self.pause
            if queues[host]:
                heappush(turns, (self.due[host], host))
        # A host whose pause is over needs no entry.
        now = self.clock()
        self.due = {host: due for host, due in self.due.items() if due > now}
        self.begin = max(self.begin, now)


def host_of(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


def answer(url: str, headers: dict[str, str], timeout: float, get: Get) -> dict:
    """One row of ``ANSWER``; a failure is a row with its error."""
    row = dict.fromkeys(COLUMNS)
    row["url"] = url
    try:
        row.update(get(url, headers, timeout))
    except Exception as exc:  # every failure is data
        row["error"] = f"{type(exc).__name__}: {exc}"
    return row


def fetch_over_http(frontier: DataFrame, cfg: CrawlConfig, get: Get = http_get) -> DataFrame:
    """Answers of all frontier URLs; a failure becomes a row with its error.

    URLs are spread over ``fetch_parallelism`` tasks whatever their host, so one large
    site is not one task. Every task waits that many times the delay between two requests
    to a host and asks other hosts meanwhile: each host sees one request per delay in
    all, and many hosts are asked at once.
    """
    headers = {"User-Agent": cfg.user_agent, **dict(cfg.headers)}
    timeout, tasks, delay = cfg.timeout_seconds, cfg.fetch_parallelism, cfg.delay_seconds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        pace = Pace(delay * tasks, delay * (task.partitionId() % tasks if task else 0))
        rows: list[dict] = []
        for batch in batches:
            for url in pace.order(batch["url"]):
                rows.append(answer(url, headers, timeout, get))
                if len(rows) == _PAGES_AT_ONCE:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return frontier.select("url").repartition(tasks, "url").mapInPandas(run, ANSWER)


class HostGroup(InputPartition):
    """URLs of some hosts, for one task."""

    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Get) -> None:
        given = CrawlConfig
        self.get = get
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip()))
        self.timeout = float(options.get("timeout", given.timeout_seconds))
        self.delay = float(options.get("delay", given.delay_seconds))
        self.groups = int(options.get("groups", given.fetch_parallelism))
        if not self.urls:
            raise ValueError("option 'urls' names no page")
        if self.groups < 1 or self.delay < 0 or self.timeout <= 0:
            raise ValueError("groups and timeout have to be positive, and delay not negative")
        self.headers = {"User-Agent": given.user_agent}
        self.headers |= {k[len("header."):].title(): v for k, v in options.items() if k.lower().startswith("header.")}

    def partitions(self) -> list[HostGroup]:
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(host_of(url), []).append(url)
        groups: list[list[str]] = [[] for _ in range(min(self.groups, len(hosts)))]
        # The largest host first, each to the group with the fewest URLs.
        for host in sorted(hosts, key=lambda h: (-len(hosts[h]), h)):
            min(groups, key=len).extend(hosts[host])
        return [HostGroup(urls) for urls in groups]

    def read(self, partition: HostGroup) -> Iterator[tuple]:
        for url in Pace(self.delay).order(partition.urls):
            yield tuple(answer(url, self.headers, self.timeout, self.get)[c] for c in COLUMNS)


class PageSource(DataSource):
    """``spark.read.format("pages")``: the answers of a list of pages, such as seeds or pages to look at again.

    Options: ``urls`` (one a line), ``header.<name>``, ``timeout``, ``delay`` (seconds between two
    requests to a host) and ``groups``. All URLs of a host are asked by one task, so that its
    pace holds without a word between tasks. The list is an option and passes through
    the driver; the frontier of a crawl is a table, see ``fetch_over_http``. A page that is
    listed twice is asked once; rereading the DataFrame asks again.
    """

    get: Get = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, self.get)


def fetch_from_table(frontier: DataFrame, pages: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """Answers from stored pages (``url``, ``html``, and ``body`` if their bytes were kept); an absent page is a failure."""
    body = F.col("body") if "body" in pages.columns else F.col("html").cast("binary")
    keyed = pages.select(crawl_url(F.col("url"), cfg).alias("url"), F.col("url").alias("raw_url"), "html", body.alias("body"))
    # A frontier is often small next to the pages: only what it asks for is compared and shuffled.
    asked = keyed.filter(F.col("url") != "").join(frontier.select("url"), "url", "left_semi")
    stored = first_per_key(asked, ["url"], [F.col("raw_url")])
    found = frontier.select("url").join(stored, "url", "left")
    hit = F.col("raw_url").isNotNull()
    return found.select(
        "url",
        F.when(hit, F.col("url")).alias("final_url"),
        "html",
        "body",
        F.when(hit, F.lit(200)).otherwise(F.lit(404)).alias("status_code"),
        F.lit("").alias("encoding"),
        F.when(hit, F.lit("text/html")).alias("content_type"),
        F.when(~hit, F.lit("HTTPError: 404 Not Found")).alias("error"),
    )
