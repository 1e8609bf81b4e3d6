"""HTML extraction: site template removal.

Every page is read into element subtrees. A subtree's hash covers its tag, its classes,
its text and its children. Spark counts, per host, on how many pages a hash occurs; subtrees
that recur on several pages of their host are the site's template and are deleted. What is
left of the article becomes text, one line per block.
"""

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import batches, small_batches, small_or_shuffled
from pagelore.operators.joins import join_unique
from pagelore.session import materialize


@dataclass(frozen=True)
class TemplateConfig:
    #: A subtree is template if it occurs on this many pages of its host at least,
    min_pages: int = 3
    #: and on this share of them, where the host is so small that this is less than ``sure_pages``.
    min_share: float = 0.3
    #: So many pages tell a template on any host,
    sure_pages: int = 10
    #: if they are this share of the host's pages; a host's list has a thousand times the elements of a page at most.
    least_share: float = 0.001
    #: Different articles, of 64 kinds by their hash, that a subtree has to stand beside: copied pages are no template.
    kinds: int = 2
    #: The same inside an article, where a subtree also needs ``sure_pages`` and one place from the article's start or end.
    article_kinds: int = 8
    #: Hashes of all hosts that are sent to all executors at most.
    broadcast_hashes: int = 2_000_000
    #: Beyond that, a host with so many pages is spread over several tasks.
    hot_pages: int = 100_000


# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style textarea title noscript template iframe noembed noframes nav header footer aside form button select option "
    "head svg canvas object audio video dialog menu input fieldset".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr hgroup html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = BLOCKS - frozenset("body html caption td th tbody thead tfoot tr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th table ul ol dl figure figcaption".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
#: Words of class, id or role that mark what is not article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended comment comments commentlist respond disqus reply replies pagination "
    "pager toolbar widget complementary contentinfo search skip".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
INLINE = frozenset("b i em strong a span code".split())
#: Marks the hash of a subtree that is template inside an article.
INSIDE = 0x2545F4914F6CDD1D
CONTENT = ("article", "content", "post", "entry", "story", "main", "body-text", "entry-content", "post-content", "article-body")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    digest: int = 0

    def names(self) -> list[str]:
        """Names in class, id and role, lower-cased."""
        return " ".join(self.attributes.get(k) or "" for k in ("class", "id", "role")).lower().split()


class _Open:
    """The open elements, outermost first, and where each tag stands among them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0: there is none."""
        place, places = 0, self.places
        for tag in tags:
            held = places.get(tag)
            if held and held[-1] > place:
                place = held[-1]
        return place

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close(self, names: tuple, limits: tuple) -> None:
        """Close the innermost of ``names``, unless one of ``limits`` is open within it."""
        place = self.last(names)
        if place and place > self.last(limits):
            self.cut(place)


_PARAGRAPH_LIMITS = ("button", "td", "th", "table", "article", "main", "section", "div", "body", "aside", "nav", "footer", "header")


def parse(page: str) -> Node:
    """A tree of elements and texts. End tags close up to their element, blocks close an open paragraph.

    A tag ends before the next ``<``, else it is text; every step is bounded by what it closes, so
    the time is linear in the page.
    """
    root = Node("#root")
    opened = _Open(root)
    at, end = 0, len(page)
    endless: set[str] = set()

    def text(piece: str) -> None:
        if piece:
            opened.stack[-1].children.append(entities.unescape(piece))

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1]:
            place = opened.last((tag,))
            free = tag in ("html", "body") or tag in BLOCKS or tag in DROPPED
            if place and (free or place >= opened.last(("td", "th", "article", "main", "body"))):
                opened.cut(place)
            continue
        if tag in CLOSED_BY_BLOCK or tag in DROPPED:
            opened.close(("p",), _PARAGRAPH_LIMITS)
        if tag in CLOSES:
            names, limits = CLOSES[tag]
            opened.close(tuple(names.split()), limits)
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        node = Node(tag, attributes)
        opened.stack[-1].children.append(node)
        if tag in RAW:
            stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in ("textarea", "title") and stop:
                node.children.append(entities.unescape(page[at : stop.start()]))
            if stop:
                at = stop.end()
            elif tag in ("script", "style"):
                at = end
            else:
                endless.add(tag)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            opened.push(node)
    return root


def hash_subtrees(root: Node) -> list[Node]:
    """Sets the digest of every element, children first; iterative, as pages can be nested deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        state = hashlib.blake2b(digest_size=8)
        state.update(f"{node.tag}\0{node.attributes.get('class', '')}\0{node.attributes.get('id', '')}".encode("utf-8", "replace"))
        for c in node.children:
            if isinstance(c, Node):
                state.update(b"\1" + c.digest.to_bytes(8, "little", signed=True))
            elif told := _SPACE.sub(" ", c).strip():
                state.update(b"\2" + told.encode("utf-8", "replace"))
        node.digest = int.from_bytes(state.digest(), "little", signed=True)
    return order


def _noise(node: Node) -> bool:
    if node.tag in DROPPED or "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in (node.attributes.get("style") or "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body", "main", "article"):
        return False
    if node.tag in PARAGRAPHS:
        # A paragraph that only carries such a word among others, such as share-price, is content.
        return any(t and all(w in NOISE for w in t) for t in map(_WORDS.findall, node.names()))
    return any(w in NOISE for t in node.names() for w in _WORDS.findall(t))


def find_roots(order: list[Node]) -> list[Node]:
    """The outermost articles, else the main element, else a container named as content, else the body."""
    articles = [n for n in order if n.tag == "article" and not _noise(n)]
    if len(articles) == 1:
        return articles
    if articles:
        nested = set()
        for n in articles:
            if id(n) not in nested:
                nested.update(id(c) for c in hash_order(n)[1:])
        return [n for n in _in_page_order(order[0]) if n.tag == "article" and id(n) not in nested and not _noise(n)]
    for wanted in (
        lambda n: n.tag == "main" or n.attributes.get("role") == "main",
        lambda n: n.tag in ("div", "section") and not _noise(n) and bool(
            set(f"{n.attributes.get('class', '')} {n.attributes.get('id', '')}".lower().split()) & set(CONTENT)),
        lambda n: n.tag == "body",
    ):
        found = [n for n in order if wanted(n)]
        if found:
            sizes = text_sizes(order) if len(found) > 1 else {id(found[0]): 0}
            return [max(found, key=lambda n: sizes[id(n)])]
    return order[:1]


def text_sizes(order: list[Node]) -> dict[int, int]:
    """Characters of every element's text less noise within it; children first, each element once."""
    sizes: dict[int, int] = {}
    for n in reversed(order):
        sizes[id(n)] = sum(len(c) if isinstance(c, str) else 0 if _noise(c) else sizes[id(c)] for c in n.children)
    return sizes


def shielded(top: Node) -> list[tuple[Node, int, int]]:
    """Outermost paragraphs, headings, lists and the like of an article, and the elements before and after each."""
    found, todo, at = [], [(top, False)], 0
    sizes = {}
    for node in reversed(hash_order(top)):
        sizes[id(node)] = 1 + sum(sizes[id(c)] for c in node.children if isinstance(c, Node))
    while todo:
        node, within = todo.pop()
        mine = node is not top and node.tag in PROSE | INLINE and not within
        if mine:
            found.append((node, at, sizes[id(top)] - at - sizes[id(node)]))
        at += 1
        todo += [(c, within or mine) for c in reversed(node.children) if isinstance(c, Node)]
    return found


def _in_page_order(top: Node) -> list[Node]:
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order


def hash_order(top: Node) -> list[Node]:
    """Elements of a subtree, parents first."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return order


def inside_key(node: Node) -> int:
    """A hash of the subtree's text alone: the same sentence in another element is the same."""
    parts, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
        else:
            todo += reversed(n.children)
    told = _SPACE.sub(" ", "".join(parts)).strip()
    return INSIDE ^ int.from_bytes(hashlib.blake2b(told.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def page_hashes(root: Node) -> tuple[int, list[tuple[int, int, int]]]:
    """The hash of the page's article, and hash, elements before and elements after of what could be template.

    Where the same text stands in an article twice, its places are -1. Outside, places are not looked at.
    """
    order = hash_subtrees(root)
    tops = find_roots(order)
    found = {n.digest: (0, 0) for n in order if n.tag != "#root" and n.children}
    for top in tops:
        if top.tag in ("article", "main"):
            for node, before, after in shielded(top):
                if node.children:
                    key = inside_key(node)
                    found[key] = (-1, -1) if key in found else (before, after)
    return sum(t.digest for t in tops), [(k, *v) for k, v in found.items()]


def main_text(root: Node, template: frozenset | set) -> str:
    """Blocks of the article in page order, joined by newlines.

    Inside the article element, paragraphs, headings, lists and the like are template only if
    they are so at one place: a sentence that many articles share at varying places
    belongs to each of them. Where that would take half of the article, it is a near copy of
    others and keeps them all.
    """
    order = hash_subtrees(root)
    return "\n".join(line for top in find_roots(order) for line in _lines(top, template))


def _lines(top: Node, template: frozenset | set) -> list[str]:
    article = top.tag in ("article", "main")
    cut = {id(n): n for n, _, _ in shielded(top) if inside_key(n) in template} if article and template else {}
    if cut:
        sizes = text_sizes(hash_order(top))
        if 2 * sum(sizes[k] for k in cut) >= sizes[id(top)]:
            cut = {}
    lines, run = [], []

    def close() -> None:
        line = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line:
            lines.append(line)

    todo: list = [top]
    while todo:
        node = todo.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif node is not top and (_noise(node) or (id(node) in cut if article and node.tag in PROSE | INLINE else node.digest in template)):
            if node.tag in BLOCKS or node.tag in DROPPED:
                close()
        elif node.tag in BLOCKS:
            close()
            todo.append(None)
            todo += reversed(node.children)
        else:
            todo += reversed(node.children)
    close()
    return lines


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def template_subtrees(pages: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """host and ``template``, the hashes of subtrees that recur on many pages of the host.

    Pages that cannot reach the limit alone are left out: a host needs ``min_pages`` pages.
    A null url is a host of its own, the empty one.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in batches(whole, "html", 4 << 20):
                hosts, kinds, rows = [], [], []
                for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    if page:
                        article, found = page_hashes(parse(page))
                        hosts += [host] * len(found)
                        kinds += [article % 64] * len(found)
                        rows += found
                columns = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array([_signed(1 << k) for k in kinds], pa.int64()),
                     *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))]],
                    ["host", "kind", "digest", "before", "after"],
                )

    hosted = pages.select(host_of(F.col("url")).alias("host"), "html")
    sizes = hosted.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= config.min_pages)
    sizes = materialize(sizes, "hosts")
    counted = (
        small_batches(hosted).mapInArrow(run, "host string, kind long, digest long, before int, after int").groupBy("host", "digest")
        .agg(F.count("*").alias("count"), F.bit_count(F.bit_or("kind")).alias("kinds"),
             F.max(F.greatest("before", "after")).alias("inside"),
             ((F.min("before") == F.max("before")) & (F.min("before") >= 0) | (F.min("after") == F.max("after")) & (F.min("after") >= 0)).alias("fixed"))
    )
    sure = F.greatest(F.lit(config.sure_pages), F.lit(config.least_share) * F.col("pages"))
    outside = (F.col("inside") == 0) & (F.col("kinds") >= config.kinds) & (F.col("count") >= F.least(sure, F.lit(config.min_share) * F.col("pages")))
    inside = (F.col("inside") != 0) & F.col("fixed") & (F.col("kinds") >= config.article_kinds) & (F.col("count") >= sure)
    # Lists are only gathered of what is template: before that, copied pages make a host's rows many.
    return (
        counted.where(F.col("count") >= config.min_pages).join(small_or_shuffled(sizes, sizes.count()), "host")
        .where(outside | inside)
        .groupBy("host").agg(F.collect_list("digest").alias("template"))
    )


def extract_main_text(pages: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text. Repeated rows give repeated results (and count
    as pages of their host). Other columns are dropped. Text outside any article, main or
    content element is taken from the body, less noise and template.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, frozenset())
        for whole in stream:
            for batch in batches(whole, "html", 4 << 20):
                texts = []
                for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                    if template is not held[0]:
                        held = (template, frozenset(template or ()))
                    texts.append(main_text(parse(page), held[1]) if page else "")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    known = materialize(template_subtrees(pages, config).where(F.size("template") > 0), "templates")
    hashes = known.agg(F.sum(F.size("template"))).first()[0] or 0
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # Pages are only shuffled, with hot hosts spread, if the templates are too many to be sent to all executors.
    if hashes <= config.broadcast_hashes:
        joined = hosted.join(F.broadcast(known), "host", "left")
    else:
        joined = join_unique(hosted, known, "host", "page_id", "left", config.hot_pages)
    return joined.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
