"""Pages to structured documents.

A page is parsed once into flat nodes; everything else is array functions inside the
same row. Extraction of any number of pages is therefore one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.config import BLOCK_TAGS, NOISE_HEADINGS, NOISE_TEXT_PREFIXES, SKIPPED_LINK_PREFIXES
from pagelore.functions.arrays import any_of, drop_adjacent_repeats, let, non_empty
from pagelore.functions.text import count_words, space_sentences, strip
from pagelore.functions.urls import document_url, page_type, resolve_url
from pagelore.schemas import SCHEMA_VERSION, SECTION
from pagelore.sources.html_nodes import html_nodes

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LABELS = ("div", "span")
_LABEL_WORDS = 12
_LABEL_CHARS = 120


def _join_texts(texts: Column, element: Column) -> Column:
    """Text of an element: its normalised pieces joined by blanks.

    Joining normalised pieces gives a normalised text, so nothing is cleaned twice.
    """
    pieces = F.slice(texts, element["from"] + 1, element["upto"] - element["from"])
    return F.array_join(non_empty(pieces), " ")


def _first(elements: Column, test) -> Column:
    return F.get(F.filter(elements, test), 0)


def page_title(nodes: Column) -> Column:
    """Text of the first title element."""
    raw = F.transform(nodes["texts"], lambda t: t["text"])

    def of(e: Column) -> Column:
        pieces = F.slice(raw, e["from"] + 1, e["upto"] - e["from"])
        return F.array_join(non_empty(F.transform(pieces, space_sentences)), " ")

    return let(
        _first(nodes["elements"], lambda e: e["tag"] == "title"),
        lambda e: F.when(e.isNull(), F.lit("")).otherwise(of(e)),
    )


def page_description(nodes: Column) -> Column:
    found = _first(nodes["elements"], lambda e: (e["tag"] == "meta") & (e["name"] == "description"))
    return space_sentences(found["content"])


def canonical_link(nodes: Column, url: Column) -> Column:
    """Normal form of the canonical link, or of the page's own URL where there is none."""
    found = _first(
        nodes["elements"],
        lambda e: (e["tag"] == "link") & F.contains(F.lower(e["rel"]), F.lit("canonical")),
    )["href"]
    return let(
        F.coalesce(found, F.lit("")),
        lambda h: F.when(h == "", document_url(url)).otherwise(document_url(resolve_url(url, h))),
    )


def page_links(nodes: Column, url: Column) -> Column:
    """Distinct link targets in order of appearance, each with its first anchor text."""
    raw = F.transform(nodes["texts"], lambda t: t["text"])

    def wanted(e: Column) -> Column:
        href = strip(F.coalesce(e["href"], F.lit("")))
        return (e["tag"] == "a") & let(
            href,
            lambda h: (h != "") & ~h.rlike("^(?:" + "|".join(SKIPPED_LINK_PREFIXES) + ")"),
        )

    def build(anchors: Column) -> Column:
        targets = F.transform(anchors, lambda a: document_url(resolve_url(url, strip(a["href"]))))

        def link(first: Column) -> Column:
            def text_of(a: Column) -> Column:
                pieces = F.slice(raw, a["from"] + 1, a["upto"] - a["from"])
                return F.array_join(non_empty(F.transform(pieces, space_sentences)), " ")

            return F.struct(first["url"].alias("url"), let(F.get(anchors, first["at"]), text_of).alias("text"))

        # Sorted by target and place, the first of each run is a target's first anchor.
        placed = F.filter(
            F.transform(targets, lambda u, i: F.struct(u.alias("url"), i.alias("at"))), lambda p: p["url"] != ""
        )

        def first_of_each(ordered: Column) -> Column:
            firsts = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["url"] != p["url"]))
            by_place = F.sort_array(F.transform(firsts, lambda p: F.struct(p["at"].alias("at"), p["url"].alias("url"))))
            return F.transform(by_place, link)

        return let(F.sort_array(placed), first_of_each)

    return let(F.filter(nodes["elements"], wanted), build)


def visible_texts(nodes: Column) -> Column:
    """Normalised text pieces; pieces of removed subtrees are empty, positions kept."""
    return F.transform(
        nodes["texts"],
        lambda t: F.when(t["hidden"], F.lit("")).otherwise(space_sentences(t["text"])),
    )


def page_headings(nodes: Column, texts: Column) -> Column:
    found = F.transform(
        F.filter(nodes["elements"], lambda e: e["tag"].isin(*_HEADINGS) & ~e["hidden"]),
        lambda e: F.struct(
            F.substring(e["tag"], 2, 1).cast("int").alias("level"), _join_texts(texts, e).alias("text")
        ),
    )
    return F.filter(found, lambda h: h["text"] != "")


def _root(elements: Column) -> Column:
    """The main, else the first article, else the body element, with its position."""
    placed = F.transform(elements, lambda e, i: F.struct(i.alias("at"), e.alias("e")))

    def first(tag: str) -> Column:
        return _first(placed, lambda p: (p["e"]["tag"] == tag) & ~p["e"]["hidden"])

    return F.coalesce(first("main"), first("article"), first("body"))


def _blocks(elements: Column, texts: Column, root: Column) -> Column:
    """Headings, passages, list items and short labels below the root, in order."""
    inside = F.transform(
        F.slice(elements, root["at"] + 2, root["e"]["last"] - root["at"] - 1),
        lambda e, i: F.struct((i + root["at"] + 1).alias("at"), e.alias("e")),
    )

    def pick(placed: Column) -> Column:
        noisy = F.filter(placed, lambda p: p["e"]["noisy"] & ~p["e"]["hidden"])

        def choose(ranges: Column) -> Column:
            def wanted(p: Column) -> Column:
                e = p["e"]
                quiet = ~F.exists(ranges, lambda r: (r["at"] < p["at"]) & (p["at"] < r["e"]["last"]))
                return (
                    e["tag"].isin(*_HEADINGS, "p", "li", *_LABELS) & ~e["hidden"] & quiet
                    & (e["upto"] > e["from"])
                )

            def block(p: Column) -> Column:
                e = p["e"]
                label = e["tag"].isin(*_LABELS)
                below = F.slice(elements, p["at"] + 2, e["last"] - p["at"] - 1)
                plain = ~F.exists(below, lambda d: d["tag"].isin(*BLOCK_TAGS) & ~d["hidden"])
                # Every piece has a word, so more pieces than words allowed is no label.
                small = F.size(non_empty(F.slice(texts, e["from"] + 1, e["upto"] - e["from"]))) <= _LABEL_WORDS
                level = F.when(e["tag"].isin(*_HEADINGS), F.substring(e["tag"], 2, 1).cast("int"))
                return F.struct(
                    F.coalesce(level, F.lit(0)).alias("level"),
                    (e["tag"] == "li").alias("bullet"),
                    label.alias("label"),
                    F.when(~label | (plain & small), _join_texts(texts, e)).otherwise("").alias("text"),
                )

            return F.transform(F.filter(placed, wanted), block)

        return let(noisy, choose)

    def keep(b: Column) -> Column:
        short = (F.char_length(b["text"]) <= _LABEL_CHARS) & (count_words(b["text"]) <= _LABEL_WORDS)
        noise = F.lower(b["text"]).rlike(any_of(NOISE_TEXT_PREFIXES))
        return (b["text"] != "") & (~b["label"] | short) & ((b["level"] > 0) | ~noise)

    return F.filter(let(inside, pick), keep)


def _finish(part: Column) -> Column:
    """A section from the run of blocks that starts with its heading, if it has one."""
    first = part[0]
    heading = F.when(first["level"] > 0, first["text"]).otherwise(F.lit(""))

    def texts(bullet: bool) -> Column:
        own = F.filter(part, lambda b: (b["level"] == 0) & (b["bullet"] == F.lit(bullet)))
        return F.array_distinct(F.transform(own, lambda b: b["text"]))

    def build(s: Column) -> Column:
        parts = drop_adjacent_repeats(
            F.concat(non_empty(F.array(s["heading"])), s["paragraphs"], s["bullets"])
        )
        return let(
            F.array_join(parts, "\n"),
            lambda content: F.struct(
                s["heading"].alias("heading"),
                s["level"].alias("level"),
                s["paragraphs"].alias("paragraphs"),
                s["bullets"].alias("bullets"),
                content.alias("content"),
                count_words(content).alias("word_count"),
            ),
        )

    return let(
        F.struct(
            heading.alias("heading"),
            first["level"].alias("level"),
            texts(False).alias("paragraphs"),
            texts(True).alias("bullets"),
        ),
        build,
    )


def page_sections(nodes: Column, texts: Column) -> Column:
    """Sections below the root: a heading opens one, text before the first is level 0.

    A section under a noise heading is dropped with its body.
    """
    none = F.array().cast(f"array<{SECTION}>")

    def cut(blocks: Column) -> Column:
        places = F.filter(
            F.transform(blocks, lambda b, i: F.when((b["level"] > 0) | (i == 0), i + 1)),
            lambda p: p.isNotNull(),
        )

        def runs(starts: Column) -> Column:
            def run(start: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), F.size(blocks) + 1)
                return let(F.slice(blocks, start, end - start), _finish)

            return F.transform(starts, run)

        return F.filter(
            let(places, runs),
            lambda s: (s["content"] != "")
            & ~F.lower(s["heading"]).rlike(any_of(NOISE_HEADINGS)),
        )

    def under(root: Column) -> Column:
        return F.when(root.isNull(), none).otherwise(
            let(_blocks(nodes["elements"], texts, root), cut)
        )

    return F.coalesce(let(_root(nodes["elements"]), under), none)


def root_text(nodes: Column, texts: Column) -> Column:
    return let(
        _root(nodes["elements"]),
        lambda r: F.when(r.isNull(), F.lit("")).otherwise(_join_texts(texts, r["e"])),
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Documents of pages with ``url`` and ``html`` (and, if present, response columns).

    Other columns of the pages pass through in front.
    """
    own = ("url", "html", "status_code", "encoding")
    through = [c for c in pages.columns if c not in own]
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    encoding = F.col("encoding") if "encoding" in pages.columns else F.lit("")
    nodes, texts = F.col("_nodes"), F.col("_texts")
    read = pages.select(
        *through, "url", status.alias("status_code"), encoding.alias("encoding"),
        html_nodes(F.col("html").cast("string")).alias("_nodes"),
    )
    first = read.withColumns(
        {
            "_texts": visible_texts(nodes),
            "title": page_title(nodes),
            "description": page_description(nodes),
            "canonical_url": canonical_link(nodes, F.col("url")),
            "links": page_links(nodes, F.col("url")),
        }
    )
    second = first.withColumns(
        {
            "headings": page_headings(nodes, texts),
            "_sections": page_sections(nodes, texts),
            "_root_text": root_text(nodes, texts),
        }
    ).drop("_nodes", "_texts")
    content = F.array_join(F.transform(F.col("_sections"), lambda s: s["content"]), "\n\n")
    third = second.withColumn("_content", content)
    fallback = (F.col("_content") == "") & (F.col("_root_text") != "")
    only = F.array(
        F.struct(
            F.lit("").alias("heading"),
            F.lit(0).alias("level"),
            F.array(F.col("_root_text")).alias("paragraphs"),
            F.array().cast("array<string>").alias("bullets"),
            F.col("_root_text").alias("content"),
            count_words(F.col("_root_text")).alias("word_count"),
        )
    )
    fourth = third.withColumn(
        "content", F.when(fallback, F.col("_root_text")).otherwise(F.col("_content"))
    )
    return fourth.select(
        *through,
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        document_url(F.col("url")).alias("url"),
        "canonical_url",
        "title",
        "description",
        page_type(F.col("canonical_url")).alias("page_type"),
        "headings",
        F.when(fallback & (F.size("_sections") == 0), only).otherwise(F.col("_sections")).alias("sections"),
        "links",
        "content",
        count_words(F.col("content")).alias("word_count"),
        "status_code",
        F.coalesce("encoding", F.lit("")).alias("encoding"),
    )


def is_html_response(content_type: Column) -> Column:
    value = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(value, F.lit("text/html")) | F.contains(value, F.lit("application/xhtml+xml"))
