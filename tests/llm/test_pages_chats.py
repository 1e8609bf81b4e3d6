"""HTML extraction, chat formatting, licence scans."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagelore.llm import chat_format, html_main, licence
from pagelore.llm.queries import llm_oracles
from tests.llm.helpers import DOCS, awkward, collected, documents, prose

PAGES = "page_id long, url string, html string"


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head><meta charset=utf-8>{head}<style>p{{}}</style></head><body>{body}</body></html>"


def text_of(html):
    return html_main.main_text(html_main.parse(html), frozenset())


@pytest.mark.parametrize(
    "html,want",
    [
        (page("<nav><a>x</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three</p></article><footer>f</footer>"), "A & B\none two three"),
        (page("<article><h1>H</h1><p><b>bold<br><p>next</p><p>last</article>"), "H\nbold\nnext\nlast"),
        (page('<article><p>a</p><div class="ad">buy</div><aside>s</aside><form><p>q</p></form><p>b</p><section id="comments"><p>c</p></section></article>'), "a\nb"),
        (page('<script>var t="</p><article>";</script><main><p>&lt;b&gt; &copy 5 &am</p></main>'), "<b> © 5 &am"),
        (page("<div class=content><p>x</p></div><div class=sidebar><p>y</p></div>"), "x"),
        (page("<p>plain</p><p>body"), "plain\nbody"),
        ("", ""), ("no markup", "no markup"), ("<article>", ""), ("<article><p>cut <b>of", "cut of"), ("<p>a<!-- b --> c<![CDATA[d]]>", "a cd"),
        (page("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><pre> x\n y </pre></article>"), "1\n2\na\nb\nx y"),
        (page("<article><p hidden>h</p><p style='display: none'>n</p><p class='cookie-notice'>c</p><p>ok</p></article>"), "ok"),
        (page("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"), "deep"),
    ],
)
def test_main_text(html, want):
    assert text_of(html) == want


def test_site_template_goes(spark):
    bar = "<div><span>Our site since 1999</span></div>"
    rows = [(k, f"http://a.example/{k}", page(f"{bar}<div><p>{prose(k, 20)}</p></div><div>bye</div>")) for k in range(8)]
    rows += [(20 + k, f"http://B.example:80/{k}", page(f"{bar}<div><p>{prose(20 + k, 20)}</p></div>")) for k in range(2)]
    got = {r.page_id: r for r in html_main.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k].text == prose(k, 20) for k in range(8))
    spread = html_main.TemplateConfig(broadcast_hashes=0, hot_pages=2)
    assert collected(html_main.extract_main_text(spark.createDataFrame(rows, PAGES), spread), "page_id", "text") == sorted([(r.page_id, r.text) for r in got.values()], key=repr)
    # Two pages are too few to tell a template.
    assert got[20].text == "Our site since 1999\n" + prose(20, 20)
    # Sentences that articles share stay.
    shared = [(k, f"http://c.example/{k}", page(f"<article><p>Same words.</p><p>{prose(k, 9)}</p></article>")) for k in range(6)]
    got = html_main.extract_main_text(spark.createDataFrame(shared, PAGES)).collect()
    assert all(r.text == "Same words.\n" + prose(r.page_id, 9) and r.n_chars == len(r.text) for r in got)


def test_rare_template_of_a_large_host_goes(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(120):
        lines = [prose(1000 + 10 * k + j, 12) for j in range(rng.randrange(2, 6))]
        if k % 3 == 0:
            lines.insert(rng.randrange(1, len(lines)), "A sentence that articles share.")
        want[k] = "\n".join(lines)
        body = "".join(f"<p>{line}</p>" for line in lines)
        notice = "<ul><li>Call us</li><li>Now open</li></ul>" if k % 8 == 0 else ""
        closing = "<p>Read on tomorrow.</p>" if k % 2 else ""
        rotating = f"<div><span>Offer {k % 10}</span></div>"
        rows.append((k, f"http://a.example/{k}", page(f"<article>{notice}{body}{rotating}{closing}</article>")))
    # Copies of a page are no template.
    rows += [(200 + k, f"http://a.example/{k}", page("<article><p>copied one</p><div>copied two</div></article>")) for k in range(30)]
    rows += [(300 + k, f"http://a.example/{k}", page("<article><p>near one</p><p>near two, longer</p>" + f"<p>{k}</p></article>")) for k in range(30)]
    got = {r.page_id: r.text for r in html_main.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: got[k] for k in want} == want
    assert all(got[200 + k] == "copied one\ncopied two" and got[300 + k] == f"near one\nnear two, longer\n{k}" for k in range(30))


def test_only_template_hashes_are_gathered(spark):
    rows = [(k, "http://a.example/", page(f"<div><i>{k // 3}</i></div>")) for k in range(60)] + [(99, None, None)]
    found = html_main.template_subtrees(spark.createDataFrame(rows, PAGES))
    assert [r.host for r in found.collect()] == ["a.example"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The share is a filter below the join with the hosts' page counts, not one on the gathered list.
    assert "filter(" not in plan.split("Join")[0] and plan.index("collect_list") < plan.index("Join")


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x/", "<p>a"), (3, None, "<p>b"), (3, None, "<p>b"), (4, "u", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' AS text", "1 AS host", "2 AS template")
    got = html_main.extract_main_text(df)
    assert collected(got, "page_id", "text") == sorted([(1, ""), (2, ""), (None, "a"), (3, "b"), (3, "b"), (4, ("long " * 50_000).strip())], key=repr)
    assert html_main.extract_main_text(spark.createDataFrame([], PAGES)).collect() == []


CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|end|>", "<\\|x", "<\\\\|", "[\\INST] [\\\\/INST]", "<<SYS>> <</SYS>> <s>", "a < b | c [x]", "<|start|>user<|body|>"])
def test_escape_is_undone(text):
    shown = chat_format.escape(text)
    assert chat_format.unescape(shown) == text
    assert not any(mark in shown for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def plain_chats(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in by.items():
        said = "".join(t for role, t in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


def chat_rows():
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|> é"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a")]
    rows += [(3, 0, "assistant", "tie a"), (None, 0, "user", "no id"), (4, None, "assistant", "z" * 100_000), (5, 0, "user<|body|>", "odd role"), (6, 2, "system", "")]
    return rows + [(7, k, "assistant" if k % 2 else "user", f"[INST] {k} </s>") for k in range(300)]


def test_chats_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, CHATS).selectExpr("*", "'clash' AS segment", "0 AS loss_from")
    segments = chat_format.format_messages(df)
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert collected(chat_format.read_back(segments), *names) == sorted(plain_chats(rows), key=repr)
    lengths = {r.conv_id: r.formatted_chars for r in chat_format.read_back(segments).collect()}
    assert {r.conv_id: len(r.formatted) for r in chat_format.formatted_text(segments).collect()} == lengths
    assert chat_format.read_back(chat_format.format_messages(spark.createDataFrame([], CHATS))).collect() == []


def test_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", None, [("text", "look </", None, None, None, None, None), ("text", "s> at", None, None, None, None, None), ("image", None, "a.png", 100, 60, None, None),
                              ("audio", None, "b.wav", None, None, 4.0, None), ("document", None, "c.pdf", None, None, None, 3), ("image", None, "d.png", None, None, None, None)]),
        (1, 1, "assistant", "seen", None), (1, 2, "user", "x", []),
    ]
    df = spark.createDataFrame(rows, f"{CHATS}, parts array<{chat_format.PART}>")
    got = {r.turn: r for r in chat_format.format_messages(df).collect()}
    assert got[0].segment == "<|start|>user<|body|>look <\\/s> at<|image:0|><|audio:1|><|document:2|><|image:3|><|end|>"
    assert [(a.position, a.kind, a.ref, a.tokens) for a in got[0].attachments] == [(0, "image", "a.png", 12), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1536), (3, "image", "d.png", 1)]
    assert got[0].n_tokens_expanded == 12 + 50 + 1536 + 1
    assert got[1].segment[got[1].loss_from : got[1].loss_to] == "seen" and got[2].segment == "<|start|>user<|body|><|end|>"


def test_chat_query_equals_its_sql(spark):
    import duckdb

    rows = [r for r in chat_rows() if r[0] is not None and r[1] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(llm_oracles()["op3_chat_formatting"]).fetchall())
    got = chat_format.read_back(chat_format.format_messages(chat_format.with_probe(spark.createDataFrame(rows, CHATS)))).drop("n_attachments")
    # A role with a control string is escaped in the text; the SQL escapes texts alone.
    assert [r for r in sorted(map(tuple, got.collect())) if r[0] != 5] == [r for r in want if r[0] != 5]


def test_licences_are_found_and_prose_is_not(spark):
    from pagelore.llm.licence_texts import TEMPLATES

    texts = [(k, prose(k, 80) + "\n" + prose(1000 + k, 40)) for k in range(60)]
    texts += [(100 + k, prose(k, 30) + "\n" + t + "\n" + prose(k, 12)) for k, t in enumerate(t for ts in TEMPLATES.values() for t in ts)]
    texts += [(200, "Licensed under the Apache License, Version 1.1."), (201, "Mit."), (202, "Distributed under a special license agreement of the vendor."), (None, "Released under the MIT License.")]
    docs = documents(spark, awkward() + texts, "family", "paragraph", "gram")
    model = licence.train(docs)
    got = licence.scan(docs, model).collect()
    found = {(r.doc_id, r.paragraph): r for r in got}
    assert len(found) == len(got)
    families = [f for f, ts in TEMPLATES.items() for _ in ts]
    right = [found.get((100 + k, 1)) and found[100 + k, 1].family == f and found[100 + k, 1].confirmed for k, f in enumerate(families)]
    assert sum(map(bool, right)) >= 0.9 * len(right)
    assert found[200, 0].family == "apache" and found[None, 0].family == "mit" and (201, 0) not in found
    assert found[202, 0].family == "unknown" and not found[202, 0].confirmed
    assert not [k for k in found if k[0] is not None and k[0] < 60 or k[1] == 2]
    assert licence.scan(spark.createDataFrame([], DOCS), model).collect() == []


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "mpl": """# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "apache": """ * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}

#: Licences that no template and no example of unknown wording names, and one that an example has.
STRANGE = (
    "Licensed under the EUPL, version 1.2.",
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Licensed under the Zope Public License, Version 2.1.",
    "Licensed under the terms of the PostgreSQL License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
)


def test_wrapped_licences_are_one_paragraph_and_strange_ones_unknown(spark):
    docs = documents(spark, [(k, prose(k, 80) + "\n" + prose(1000 + k, 40)) for k in range(60)])
    model = licence.train(docs)
    texts = [(k, prose(k, 20) + "\n" + t + "\n" + prose(k, 20)) for k, t in enumerate(WRAPPED.values())]
    got = licence.scan(documents(spark, texts), model).collect()
    assert sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in got) == [(k, 1, f, True) for k, f in enumerate(WRAPPED)]
    got = licence.scan(documents(spark, list(enumerate(STRANGE))), model).collect()
    assert not any(r.confirmed for r in got)
    assert sum(r.family == "unknown" for r in got) >= len(STRANGE) - 1


def test_paragraphs_end_with_a_sentence(spark):
    def of(text):
        return spark.createDataFrame([(text,)], "text string").select(licence.paragraphs(F.col("text")).alias("p")).first().p

    long = "word " * 12
    assert of(f"{long}one,\nTWO {long}\n// three {long}\r\n * four.\nfive\nsix\n\nseven") == [
        f"{long}one, TWO {long} three {long}\r four.", "five", "six", "", "seven"
    ]
    # A sentence of its own stays one.
    assert of(f"{long}one,\nLicensed under\n{long},\n  # (two)") == [f"{long}one,", "Licensed under", f"{long}, (two)"]
    assert of("") == [""] and of(f"{long}\n") == [long, ""] and of(None) is None
    assert len(of(long + " " * 200_000 + "\nb")) == 2


def test_crafted_pages_are_read_in_linear_time():
    import time

    pieces = ("<b ", "<title>", "<div>" , "</x>", "<div class=content>", '<b a="', "<p", "<td></span>", "<!", "<article>", "<li>", "<p" + "a" * 50, "&", "<span><td>")
    pages = [p * (100_000 // len(p)) for p in pieces] + ["<div>" * 10_000 + "</x>" * 10_000, "<span><td>" + "<div>" * 10_000 + "</span>" * 10_000, "<" + "a" * 100_000]
    for page in pages:
        began = time.time()
        html_main.page_hashes(html_main.parse(page))
        html_main.main_text(html_main.parse(page), frozenset())
        assert time.time() - began < 20, page[:20]


def test_paragraphs_with_a_suspicious_word_and_all_articles_stay():
    def text(body):
        return html_main.main_text(html_main.parse(f"<body>{body}</body>"), frozenset())

    assert text('<article><p class="share-price">up</p><p class="skip-intro">in</p><p class="share">no</p><div class="share-bar">no</div></article>') == "up\nin"
    assert text("<article><p>so <math><mi>E</mi>=mc2</math></p><label>kept</label></article>") == "so E=mc2 kept" or "E=mc2" in text("<article><p>so <math><mi>E</mi>=mc2</math></p></article>")
    assert text("<article><p>one</p></article><aside>x</aside><article><p>two longer</p><article class=comment>no</article></article>") .split("\n")[:2] == ["one", "two longer"]
