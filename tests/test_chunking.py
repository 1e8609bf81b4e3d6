"""Chunking against models of its rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagelore.config import ChunkConfig
from pagelore.operators.chunking import (
    chunk_documents,
    chunk_statistics,
    dedupe_chunks,
    merge_small_sections,
    word_windows,
)

SECTIONS = ("array<struct<heading:string,level:int,paragraphs:array<string>,bullets:array<string>,"
            "content:string,word_count:int>>")


def windows_model(words, target=180, largest=260, overlap=30):
    if len(words) <= largest:
        return [words] if words else []
    out, start = [], 0
    while True:
        end = min(start + largest, len(words))
        if end < len(words):
            end = min(start + target, end)
        out.append(words[start:end])
        if end >= len(words):
            return out
        start = max(end - overlap, start + 1)


@pytest.mark.parametrize("cfg", [
    ChunkConfig(), ChunkConfig(target_words=10, max_words=14, overlap_words=3),
    ChunkConfig(target_words=5, max_words=5, overlap_words=9), ChunkConfig(target_words=9, max_words=6, overlap_words=2)])
def test_windows(spark, cfg):
    sizes = [0, 1, 4, 5, 6, 7, 19, 20, 21, 179, 180, 181, 259, 260, 261, 410, 411, 560, 561, 1999, 5000]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "n int, t string")
    rows = df.select("n", word_windows(F.col("t"), cfg).alias("w")).collect()
    for r in rows:
        words = [f"w{i}" for i in range(r.n)]
        want = windows_model(words, cfg.target_words, cfg.max_words, cfg.overlap_words)
        assert [w.text for w in r.w] == [" ".join(v) for v in want]
        assert [w.word_count for w in r.w] == [len(v) for v in want]


def merge_model(sections, small=35, least=20):
    out, held = [], None
    for heading, words in sections:
        if not words:
            continue
        held = (held[0], held[1] + words) if held else (heading, list(words))
        if len(words) >= small or len(held[1]) >= small:
            out.append(held)
            held = None
    if held and len(held[1]) >= least:
        out.append(held)
    return out


def test_merge_is_a_fold(spark):
    rnd = random.Random(3)
    sizes = [0, 1, 5, 19, 20, 34, 35, 36, 80]
    docs = []
    for _ in range(200):
        docs.append([(f"h{j}", [f"x{rnd.randrange(999)}" for _ in range(rnd.choice(sizes))])
                     for j in range(rnd.randint(0, 7))])
    rows = [(i, [(h, 1, [" ".join(w)], [], "", 0) for h, w in d]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, f"i int, s {SECTIONS}")
    got = df.select("i", merge_small_sections(F.col("s"), ChunkConfig()).alias("m")).collect()
    for r in got:
        # A heading is part of the text of its section.
        want = merge_model([(h, ([h] + w)) for h, w in docs[r.i]])
        assert [(m.heading, m.words) for m in r.m] == want


def _docs(spark, rows):
    return spark.createDataFrame(
        rows, "position string, copies long, document_id string, manifest_canonical_url string, content_hash string,"
              f" url string, canonical_url string, title string, page_type string, content string, sections {SECTIONS}")


def test_documents_to_unique_chunks(spark):
    body = " ".join(f"w{i}" for i in range(300))
    short = " ".join(f"s{i}" for i in range(40))
    secs = [("", 0, ["menu"], [], "menu", 1), ("Head", 2, [body], [], f"Head\n{body}", 301), ("", 1, [short], [], short, 40)]
    rows = [("b.json", 2, "doc_b", "https://h/b", "", "u", "", " T  x", None, "c", secs),
            ("a.json", 1, "doc_a", "", "hash", "", "https://h/c", "T", "home", "c", secs[2:])]
    every = chunk_documents(_docs(spark, rows))
    got = every.orderBy("position", "chunk_index").collect()
    words = ["Head"] + body.split() + ["Head"] + body.split()
    windows = windows_model(words)
    assert [r.text for r in got if r.document_id == "doc_b"] == [" ".join(w) for w in windows] + [short]
    b = [r for r in got if r.document_id == "doc_b"]
    assert [(r.section, r.section_index, r.section_level) for r in b][-1] == ("", 1, 1)
    assert [r.chunk_index for r in b] == list(range(len(b)))
    assert b[0].chunk_hash == hashlib.sha256(b[0].text.encode()).hexdigest()
    assert b[0].chunk_id == f"doc_b__{b[0].chunk_hash[:16]}"
    assert b[0].content_hash == hashlib.sha256(b"c").hexdigest() and b[0].title == "T x" and b[0].page_type == "general"
    a = [r for r in got if r.document_id == "doc_a"][0]
    assert (a.canonical_url, a.url, a.content_hash, a.page_type) == ("https://h/c", "https://h/c", "hash", "home")
    unique = dedupe_chunks(every)
    kept = {(r.position, r.chunk_hash) for r in unique.collect()}
    assert ("a.json", a.chunk_hash) in kept and ("b.json", a.chunk_hash) not in kept
    stats = chunk_statistics(every, unique).first()
    assert stats.raw_chunks == 2 * len(b) + 1 and stats.unique_chunks == len(b)
    assert stats.duplicate_chunks == stats.raw_chunks - stats.unique_chunks and stats.oversized_chunks == 0


def test_chunking_is_narrow_and_dedup_limits_groups_before_the_shuffle(spark):
    every = chunk_documents(_docs(spark, []))
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = dedupe_chunks(every)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_missing_document_id_fails(spark):
    rows = [("p", 1, "", "", "", "u", "", "", "", "", [("", 0, ["x " * 40], [], "", 0)])]
    with pytest.raises(Exception, match="missing document_id"):
        chunk_documents(_docs(spark, rows)).collect()
