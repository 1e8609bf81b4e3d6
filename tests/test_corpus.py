"""Validation, lookup, hot keys, the point table and the stored file formats."""

import json

import pytest
from pyspark.sql import functions as F

from pagelore.config import CrawlConfig, EmbedConfig
from pagelore.operators import points as P
from pagelore.operators.embedding import HashedWords
from pagelore.operators.first_wins import first_per_key, repeated_groups
from pagelore.operators.holders import replace_documents
from pagelore.operators.joins import hot_keys, join_unique
from pagelore.operators.validation import (
    build_manifest,
    entry_outcomes,
    manifest_documents,
    resolve_entries,
    shadowed_files,
)
from pagelore.plans.corpus import chunk_corpus, embed_corpus, validate_corpus
from pagelore.schemas import DOCUMENT
from pagelore.sources import tables

SITE = CrawlConfig(canonical_host="www.h.example", bare_host="h.example")


def doc(url, title="T", words=30, stored=None, canonical="", **more):
    text = " ".join(f"{url[-1]}w{i}" for i in range(words))
    out = {"schema_version": "2.2", "url": url, "canonical_url": canonical, "title": title, "description": "", "page_type": "general",
           "headings": [], "links": [], "content": text, "word_count": words if stored is None else stored, "status_code": 200, "encoding": "",
           "sections": [{"heading": "", "level": 0, "paragraphs": [text], "bullets": [], "content": text, "word_count": words}]}
    return {**out, **more}


@pytest.fixture()
def folder(spark, tmp_path):
    docs = {
        "a.json": doc("https://h.example/a"), "b.json": doc("https://www.h.example/a/", title=""),
        "c.json": doc("https://h.example/c", words=100, stored=114), "d.json": doc("https://h.example/d", words=100, stored=130),
        "e.json": doc("https://h.example/e", words=0, sections=[]), "f.json": doc("https://h.example:bad/f"),
        "g.json": doc("https://h.example/c", canonical="https://h.example/g"),
    }
    del docs["a.json"]["links"]
    for name, body in docs.items():
        (tmp_path / name).write_text(json.dumps(body, indent=2))
    (tmp_path / "x.json").write_text('{"url": "https://h.example/x", ')
    (tmp_path / "y.json").write_text('{"title": "no url"}')
    return str(tmp_path)


def test_manifest(spark, folder):
    docs = tables.read_document_files(spark, folder)
    rows = {r.file: r for r in build_manifest(docs, SITE).collect()}
    status = {f: r.status for f, r in rows.items()}
    assert status == {"a.json": "valid", "b.json": "warning", "c.json": "valid", "d.json": "warning", "e.json": "warning",
                      "f.json": "invalid", "g.json": "valid", "x.json": "invalid", "y.json": "invalid"}
    assert rows["b.json"].errors == ["missing title"]
    assert rows["d.json"].errors == ["word_count mismatch: stored=130, calculated=100"]
    assert rows["e.json"].errors == ["document has no sections", "document has zero words"]
    assert rows["f.json"].errors == ["ValueError: Port could not be cast to integer value as 'bad'"]
    assert rows["y.json"].errors == ["Field required"] and rows["x.json"].errors == ["JSONDecodeError: malformed document"]
    assert rows["f.json"].document_id is None
    assert rows["a.json"].document_id == rows["b.json"].document_id and rows["a.json"].canonical_url == "https://www.h.example/a"
    assert rows["a.json"].link_count == 0 and rows["a.json"].section_count == 1


def test_report_and_header(spark, folder):
    found = validate_corpus(tables.read_document_files(spark, folder), SITE)
    h = found.header.first()
    assert (h.documents_found, h.document_count, h.invalid_count, h.warning_count) == (9, 6, 3, 3)
    assert (h.duplicate_url_count, h.duplicate_content_count) == (1, 0)
    dup = found.report["duplicate_urls"].collect()
    assert sorted(r.member for r in dup) == ["a.json", "b.json"] and {r.group_size for r in dup} == {2}
    assert found.report["duplicate_content"].count() == 0
    assert found.manifest.count() == 6 and found.report["invalid"].count() == 3


def test_lookup_prefers_canonical_and_greatest_file(spark):
    docs = spark.createDataFrame([("1.json", "u1", "c1"), ("2.json", "u2", "c1"), ("3.json", "u3", ""), ("4.json", "", None)],
                                 "file string, url string, canonical_url string")
    manifest = spark.createDataFrame(
        [("m1", "d1", "h", "c1", "u1"), ("m2", "d2", "h", "none", "u1"), ("m3", "d3", "h", "zz", "zz"), ("m4", "", "h", "u3", ""),
         ("m5", "d5", "h", "c1", "u1"), ("m6", "d6", "h", None, "u2")],
        "file string, document_id string, content_hash string, canonical_url string, url string")
    for hot in (1_000_000, 1):
        entries = resolve_entries(manifest, docs, hot)
        got = {r.position: (r.found_file, r.copies) for r in entries.collect()}
        assert got == {"m1": ("2.json", 2), "m2": ("1.json", 1), "m3": (None, 1), "m4": ("3.json", 1), "m6": ("2.json", 1)}
        o = entry_outcomes(entries).first()
        assert (o.documents_processed, o.missing_documents, o.failed_documents) == (4, 1, 1)
        joined = {r.file: (r.position, r.document_id, r.copies) for r in manifest_documents(entries, docs).collect()}
        assert joined == {"2.json": ("m1", "d1", 3), "1.json": ("m2", "d2", 1)}
    assert [r.file for r in shadowed_files(docs).collect()] == ["4.json"]


def test_hot_keys_give_the_same_join(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(40)] + [("k1", 99)]
    df = spark.createDataFrame(rows, "key string, member int")
    names = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, tag int")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, df.join(names, "key", how).select("key", "member", "tag").collect()), key=str)
        salted = join_unique(df, names, "key", "member", how, hot_rows=100)
        assert sorted(map(tuple, salted.select("key", "member", "tag").collect()), key=str) == plain
        assert salted.columns == ["key", "member", "tag"]
    groups = repeated_groups(df, "key", "member", hot_rows=100)
    assert groups.count() == 502 and {(r.key, r.group_size) for r in groups.collect()} == {("hot", 500), ("k1", 2)}


def test_first_per_key_cuts_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    top = first_per_key(df, ["k"], [F.col("v").desc()], 2)
    assert sorted((r.k, r.v) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_files_to_points(spark, folder, tmp_path):
    docs = tables.read_document_files(spark, folder)
    found = validate_corpus(docs, SITE)
    out = str(tmp_path / "out")
    tables.write_manifest(found.manifest, found.header, f"{out}/manifest")
    tables.write_report(found.report, f"{out}/report")
    manifest = tables.read_manifest(spark, f"{out}/manifest")
    chunked = chunk_corpus(manifest, docs)
    o = chunked.outcomes.first()
    # The identity URL of most entries is not what a document calls itself, so the plain URL decides.
    assert (o.documents_processed, o.missing_documents, o.failed_documents) == (6, 0, 0)
    tables.write_chunks(chunked.chunks, f"{out}/chunks")
    chunks = tables.read_chunks(spark, f"{out}/chunks")
    s = chunked.statistics.first()
    assert s.unique_chunks == chunks.count() and s.raw_chunks == s.unique_chunks + s.duplicate_chunks
    points = embed_corpus(chunks, HashedWords(EmbedConfig(dimension=8)))
    path = f"{out}/points"
    P.write_points(points, path, 8)
    assert P.verify_points(spark, path, 8, chunks.count()).first().points == chunks.count()
    P.upsert_points(points, path)
    P.verify_points(spark, path, 8, chunks.count())
    changed = points.limit(2).withColumn("title", F.lit("changed"))
    P.upsert_points(changed, path)
    again = P.read_points(spark, path)
    assert again.count() == chunks.count() and again.filter("title = 'changed'").count() == 2
    assert P.health(spark, path).first().status == "healthy"
    assert P.health(spark, f"{out}/nowhere").first().status == "not_ready"
    with pytest.raises(RuntimeError, match="does not match"):
        P.verify_points(spark, path, 8, 1)
    with pytest.raises(RuntimeError, match="dimensions"):
        P.verify_points(spark, path, 9)


def test_indexing_checks_what_is_stored(spark, tmp_path):
    rows = [(f"c{i}", f"h{i}", "t", [1.0, float(i)]) for i in range(4)] + [("c0", "h0", "later", [1.0, 9.0])]
    points = P.build_points(spark.createDataFrame(
        rows, "chunk_id string, chunk_hash string, text string, embedding array<float>"), 2)
    path = str(tmp_path / "points")
    assert P.index_points(points, path, 2).first().points == 4
    assert P.index_points(points.filter("chunk_id = 'c1'"), path, 2, rebuild=False).first().points == 4
    assert P.read_points(spark, path).columns == points.columns
    with pytest.raises(RuntimeError, match="dimension mismatch"):
        P.index_points(points, path, 3, rebuild=False)
    P.describe_table(spark, path, 2, "dot")
    with pytest.raises(RuntimeError, match="distance mismatch"):
        P.index_points(points, path, 2, rebuild=False)


def test_manifest_file_shapes(spark, tmp_path):
    row = {"file": "a.json", "status": "valid", "errors": [], "document_id": "d1", "canonical_url": "c", "url": "u"}
    for name, body in (("o.json", {"manifest_version": "1.0", "documents": [row, row]}), ("l.json", [row, row])):
        (tmp_path / name).write_text(json.dumps(body, indent=1))
        got = tables.read_manifest(spark, str(tmp_path / name))
        assert [(r.document_id, r.url) for r in got.collect()] == [("d1", "u")] * 2
    (tmp_path / "e.json").write_text('{"documents": []}')
    with pytest.raises(ValueError, match="no documents"):
        tables.read_manifest(spark, str(tmp_path / "e.json"))


def test_document_and_embedding_files(spark, tmp_path):
    docs = spark.createDataFrame([doc("https://h.example/a")], DOCUMENT)
    tables.write_documents(docs, str(tmp_path / "docs"))
    back = tables.read_documents(spark, str(tmp_path / "docs")).first()
    assert back.file.startswith("a__") and back.file.endswith(".json") and back.sections[0].word_count == 30
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.json").write_text("{broken\n")
    with pytest.raises(Exception):
        tables.read_chunks(spark, str(tmp_path / "bad")).collect()


def test_last_new_point_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, at int")
    assert sorted(map(tuple, P.latest_points(old, new, "at").collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_payload_defaults_and_checks(spark):
    rows = spark.createDataFrame([("c1", "h1", "t", [1.0, 0.0])], "chunk_id string, chunk_hash string, text string, embedding array<float>")
    p = P.build_points(rows, 2).first()
    assert (p.page_type, p.url, p.section_index, p.word_count, p.embedding_model) == ("general", "", 0, 0, "")
    with pytest.raises(Exception, match="dimensions"):
        P.build_points(rows, 3).collect()


def _entry(file, document_id, url):
    return (file, document_id, "h", url, url)


def test_a_blank_id_fails_by_itself(spark):
    manifest = spark.createDataFrame(
        [_entry("a", "", "https://h/1"), _entry("b", "doc_x", "https://h/1"), _entry("c", None, "https://h/2"), _entry("d", "doc_z", "https://h/3")],
        "file string, document_id string, content_hash string, canonical_url string, url string")
    docs = spark.createDataFrame([(f"f{i}", f"https://h/{i}", "") for i in (1, 2)], "file string, url string, canonical_url string")
    entries = resolve_entries(manifest, docs)
    assert tuple(entry_outcomes(entries).first()) == (1, 1, 2)
    kept = manifest_documents(entries, docs).collect()
    assert [(r.file, r.document_id, r.position, r.copies) for r in kept] == [("f1", "doc_x", "b", 1)]


def test_many_hot_keys_are_all_spread(spark):
    rows = [(k, i) for k in range(40) for i in range(30)] + [(100 + k, 0) for k in range(50)]
    left = spark.createDataFrame(rows, "k int, i int")
    unique = spark.createDataFrame([(k, f"v{k}") for k in range(160)], "k int, v string")
    for marked in (100_000, 7):
        joined = join_unique(left, unique, "k", "i", hot_rows=10, marked_keys=marked)
        assert sorted((r.k, r.i, r.v) for r in joined.collect()) == sorted((k, i, f"v{k}") for k, i in rows)
    plan = joined._jdf.queryExecution().toString()
    assert "_salt" in plan and "BroadcastHashJoin" in plan


def _points(spark, rows):
    return P.build_points(spark.createDataFrame(
        rows, "document_id string, chunk_id string, chunk_hash string, text string, title string, embedding array<float>"), 2)


def test_upserts_add_files_and_replace_documents(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(f"d{i % 5}", f"c{i}", f"h{i}", "t", "old", [1.0, float(i)]) for i in range(40)]
    P.index_points(_points(spark, rows), path, 2)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "points").rglob("*.parquet")}
    P.upsert_points(_points(spark, [("d1", "c1", "h1", "t", "new", [5.0, 5.0])]), path)
    assert {p: p.stat().st_mtime_ns for p in before} == before
    shown = {r.chunk_id: r.title for r in P.read_points(spark, path).collect()}
    assert len(shown) == 40 and shown["c1"] == "new" and shown["c2"] == "old"
    P.upsert_points(_points(spark, [("d1", "c99", "h99", "t", "again", [1.0, 1.0])]), path, replace_documents=True)
    left = P.read_points(spark, path).collect()
    assert [r.chunk_id for r in left if r.document_id == "d1"] == ["c99"] and len(left) == 33
    P.upsert_points(_points(spark, [(f"e{i}", f"e{i}", f"e{i}", "t", "x", [1.0, 0.0]) for i in range(30)]), path)
    assert [p.kind for p in P.table_description(spark, path).parts] == ["base"]
    P.drop_old_versions(spark, path)
    assert P.read_points(spark, path).count() == 63
    assert len([p for p in (tmp_path / "points").iterdir() if p.name.startswith("data-")]) == 1


def test_a_large_delta_of_new_rows_becomes_a_base_folder(spark, tmp_path):
    """Stored rows are written again only where an id or a document of them is replaced."""
    path = str(tmp_path / "points")

    def add(names, title, **more):
        P.upsert_points(_points(spark, [(d, c, c, "t", title, [1.0, 0.0]) for d, c in names]), path, **more)

    def kinds():
        return [p.kind for p in P.table_description(spark, path).parts]

    P.index_points(_points(spark, [(f"d{i}", f"c{i}", f"c{i}", "t", "old", [1.0, 0.0]) for i in range(10)]), path, 2)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "points").rglob("*.parquet")}
    add([(f"e{i}", f"e{i}") for i in range(6)] * 2, "new", replace_documents=True)
    assert kinds() == ["base", "base"]
    P.drop_old_versions(spark, path)
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert sorted(r.chunk_id for r in P.read_points(spark, path).collect()) == sorted([f"c{i}" for i in range(10)] + [f"e{i}" for i in range(6)])
    # A few rows stay a delta; many that replace an id, or a document, are folded in.
    add([("f0", "f0")], "new")
    assert kinds() == ["base", "base", "delta"]
    add([("d1", "c1"), *((f"g{i}", f"g{i}") for i in range(5))], "again")
    assert kinds() == ["base"]
    add([("g1", "x1"), *((f"h{i}", f"h{i}") for i in range(7))], "more", replace_documents=True)
    assert kinds() == ["base"]
    shown = {r.chunk_id: r.title for r in P.read_points(spark, path).collect()}
    assert len(shown) == 10 + 6 + 1 + 5 - 1 + 8 and shown["c1"] == "again" and "g1" not in shown and shown["x1"] == "more"


def test_passages_pass_on_while_ids_come_again(spark, tmp_path):
    path = str(tmp_path / "points")

    def rows(*passages):
        return P.build_points(spark.createDataFrame(
            [(d, f"{d}__{h}", h, "t", f"u/{d}", [1.0, 0.0], i) for d, h, i in passages],
            "document_id string, chunk_id string, chunk_hash string, text string, canonical_url string, embedding array<float>, chunk_index int"), 2)

    def shown():
        return sorted((r.document_id, r.chunk_hash) for r in P.read_points(spark, path).collect())

    first = rows(("a", "p", 0), ("a", "p", 1), ("a", "q", 2), ("b", "p", 0))
    replace_documents(first, first, path, 2)
    assert shown() == [("a", "p"), ("a", "q")]
    more = rows(("c", "p", 0), ("c", "r", 1), ("c", "r", 2), ("d", "s", 0))
    replace_documents(more, more, path, 2)
    assert shown() == [("a", "p"), ("a", "q"), ("c", "r"), ("d", "s")]
    again = rows(("a", "q", 0), ("a", "q", 1))
    replace_documents(again, again, path, 2)
    assert shown() == [("a", "q"), ("b", "p"), ("c", "r"), ("d", "s")]
    replace_documents(again.limit(0), rows(("b", "p", 0)), path, 2)
    assert shown() == [("a", "q"), ("c", "p"), ("c", "r"), ("d", "s")]


def test_a_write_that_failed_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "points")
    P.index_points(_points(spark, [("d", "c", "h", "t", "old", [1.0, 0.0])]), path, 2)
    (tmp_path / "points" / "data-unfinished").mkdir()
    (tmp_path / "points" / "_notes" / "2").mkdir()
    assert [r.title for r in P.read_points(spark, path).collect()] == ["old"]
    P.upsert_points(_points(spark, [("d", "c", "h", "t", "new", [1.0, 0.0])]), path)
    assert [r.title for r in P.read_points(spark, path).collect()] == ["new"]


def test_the_last_of_an_id_wins_or_a_rerun_agrees(spark):
    rows = [("x", i) for i in range(8)]
    new = spark.createDataFrame(rows, "id string, value int").repartition(4)
    old = new.limit(0)
    ordered = P.latest_points(old, new.withColumn("at", F.col("value")), "at")
    assert [r.value for r in ordered.collect()] == [7]
    assert P.latest_points(old, new).collect() == P.latest_points(old, new.repartition(7)).collect()


def test_missing_and_unreadable_paths_differ(spark, tmp_path):
    from pagelore.session import Scratch, path_exists

    assert not path_exists(spark, str(tmp_path / "nowhere")) and path_exists(spark, str(tmp_path))
    with pytest.raises(Exception, match="(?i)no filesystem|unsupported|scheme"):
        path_exists(spark, "nosuchscheme://host/x")
    with Scratch(spark, "check") as scratch:
        assert scratch.keep(spark.range(3)).count() == 3
        assert path_exists(spark, scratch.root)
    assert not path_exists(spark, scratch.root)


def test_one_count_finds_the_hot_keys_of_two_columns(spark):
    pairs = spark.createDataFrame([("h", f"u{i}") for i in range(30)] + [(f"c{i}", "h") for i in range(30)] + [("x", "y")], "a string, b string")
    hot = hot_keys(pairs, ["a", "b"], hot_rows=10)
    assert [tuple(r) for r in hot.collect()] == [("h", 24)]
    names = spark.createDataFrame([("h", 1), ("x", 2), ("u3", 3)], "key string, n int")
    got = join_unique(pairs, names.withColumnsRenamed({"key": "a", "n": "left_n"}), "a", "b", "left", 10, hot=hot)
    got = join_unique(got, names.withColumnsRenamed({"key": "b", "n": "right_n"}), "b", "a", "left", 10, hot=hot)
    found = {(r.a, r.b): (r.left_n, r.right_n) for r in got.collect()}
    assert len(found) == 61 and found["h", "u3"] == (1, 3) and found["c7", "h"] == (None, 1) and found["x", "y"] == (2, None)


def test_readiness_and_embedding_lines(spark, tmp_path):
    path = str(tmp_path / "points")
    assert tuple(P.readiness(P.health(spark, path)).first()) == (503, "not_ready", "no point table", None)
    P.index_points(_points(spark, [("d", "c", "h", "text", "title", [1.0, 0.0])]), path, 2)
    assert tuple(P.readiness(P.health(spark, path)).first()) == (200, "healthy", None, 1)
    row = spark.createDataFrame([("c1", [0.5, -0.25], None)], "chunk_id string, embedding array<float>, title string")
    tables.write_embeddings(row, str(tmp_path / "lines"), json=True)
    back = tables.read_embeddings(spark, str(tmp_path / "lines"), json=True).first()
    assert (back.chunk_id, back.embedding, back.title) == ("c1", [0.5, -0.25], None)
