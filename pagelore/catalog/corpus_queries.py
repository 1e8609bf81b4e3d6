"""Queries over validation, chunking, embedding and the point table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.catalog import sql as S
from pagelore.catalog.inputs import (
    DIMENSION,
    ENCODER,
    document_chunks,
    document_records,
    points,
    stored,
    table,
    text_table,
)
from pagelore.catalog.registry import query
from pagelore.config import ChunkConfig
from pagelore.functions.ids import sha256
from pagelore.functions.text import section_text
from pagelore.operators.chunking import (
    chunk_statistics,
    dedupe_chunks,
    merge_small_sections,
    word_windows,
)
from pagelore.operators.embedding import embed_chunks, embedding_report
from pagelore.operators.first_wins import repeated_groups
from pagelore.operators.holders import replace_documents
from pagelore.operators.points import (
    build_points, health, index_points, latest_points, read_points, readiness, upsert_points,
)
from pagelore.operators.validation import (
    build_manifest,
    entry_outcomes,
    manifest_documents,
    manifest_header,
    resolve_entries,
)
from pagelore.session import new_folder
from pagelore.sources import tables


def _manifest(spark, folder):
    return stored(spark, folder, "manifest", lambda s, f: build_manifest(document_records(s, f)))


_TOKENS = f"len(regexp_extract_all(text, '{S.WORD}'))"
_MISMATCH = f"word_count > 0 AND abs({_TOKENS} - word_count) > greatest(10, floor(word_count * 0.15::DOUBLE))"


@query(
    "validation_status",
    S.with_tables(
        "docs",
        f"""SELECT file, CASE WHEN word_count <= 0 OR {_MISMATCH} THEN 'warning' ELSE 'valid' END AS status,
      concat_ws('; ', CASE WHEN word_count <= 0 THEN 'document has zero words' END,
        CASE WHEN {_MISMATCH} THEN 'word_count mismatch: stored=' || word_count || ', calculated=' || {_TOKENS} END) AS errors,
      'doc_' || substr(sha256(canonical_url), 1, 24) AS document_id, canonical_url,
      len(string_split(text, chr(10)))::BIGINT AS section_count FROM docs""",
    ),
)
def _(spark, folder):
    return _manifest(spark, folder).select(
        "file", "status", F.array_join("errors", "; ").alias("errors"), "document_id", "canonical_url",
        F.col("section_count").cast("long").alias("section_count"),
    )


@query(
    "manifest_counts",
    S.with_tables(
        "docs",
        f"""SELECT count(*)::BIGINT AS documents_found, count(*)::BIGINT AS document_count, 0::BIGINT AS invalid_count,
      count(*) FILTER (WHERE word_count <= 0 OR {_MISMATCH})::BIGINT AS warning_count,
      0::BIGINT AS duplicate_url_count,
      (SELECT count(*) FROM (SELECT title, lang, {S.canonical('text')} FROM docs GROUP BY ALL HAVING count(*) > 1))::BIGINT AS duplicate_content_count
    FROM docs""",
    ),
)
def _(spark, folder):
    return manifest_header(_manifest(spark, folder)).drop("manifest_version", "schema_version", "hash_version")


@query(
    "duplicate_urls",
    """WITH d AS (SELECT 'https://kb.example.org/' || source || '/' || lang AS key, doc_id AS member FROM documents)
    SELECT key, member, count(*) OVER (PARTITION BY key)::BIGINT AS group_size FROM d
    QUALIFY count(*) OVER (PARTITION BY key) > 1""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    keyed = docs.select("doc_id", F.concat(F.lit("https://kb.example.org/"), "source", F.lit("/"), "lang").alias("u"))
    return repeated_groups(keyed, "u", "doc_id")


@query(
    "duplicate_content",
    f"""WITH d AS (SELECT sha256({S.canonical('text')}) AS key, doc_id AS member FROM documents)
    SELECT key, member, count(*) OVER (PARTITION BY key)::BIGINT AS group_size FROM d
    QUALIFY count(*) OVER (PARTITION BY key) > 1""",
)
def _(spark, folder):
    from pagelore.functions.text import canonical_lines

    docs = text_table(spark, folder)
    hashed = docs.select("doc_id", sha256(canonical_lines(F.col("text"))).alias("h"))
    return repeated_groups(stored(spark, folder, "content-hashes", lambda *_: hashed), "h", "doc_id")


# Labels are the manifest: some name a document by its own URL, the rest by its source
# page, to which the document with the greatest file name answers. Every entry comes twice,
# and the first of the two has a blank id where the quality is 0.
_MANIFEST = """
entries AS (
  SELECT lpad(l.doc_id::VARCHAR, 10, '0') || again AS file,
    CASE WHEN quality = 0 AND again = '' THEN '' ELSE 'doc_' || l.doc_id END AS document_id,
    CASE WHEN quality = 1 THEN 'https://kb.example.org/' || source || '/' || l.doc_id ELSE 'https://kb.example.org/none' END AS canonical_url,
    CASE WHEN toxic = 1 THEN 'https://kb.example.org/' || source ELSE 'https://kb.example.org/gone' END AS url
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (VALUES (''), ('-2')) AS r(again)
),
lookup AS (
  SELECT key, max(file) AS found FROM (SELECT url AS key, file FROM docs UNION ALL SELECT canonical_url, file FROM docs) GROUP BY key
),
resolved AS (
  SELECT e.*, coalesce(a.found, b.found) AS found_file FROM entries e
  LEFT JOIN lookup a ON a.key = e.canonical_url LEFT JOIN lookup b ON b.key = e.url
)"""


def _label_manifest(spark, folder):
    labels = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    labels = labels.withColumn("again", F.explode(F.array(F.lit(""), F.lit("-2"))))
    home = F.concat(F.lit("https://kb.example.org/"), F.col("source"))
    own = F.concat(home, F.lit("/"), F.col("doc_id").cast("string"))
    return labels.select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.col("again")).alias("file"),
        F.when((F.col("quality") == 0) & (F.col("again") == ""), "")
        .otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("document_id"),
        F.lit("").alias("content_hash"),
        F.when(F.col("quality") == 1, own).otherwise("https://kb.example.org/none").alias("canonical_url"),
        F.when(F.col("toxic") == 1, home).otherwise("https://kb.example.org/gone").alias("url"),
    )


@query(
    "manifest_join",
    S.with_tables("docs", "")
    + f""", {_MANIFEST}
    SELECT found_file AS file, min(file) AS position, arg_min(document_id, file) AS document_id,
      count(*)::BIGINT AS copies FROM resolved WHERE found_file IS NOT NULL AND document_id <> '' GROUP BY 1""",
)
def _(spark, folder):
    docs = document_records(spark, folder)
    found = manifest_documents(resolve_entries(_label_manifest(spark, folder), docs), docs)
    return found.select("file", "position", "document_id", F.col("copies").cast("long").alias("copies"))


@query(
    "manifest_missing",
    S.with_tables("docs", "")
    + f""", {_MANIFEST}
    SELECT canonical_url, url, count(*)::BIGINT AS copies FROM resolved WHERE found_file IS NULL GROUP BY 1, 2""",
)
def _(spark, folder):
    entries = resolve_entries(_label_manifest(spark, folder), document_records(spark, folder))
    missing = entries.filter("found_file is null")
    return missing.select(
        F.col("manifest_canonical_url").alias("canonical_url"), F.col("manifest_url").alias("url"), "copies"
    )


@query(
    "manifest_outcomes",
    S.with_tables("docs", "")
    + f""", {_MANIFEST}
    SELECT count(*) FILTER (WHERE found_file IS NOT NULL AND document_id <> '')::BIGINT AS documents_processed,
      count(*) FILTER (WHERE found_file IS NULL)::BIGINT AS missing_documents,
      count(*) FILTER (WHERE found_file IS NOT NULL AND document_id = '')::BIGINT AS failed_documents FROM resolved""",
)
def _(spark, folder):
    return entry_outcomes(resolve_entries(_label_manifest(spark, folder), document_records(spark, folder)))


@query(
    "word_windows",
    f"""WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
    c AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 260 THEN 1 ELSE ceil((len(ws) - 260) / 150.0)::BIGINT + 1 END AS n FROM w),
    p AS (SELECT doc_id, k, list_slice(ws, 150 * k + 1, CASE WHEN k = n - 1 THEN len(ws) ELSE 150 * k + 180 END) AS part
      FROM c, unnest(range(n)) AS r(k))
    SELECT doc_id, k AS window_index, sha256(array_to_string(part, ' ')) AS chunk_hash, len(part)::BIGINT AS word_count FROM p""",
)
def _(spark, folder):
    cut = text_table(spark, folder).select(
        "doc_id", F.posexplode_outer(word_windows(F.col("text"))).alias("window_index", "w")
    )
    return cut.filter("w is not null").select(
        "doc_id", F.col("window_index").cast("long").alias("window_index"),
        sha256(F.col("w.text")).alias("chunk_hash"), F.col("w.word_count").cast("long").alias("word_count"),
    )


@query(
    "section_merge",
    S.with_tables(
        "merged",
        """SELECT doc_id, section_index::BIGINT AS section_index, section, section_level::BIGINT AS section_level,
      sha256(array_to_string(ws, ' ')) AS text_hash, len(ws)::BIGINT AS word_count FROM merged""",
    ),
)
def _(spark, folder):
    merged = document_records(spark, folder).select(
        "doc_id", F.posexplode_outer(merge_small_sections(F.col("sections"), ChunkConfig())).alias("section_index", "m")
    )
    return merged.filter("m is not null").select(
        "doc_id", F.col("section_index").cast("long").alias("section_index"), F.col("m.heading").alias("section"),
        F.col("m.level").cast("long").alias("section_level"),
        sha256(F.array_join("m.words", " ")).alias("text_hash"),
        F.size("m.words").cast("long").alias("word_count"),
    )


_CHUNK_COLUMNS = ("section_index", "section_level", "chunk_index", "section_chunk_index", "word_count")


def _long(df, *names):
    return df.select(
        *[F.col(c).cast("long").alias(c) if c in _CHUNK_COLUMNS else F.col(c) for c in names]
    )


_CHUNK_SELECT = """SELECT document_id, document_id || '__' || substr(chunk_hash, 1, 16) AS chunk_id, url, canonical_url,
  title, section, section_index::BIGINT AS section_index, section_level::BIGINT AS section_level,
  chunk_index::BIGINT AS chunk_index, section_chunk_index::BIGINT AS section_chunk_index, text, word_count::BIGINT AS word_count"""
_SHOWN = (
    "document_id", "chunk_id", "url", "canonical_url", "title", "section", "section_index",
    "section_level", "chunk_index", "section_chunk_index", "text", "word_count",
)


@query("chunk_table", S.with_tables("chunks", f"{_CHUNK_SELECT} FROM chunks"))
def _(spark, folder):
    return _long(document_chunks(spark, folder), *_SHOWN)


@query("chunk_dedup", S.with_tables("unique_chunks", f"{_CHUNK_SELECT} FROM unique_chunks"))
def _(spark, folder):
    return _long(dedupe_chunks(document_chunks(spark, folder)), *_SHOWN)


@query(
    "chunk_stats",
    S.with_tables(
        "unique_chunks",
        """SELECT (SELECT count(*) FROM chunks)::BIGINT AS raw_chunks, count(*)::BIGINT AS unique_chunks,
      round(avg(word_count), 6) AS average_words, count(*) FILTER (WHERE word_count < 20)::BIGINT AS tiny_chunks,
      count(*) FILTER (WHERE word_count > 260)::BIGINT AS oversized_chunks,
      ((SELECT count(*) FROM chunks) - count(*))::BIGINT AS duplicate_chunks FROM unique_chunks""",
    ),
)
def _(spark, folder):
    every = stored(spark, folder, "chunks", lambda s, f: document_chunks(s, f))
    stats = chunk_statistics(every, dedupe_chunks(every))
    return stats.withColumn("average_words", F.round("average_words", 6))


@query(
    "embed_chunks",
    S.with_tables(
        "point_vectors",
        """SELECT p.chunk_id, v.bucket, round(f, 6) AS value FROM point_vectors_floats v JOIN points p ON p.id = v.id""",
    ),
)
def _(spark, folder):
    chunks = dedupe_chunks(document_chunks(spark, folder)).drop("position")
    embedded = embed_chunks(chunks, ENCODER).select("chunk_id", F.posexplode("embedding").alias("bucket", "value"))
    return embedded.filter("value <> 0").select(
        "chunk_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query(
    "embedding_validate",
    f"""SELECT count(*)::BIGINT AS records, (count(*) - count(DISTINCT vec_id))::BIGINT AS repeated_ids,
      count(*) FILTER (WHERE len(embedding) <> {DIMENSION})::BIGINT AS wrong_size,
      count(*) FILTER (WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0)::BIGINT AS not_finite FROM embeddings""",
)
def _(spark, folder):
    return embedding_report(table(spark, folder, "embeddings"), DIMENSION, key="vec_id")


@query(
    "point_table",
    S.with_tables(
        "points",
        """SELECT id, chunk_id, document_id, chunk_hash, url, canonical_url, title, 'general' AS page_type, section,
      chunk_index::BIGINT AS chunk_index, word_count::BIGINT AS word_count, text FROM points""",
    ),
)
def _(spark, folder):
    return points(spark, folder).select(
        "id", "chunk_id", "document_id", "chunk_hash", "url", "canonical_url", "title", "page_type", "section",
        F.col("chunk_index").cast("long").alias("chunk_index"), F.col("word_count").cast("long").alias("word_count"),
        "text",
    )


@query(
    "upsert_points",
    """WITH old AS (SELECT doc_id AS id, 'stored' AS state, n_chars AS value FROM documents),
    new AS (SELECT doc_id AS id, 'labelled' AS state, quality::BIGINT AS value FROM labels
      UNION ALL SELECT -item_id - 1, 'benchmark', length(text) FROM benchmark),
    both_sides AS (SELECT *, 1 AS s FROM new UNION ALL SELECT *, 0 FROM old)
    SELECT id, state, value::BIGINT AS value FROM both_sides QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1""",
)
def _(spark, folder):
    old = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.lit("stored").alias("state"), F.col("n_chars").alias("value")
    )
    labelled = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.lit("labelled").alias("state"), F.col("quality").cast("long").alias("value")
    )
    added = table(spark, folder, "benchmark").select(
        (-F.col("item_id") - 1).alias("id"), F.lit("benchmark").alias("state"), F.length("text").cast("long").alias("value")
    )
    return latest_points(old, labelled.unionByName(added))


@query(
    "section_text",
    S.with_tables("lines_of", "")
    + f""", t AS (
      SELECT doc_id, i, CASE WHEN i > 0 THEN {S.clean('line')} WHEN {S.clean('line')} = '' THEN title
        ELSE title || chr(10) || {S.clean('line')} || chr(10) || title || chr(10) || {S.clean('line')} END AS section FROM lines_of)
    SELECT doc_id, sha256(string_agg(section, chr(1) ORDER BY i)) AS sections_hash, count(*)::BIGINT AS sections FROM t GROUP BY 1""",
)
def _(spark, folder):
    texts = F.transform("sections", lambda s: section_text(s))
    return document_records(spark, folder).select(
        "doc_id",
        sha256(F.array_join(texts, "\x01")).alias("sections_hash"),
        F.size("sections").cast("long").alias("sections"),
    )


@query(
    "document_files",
    S.with_tables(
        "docs",
        """SELECT regexp_replace(source || '__' || doc_id, '[^a-z0-9_]', '_', 'g') || '__' || substr(sha256(canonical_url), 1, 16) || '.json' AS file,
      canonical_url AS url, title, len(string_split(text, chr(10)))::BIGINT AS sections, sha256(text) AS content_hash FROM docs""",
    ),
)
def _(spark, folder):
    """Documents written as JSON lines and read back."""
    path = new_folder(spark, "document-files")
    docs = document_records(spark, folder).drop("file", "doc_id").withColumn("url", F.col("canonical_url"))
    tables.write_documents(docs, path)
    return tables.read_documents(spark, path).select(
        "file", "url", "title", F.size("sections").cast("long").alias("sections"), sha256(F.col("content")).alias("content_hash")
    )


@query("chunk_files", S.with_tables("chunks", f"{_CHUNK_SELECT} FROM chunks"))
def _(spark, folder):
    """Chunks written as JSON lines and read back with their required fields checked."""
    path = new_folder(spark, "chunk-files")
    tables.write_chunks(document_chunks(spark, folder).drop("position"), path)
    return _long(tables.read_chunks(spark, path), *_SHOWN)


@query(
    "embedding_files",
    S.with_tables(
        "chunks",
        f"""SELECT document_id || '__' || substr(chunk_hash, 1, 16) AS chunk_id, url, {DIMENSION}::BIGINT AS dimension,
      word_count::BIGINT AS word_count, text FROM chunks""",
    ),
)
def _(spark, folder):
    """Chunks with their vectors written as JSON lines and read back."""
    path = new_folder(spark, "embedding-files")
    tables.write_embeddings(embed_chunks(document_chunks(spark, folder).drop("position"), ENCODER), path, json=True)
    read = tables.read_embeddings(spark, path, json=True)
    return read.select(
        "chunk_id", "url", F.size("embedding").cast("long").alias("dimension"), F.col("word_count").cast("long").alias("word_count"), "text"
    )


@query(
    "point_readiness",
    S.with_tables(
        "points",
        """SELECT 200::INTEGER AS status_code, 'healthy' AS status, NULL::VARCHAR AS detail, count(*)::BIGINT AS points FROM points
    UNION ALL SELECT 503, 'not_ready', 'no point table', NULL""",
    ),
)
def _(spark, folder):
    """What a request would meet: a freshly built point table, and none."""
    path = new_folder(spark, "point-files")
    index_points(points(spark, folder), path, DIMENSION)
    return readiness(health(spark, path)).unionByName(readiness(health(spark, f"{path}-none")))


@query(
    "point_files",
    S.with_tables("points", "SELECT id, chunk_id, url, CASE WHEN source_row THEN 'again' ELSE title END AS title FROM (SELECT *, section_level = 1 AS source_row FROM points)"),
)
def _(spark, folder):
    """The point table written, partly replaced by an upsert, and read back."""
    path = new_folder(spark, "point-files")
    index_points(points(spark, folder), path, DIMENSION)
    changed = points(spark, folder).filter("section_level = 1").withColumn("title", F.lit("again"))
    index_points(changed, path, DIMENSION, rebuild=False)
    return read_points(spark, path).select("id", "chunk_id", "url", "title")


@query(
    "point_replace",
    S.with_tables(
        "points",
        """SELECT id, chunk_id, url, CASE WHEN changed THEN 'again' ELSE title END AS title
    FROM (SELECT *, substr(document_id, 5, 1) < '8' AS changed FROM points) WHERE NOT changed OR chunk_index = 0""",
    ),
)
def _(spark, folder):
    """New versions of half the documents, each with its first chunk only: no other of their chunks is left."""
    path = new_folder(spark, "point-files")
    index_points(points(spark, folder), path, DIMENSION)
    changed = points(spark, folder).filter(F.substring("document_id", 5, 1) < "8")
    fresh = changed.filter("chunk_index = 0").withColumn("title", F.lit("again"))
    upsert_points(fresh, path, replaced=changed.select("document_id").distinct())
    return read_points(spark, path).select("id", "chunk_id", "url", "title")


@query(
    "manifest_warnings",
    S.with_tables("docs", f"SELECT file, url, word_count FROM docs WHERE word_count <= 0 OR {_MISMATCH}"),
)
def _(spark, folder):
    warned = _manifest(spark, folder).filter("status = 'warning'")
    return warned.select("file", "url", F.col("word_count").cast("long").alias("word_count"))


@query(
    "point_verify",
    S.with_tables("points", "SELECT count(*)::BIGINT AS points, 0::BIGINT AS wrong_size FROM points"),
)
def _(spark, folder):
    """The status row of a freshly built point table."""
    path = new_folder(spark, "point-files")
    return index_points(points(spark, folder), path, DIMENSION)


@query(
    "stream_replace",
    S.with_tables(
        "chunks",
        f"""SELECT {S.uuid5('chunk_id')} AS id, chunk_id, document_id, chunk_hash FROM (
      SELECT *, document_id || '__' || substr(chunk_hash, 1, 16) AS chunk_id,
        CASE WHEN substr(document_id, 5, 1) < '4' THEN 2 WHEN substr(document_id, 5, 1) < 'a' THEN 0 ELSE 1 END AS arrival FROM chunks)
    WHERE (arrival < 2 OR chunk_index = 0) AND substr(document_id, 5, 1) <> '5'
    QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY arrival, canonical_url, document_id, chunk_index) = 1""",
    ),
)
def _(spark, folder):
    """Documents in three batches; the last one brings some again with their first passage only, and empties others."""
    path = new_folder(spark, "point-files")
    every = build_points(embed_chunks(document_chunks(spark, folder).drop("position"), ENCODER), DIMENSION)
    every = stored(spark, folder, "passages", lambda s, f: every)
    digit = F.substring("document_id", 5, 1)
    shorter = every.filter((digit < "4") & (F.col("chunk_index") == 0))
    for new in (every.filter(digit < "a"), every.filter(digit >= "a"), shorter):
        replace_documents(new, every.filter((digit < "4") | (digit == "5")) if new is shorter else new, path, DIMENSION)
    return read_points(spark, path).select("id", "chunk_id", "document_id", "chunk_hash")
