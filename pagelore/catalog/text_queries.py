"""Queries over text, URL and identity functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.catalog import sql as S
from pagelore.catalog.inputs import SITE, document_records, table, text_table
from pagelore.catalog.registry import query
from pagelore.functions import ids, text, urls
from pagelore.operators.first_wins import first_per_key
from pagelore.operators.validation import word_count_differs


@query("clean_text", f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def _(spark, folder):
    return text_table(spark, folder).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("sentence_spacing", f"SELECT doc_id, {S.spaced('text')} AS spaced FROM documents")
def _(spark, folder):
    return text_table(spark, folder).select("doc_id", text.space_sentences(F.col("text")).alias("spaced"))


@query(
    "hash_normalize_text",
    f"""SELECT doc_id, sha256({S.canonical('text')}) AS canonical_hash, sha256({S.clean('text')}) AS text_hash
    FROM documents""",
)
def _(spark, folder):
    return text_table(spark, folder).select(
        "doc_id",
        ids.sha256(text.canonical_lines(F.col("text"))).alias("canonical_hash"),
        ids.text_hash(F.col("text")).alias("text_hash"),
    )


@query(
    "lexical_tokens",
    f"""SELECT doc_id, {S.lexical('text')} AS form,
      len(list_distinct({S.tokens('text')}))::BIGINT AS distinct_tokens FROM documents""",
)
def _(spark, folder):
    return text_table(spark, folder).select(
        "doc_id",
        text.lexical_form(F.col("text")).alias("form"),
        F.size(text.lexical_tokens(F.col("text"))).cast("long").alias("distinct_tokens"),
    )


@query(
    "word_counts",
    f"""WITH n AS (SELECT doc_id, len({S.words('text')})::BIGINT AS words,
        len(regexp_extract_all(text, '{S.WORD}'))::BIGINT AS tokens FROM documents)
    SELECT doc_id, words, tokens, words > 0 AND abs(tokens - words) > greatest(10, floor(words * 0.15::DOUBLE)) AS differs
    FROM n""",
)
def _(spark, folder):
    counted = text_table(spark, folder).select(
        "doc_id",
        text.count_words(F.col("text")).cast("long").alias("words"),
        text.count_word_tokens(F.col("text")).cast("long").alias("tokens"),
    )
    return counted.withColumn("differs", word_count_differs(F.col("words"), F.col("tokens")))


@query(
    "consecutive_line_dedup",
    f"""WITH l AS (
      SELECT doc_id, i, {S.spaced('line')} AS line FROM (
        SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line
        FROM documents, unnest(range(len(string_split(text, chr(10))))) AS u(i))),
    kept AS (
      SELECT doc_id, i, line FROM l WHERE line <> ''
      QUALIFY line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY i))
    SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS lines, count(line)::BIGINT AS n_lines
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, folder):
    kept = text_table(spark, folder).select(
        "doc_id", text.drop_repeated_lines(F.split("text", "\n")).alias("kept")
    )
    return kept.select(
        "doc_id", F.array_join("kept", "\n").alias("lines"), F.size("kept").cast("long").alias("n_lines")
    )


@query(
    "ordered_line_dedup",
    """WITH l AS (
      SELECT doc_id, line, min(i) AS i FROM (
        SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line
        FROM documents, unnest(range(len(string_split(text, chr(10))))) AS u(i)) GROUP BY 1, 2)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM l GROUP BY 1""",
)
def _(spark, folder):
    return text_table(spark, folder).select(
        "doc_id", F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("lines")
    )


@query(
    "noise_lines",
    f"""WITH l AS (SELECT doc_id, {S.spaced("unnest(string_split(text, chr(10)))")} AS line FROM documents)
    SELECT doc_id, count(*)::BIGINT AS n_lines,
      count(*) FILTER (WHERE line = '' OR regexp_matches(lower(line), '^(next step|get started|contact us|let''?s talk|talk to us|have a related business challenge\\??|other services you may need\\.?|related services)$'))::BIGINT AS noise_headings,
      count(*) FILTER (WHERE regexp_matches(lower(line), '^(tell us what you''?re dealing with|we''?ll tell you honestly whether)'))::BIGINT AS noise_passages,
      count(*) FILTER (WHERE lower({S.clean('line')}) IN ('', 'skip to content', 'menu', 'close menu', 'open menu', 'cookie settings', 'privacy policy', 'terms of service'))::BIGINT AS ui_texts
    FROM l GROUP BY doc_id""",
)
def _(spark, folder):
    def count(test):
        return F.size(F.filter("lines", test)).cast("long")

    return text_table(spark, folder).select("doc_id", F.split("text", "\n").alias("lines")).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        count(text.is_noise_heading).alias("noise_headings"),
        count(text.is_noise_passage).alias("noise_passages"),
        count(text.is_ui_text).alias("ui_texts"),
    )


@query(
    "url_norm_crawl",
    f"""WITH p AS (SELECT page_id, {S.URL_PARTS} FROM pages)
    SELECT page_id, CASE WHEN scheme IN ('http', 'https')
        AND lower(regexp_extract(netloc, '([^@:]*)(?::[0-9]*)?$', 1)) IN ('{SITE.canonical_host}', '{SITE.bare_host}')
      THEN 'https://{SITE.canonical_host}' ||
        CASE WHEN rtrim(regexp_replace(path, '/+', '/', 'g'), '/') = '' THEN '/'
             ELSE rtrim(regexp_replace(path, '/+', '/', 'g'), '/') END ||
        CASE WHEN query = '' THEN '' ELSE '?' || query END
      ELSE '' END AS crawl_url FROM p""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.crawl_url(F.col("url"), SITE).alias("crawl_url"))


_DOCUMENT_URL = """scheme || '://' || lower(netloc) ||
  CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END"""


@query(
    "url_norm_extract",
    f"WITH p AS (SELECT page_id, {S.URL_PARTS} FROM pages) SELECT page_id, {_DOCUMENT_URL} AS document_url FROM p",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.document_url(F.col("url")).alias("document_url"))


@query(
    "url_norm_validate",
    f"""WITH p AS (SELECT page_id, {S.URL_PARTS} FROM pages)
    SELECT page_id, scheme || '://' || lower(netloc) ||
      CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END ||
      CASE WHEN query = '' THEN '' ELSE '?' || query END AS identity_url FROM p""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.identity_url(F.col("url")).alias("identity_url"))


@query(
    "url_filter",
    f"""WITH p AS (SELECT page_id, {S.URL_PARTS} FROM pages)
    SELECT page_id, scheme = 'https' AND lower(netloc) IN ('{SITE.canonical_host}', '{SITE.bare_host}')
      AND NOT regexp_matches(lower(path), '(?:{S.BLOCKED})$') AS crawlable FROM p""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.is_crawlable(F.col("url"), SITE).alias("crawlable"))


@query(
    "file_id",
    f"""WITH p AS (SELECT page_id, url, {S.URL_PARTS} FROM pages),
    r AS (SELECT page_id, url, CASE WHEN trim(path, '/') = '' THEN 'home'
      ELSE regexp_replace(replace(trim(path, '/'), '/', '__'), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') END AS readable FROM p)
    SELECT page_id, substr(readable, 1, 100) || '__' || substr(sha256(url), 1, 16) AS file_id FROM r""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", ids.file_id(F.col("url")).alias("file_id"))


@query(
    "document_id",
    "SELECT page_id, 'doc_' || substr(sha256(url), 1, 24) AS document_id FROM pages",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", ids.document_id(F.col("url")).alias("document_id"))


@query(
    "page_type",
    f"""WITH p AS (SELECT page_id, {S.URL_PARTS} FROM pages), q AS (SELECT page_id, trim(lower(path), '/') AS path FROM p)
    SELECT page_id, CASE WHEN path = '' THEN 'home' WHEN path = 'about' THEN 'about'
      WHEN path IN ('career', 'careers') THEN 'career' WHEN path = 'case-studies' THEN 'case-studies'
      WHEN path = 'contact' THEN 'contact' WHEN path = 'services' THEN 'services'
      WHEN starts_with(path, 'services/') THEN 'service' ELSE 'general' END AS page_type FROM q""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.page_type(F.col("url")).alias("page_type"))


@query(
    "content_fingerprint",
    S.with_tables("docs", "")
    + f""", s AS (
      SELECT doc_id, title, description, i, CASE WHEN i = 0 THEN title ELSE '' END AS heading,
        CASE WHEN i = 0 THEN 1 ELSE 0 END AS level, string_split(text, chr(10))[i + 1] AS line
      FROM docs, unnest(range(len(string_split(text, chr(10))))) AS u(i)),
    t AS (
      SELECT doc_id, title, description, i, '{{"bullets":[],"content":' || to_json({S.canonical("CASE WHEN heading = '' THEN line WHEN line = '' THEN heading ELSE heading || chr(10) || line END")})
        || ',"heading":' || to_json(heading) || ',"level":' || level
        || ',"paragraphs":[' || to_json({S.canonical('line')}) || ']}}' AS section FROM s)
    SELECT doc_id, sha256('{{"description":' || to_json(any_value(description)) || ',"sections":[' ||
      string_agg(section, ',' ORDER BY i) || '],"title":' || to_json(any_value(title)) || '}}') AS content_hash
    FROM t GROUP BY doc_id""",
)
def _(spark, folder):
    return document_records(spark, folder).select(
        "doc_id",
        ids.content_fingerprint(F.col("title"), F.col("description"), F.col("sections")).alias("content_hash"),
    )


@query("point_id", f"SELECT vec_id, {S.uuid5('vec_id::VARCHAR')} AS point_id FROM embeddings")
def _(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", ids.point_id(F.col("vec_id").cast("string")).alias("point_id")
    )


@query("iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", text.iso_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query(
    "latest_document_wins",
    f"""WITH p AS (SELECT page_id, url, {S.URL_PARTS} FROM pages),
    k AS (SELECT page_id, url, scheme || '://' || split_part(lower(netloc), '.', -2) || '.' || split_part(lower(netloc), '.', -1)
      || '/' || split_part(path, '/', 2) AS key FROM p)
    SELECT key, page_id, url FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id DESC) = 1""",
)
def _(spark, folder):
    parts = urls.url_parts(F.col("url"))
    pages = table(spark, folder, "pages").withColumn("p", parts)
    host = F.lower(F.col("p.netloc"))
    key = F.concat(
        F.col("p.scheme"), F.lit("://"), F.substring_index(host, ".", -2), F.lit("/"),
        F.split_part(F.col("p.path"), F.lit("/"), F.lit(2)),
    )
    return first_per_key(
        pages.select(key.alias("key"), "page_id", "url"), ["key"], [F.col("page_id").desc()]
    )
