"""Documents to manifest rows: status, identity and content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.config import CrawlConfig
from pagelore.functions.arrays import let
from pagelore.functions.ids import HASH_VERSION, content_fingerprint, document_id
from pagelore.functions.text import clean_text, count_word_tokens
from pagelore.functions.urls import identity_url, port_of, url_parts
from pagelore.operators.first_wins import repeated_groups
from pagelore.operators.joins import HOT_ROWS, hot_keys, join_unique
from pagelore.schemas import HEADING, LINK, SCHEMA_VERSION, SECTION

MANIFEST_VERSION = "1.0"
MANIFEST_SCHEMA_VERSION = "2.0"

_DEFAULTS = {
    "schema_version": ("string", SCHEMA_VERSION), "canonical_url": ("string", ""),
    "title": ("string", ""), "description": ("string", ""), "page_type": ("string", "general"),
    "content": ("string", ""), "word_count": ("int", 0), "status_code": ("int", 200),
    "encoding": ("string", ""),
}
_ARRAYS = {"headings": HEADING, "sections": SECTION, "links": LINK}


def with_defaults(documents: DataFrame) -> DataFrame:
    """Absent or NULL document fields get the default of the document schema."""
    have = set(documents.columns)
    filled = {}
    for name, (kind, value) in _DEFAULTS.items():
        given = F.col(name) if name in have else F.lit(None)
        filled[name] = F.coalesce(given.cast(kind), F.lit(value).cast(kind))
    for name, item in _ARRAYS.items():
        empty = F.array().cast(f"array<{item}>")
        filled[name] = F.coalesce(F.col(name), empty) if name in have else empty
    return documents.withColumns(filled)


def word_count_differs(stored: Column, calculated: Column) -> Column:
    allowed = F.greatest(F.lit(10), F.floor(stored * F.lit(0.15)).cast("int"))
    return (stored > 0) & (F.abs(calculated - stored) > allowed)


def document_errors(doc: dict[str, Column] | None = None) -> Column:
    """What is wrong with a readable document, as an array of messages."""
    c = doc or {n: F.col(n) for n in ("url", "title", "sections", "word_count", "content")}
    calculated = count_word_tokens(c["content"])

    def messages(n: Column) -> Column:
        stored = c["word_count"]
        return F.array_compact(
            F.array(
                F.when(c["url"] == "", F.lit("missing url")),
                F.when(c["title"] == "", F.lit("missing title")),
                F.when(F.size(c["sections"]) == 0, F.lit("document has no sections")),
                F.when(stored <= 0, F.lit("document has zero words")),
                F.when(
                    word_count_differs(stored, n),
                    F.format_string("word_count mismatch: stored=%d, calculated=%d", stored, n),
                ),
            )
        )

    return let(calculated, messages)


def _unreadable(documents: DataFrame, identity: Column) -> Column:
    """Why a document cannot be processed at all; NULL for a readable one."""
    reasons = []
    if "_corrupt_record" in documents.columns:
        reasons.append(F.when(F.col("_corrupt_record").isNotNull(), F.lit("JSONDecodeError: malformed document")))
    required = (
        F.col("url").isNull()
        | F.exists("headings", lambda h: h["level"].isNull() | h["text"].isNull())
        | F.exists("links", lambda k: k["url"].isNull())
    )
    reasons.append(F.when(required, F.lit("Field required")))
    source = F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("url"))
    port = port_of(url_parts(source)["netloc"])
    number = F.concat(F.lit("ValueError: Port could not be cast to integer value as '"), port, F.lit("'"))
    reasons.append(
        F.when(
            identity.isNull(),
            F.when(port.rlike("^[0-9]+$"), F.lit("ValueError: Port out of range 0-65535")).otherwise(number),
        )
    )
    return F.coalesce(*reasons)


def build_manifest(documents: DataFrame, site: CrawlConfig | None = None) -> DataFrame:
    """One manifest row per document; ``file`` names it and orders the manifest.

    A document that cannot be read is ``invalid`` and carries only its errors; one
    that breaks a rule is a ``warning`` and stays part of the corpus.
    """
    docs = with_defaults(documents)
    identity = F.col("_identity")
    docs = docs.withColumn(
        "_identity",
        identity_url(
            F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("url")), site
        ),
    )
    docs = docs.withColumn("_reason", _unreadable(docs, identity))
    good = F.col("_reason").isNull()
    errors = F.when(good, document_errors()).otherwise(F.array("_reason"))
    checked = docs.withColumn("errors", errors)

    def known(value: Column, name: str) -> Column:
        return F.when(good, value).alias(name)

    return checked.select(
        "file",
        F.when(~good, F.lit("invalid"))
        .when(F.size("errors") == 0, F.lit("valid"))
        .otherwise(F.lit("warning"))
        .alias("status"),
        "errors",
        known(document_id(identity), "document_id"),
        known(identity, "canonical_url"),
        known(F.col("url"), "url"),
        known(F.col("title"), "title"),
        known(F.col("page_type"), "page_type"),
        known(F.col("schema_version"), "schema_version"),
        known(F.lit(HASH_VERSION), "hash_version"),
        known(content_fingerprint(F.col("title"), F.col("description"), F.col("sections")), "content_hash"),
        known(F.col("word_count"), "word_count"),
        known(F.size("sections"), "section_count"),
        known(F.size("links"), "link_count"),
    )


def usable_entries(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("status").isin("valid", "warning"))


def duplicate_members(manifest: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files that share a canonical URL or a content hash, one row each."""
    return repeated_groups(usable_entries(manifest), column, "file", hot_rows)


def manifest_header(manifest: DataFrame) -> DataFrame:
    """One row of counters over the manifest."""
    usable = usable_entries(manifest)

    def repeated(column: str, name: str) -> DataFrame:
        sizes = usable.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.count_if(F.col("n") > 1).alias(name)).withColumn("one", F.lit(1))

    counts = manifest.agg(
        F.count(F.lit(1)).alias("documents_found"),
        F.count_if(F.col("status") != "invalid").alias("document_count"),
        F.count_if(F.col("status") == "invalid").alias("invalid_count"),
        F.count_if(F.col("status") == "warning").alias("warning_count"),
    ).withColumn("one", F.lit(1))
    # Three one-row aggregates side by side.
    joined = counts.join(repeated("canonical_url", "duplicate_url_count"), "one").join(
        repeated("content_hash", "duplicate_content_count"), "one"
    )
    return joined.select(
        F.lit(MANIFEST_VERSION).alias("manifest_version"),
        F.lit(MANIFEST_SCHEMA_VERSION).alias("schema_version"),
        F.lit(HASH_VERSION).alias("hash_version"),
        "documents_found", "document_count", "invalid_count", "warning_count",
        "duplicate_url_count", "duplicate_content_count",
    )


def document_lookup(documents: DataFrame) -> DataFrame:
    """(key, found_file): which file answers to a URL; the greatest file name wins."""
    keys = F.array_distinct(F.array(clean_text(F.col("url")), clean_text(F.col("canonical_url"))))
    listed = documents.select(F.col("file"), F.explode_outer(keys).alias("key"))
    return (
        listed.filter(F.col("key") != "").groupBy("key").agg(F.max("file").alias("found_file"))
    )


def shadowed_files(documents: DataFrame) -> DataFrame:
    """Documents that no URL leads to, because another file answers to theirs."""
    reached = document_lookup(documents).select(F.col("found_file").alias("file")).distinct()
    return documents.select("file", "url", "canonical_url").join(reached, "file", "left_anti")


def resolve_entries(manifest: DataFrame, documents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Manifest entries with ``found_file``: by canonical URL, else by URL, else NULL.

    Entries with the same pair of URLs resolve alike, so each pair is looked up once. The
    first entry in manifest order that has a document id represents it: an entry with a
    blank id fails by itself and takes no other with it. ``copies`` counts all entries
    of the pair, ``usable_copies`` those with an id.
    """
    usable = F.coalesce(F.col("document_id"), F.lit("")) != ""
    # Rows without an order value take no part in min_by.
    place = F.when(usable, F.col("file"))
    pairs = manifest.groupBy(
        clean_text(F.col("canonical_url")).alias("canonical_key"),
        clean_text(F.col("url")).alias("url_key"),
    ).agg(
        F.coalesce(F.min(place), F.min("file")).alias("position"),
        F.min_by(F.struct("document_id", "content_hash"), place).alias("_first"),
        F.coalesce(F.min_by("canonical_url", place), F.min_by("canonical_url", "file")).alias("manifest_canonical_url"),
        F.coalesce(F.min_by("url", place), F.min_by("url", "file")).alias("manifest_url"),
        F.count(F.lit(1)).alias("copies"),
        F.count_if(usable).alias("usable_copies"),
    )
    lookup = document_lookup(documents)
    by_canonical = lookup.select(F.col("key").alias("canonical_key"), F.col("found_file").alias("_by_canonical"))
    by_url = lookup.select(F.col("key").alias("url_key"), F.col("found_file").alias("_by_url"))
    hot = hot_keys(pairs, ["canonical_key", "url_key"], hot_rows)
    found = join_unique(pairs, by_canonical, "canonical_key", "url_key", "left", hot_rows, hot=hot)
    found = join_unique(found, by_url, "url_key", "canonical_key", "left", hot_rows, hot=hot)
    return found.select(
        "position",
        F.col("_first.document_id").alias("document_id"),
        F.col("_first.content_hash").alias("content_hash"),
        "manifest_canonical_url",
        "manifest_url",
        "copies",
        "usable_copies",
        F.coalesce("_by_canonical", "_by_url").alias("found_file"),
    )


def manifest_documents(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Document content next to the first manifest entry that leads to it.

    Several entries may lead to one document. All but the first would only yield
    repeated chunks, so the content is read, and later chunked, once; ``copies``
    remembers how often it was asked for.
    """
    usable = entries.filter(F.col("found_file").isNotNull() & (F.col("usable_copies") > 0))
    wanted = usable.groupBy(F.col("found_file").alias("file")).agg(
        F.min("position").alias("position"),
        F.min_by(
            F.struct("document_id", "content_hash", "manifest_canonical_url"), F.col("position")
        ).alias("_entry"),
        F.sum("usable_copies").alias("copies"),
    )
    return documents.join(wanted, "file").select("*", "_entry.*").drop("_entry")


def entry_outcomes(entries: DataFrame) -> DataFrame:
    """One row: how many manifest entries were processed, missing, or failed."""
    found = F.col("found_file").isNotNull()

    def total(count: Column, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, count)), F.lit(0)).cast("long")

    return entries.agg(
        total(F.col("usable_copies"), found).alias("documents_processed"),
        total(F.col("copies"), ~found).alias("missing_documents"),
        total(F.col("copies") - F.col("usable_copies"), found).alias("failed_documents"),
    )
