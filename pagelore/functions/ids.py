"""Stable identities and content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions.arrays import let
from pagelore.functions.text import canonical_lines, clean_text, strip
from pagelore.functions.urls import url_path

HASH_VERSION = "v1"

# Fixed value: the name space of point ids.
POINT_NAMESPACE = "18cdedf0-5767-5b31-ac7d-80cc081446f0"

_RARE_CONTROLS = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def file_id(url: Column) -> Column:
    """File-system safe name of a URL: readable path plus a hash."""
    path = F.btrim(url_path(url), F.lit("/"))
    readable = F.when(path == "", F.lit("home")).otherwise(
        F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), r"[^\p{L}\p{N}_.\-]", "_")
    )
    return F.concat(
        F.substring(readable, 1, 100), F.lit("__"), F.substring(sha256(url), 1, 16)
    )


def document_id(canonical_url: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha256(canonical_url), 1, 24))


def text_hash(text: Column) -> Column:
    return sha256(clean_text(text))


def chunk_id(document: Column, chunk_hash: Column) -> Column:
    return F.concat(document, F.lit("__"), F.substring(chunk_hash, 1, 16))


def content_fingerprint(title: Column, description: Column, sections: Column) -> Column:
    """Hash of the compact, key-sorted JSON form of what a reader sees.

    Links are left out, so a changed menu does not change the fingerprint.
    """
    normal = F.transform(
        sections,
        lambda s: F.struct(
            F.transform(s["bullets"], canonical_lines).alias("bullets"),
            canonical_lines(s["content"]).alias("content"),
            canonical_lines(s["heading"]).alias("heading"),
            s["level"].alias("level"),
            F.transform(s["paragraphs"], canonical_lines).alias("paragraphs"),
        ),
    )
    text = F.to_json(
        F.struct(
            canonical_lines(description).alias("description"),
            normal.alias("sections"),
            canonical_lines(title).alias("title"),
        )
    )

    def lower_escapes(t: Column) -> Column:
        # JSON escapes of control characters are written with lower-case digits.
        fixed = t
        for code in _RARE_CONTROLS:
            fixed = F.regexp_replace(
                fixed, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}"
            )
        return F.when(t.rlike(r"\\u00(?:0[BEF]|1[A-F])"), fixed).otherwise(t)

    return sha256(let(text, lower_escapes))


def point_id(chunk: Column, chunk_hash: Column | None = None) -> Column:
    """Name-based UUID (version 5) of a chunk id, or of its hash where that is blank."""
    key = F.coalesce(chunk, F.lit(""))
    if chunk_hash is not None:
        key = F.when(key == "", F.coalesce(chunk_hash, F.lit(""))).otherwise(key)
    key = strip(key)
    name = F.concat(F.unhex(F.lit(POINT_NAMESPACE.replace("-", ""))), F.encode(key, "UTF-8"))

    def build(h: Column) -> Column:
        variant = F.substring(
            F.lit("89ab"),
            F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1,
            F.lit(1),
        )
        return F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(variant, F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        )

    missing = F.raise_error(F.lit("cannot create a point id: chunk_id and chunk_hash are blank"))
    return F.when(key == "", missing).otherwise(let(F.sha1(name), build))
