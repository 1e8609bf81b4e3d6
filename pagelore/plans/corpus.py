"""Corpus build: crawl, extract, validate, chunk, embed and store as one chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pagelore.config import ChunkConfig, CrawlConfig
from pagelore.operators.chunking import chunk_documents, chunk_statistics, dedupe_chunks
from pagelore.operators.embedding import embed_chunks
from pagelore.operators.points import build_points
from pagelore.operators.validation import (
    build_manifest,
    duplicate_members,
    entry_outcomes,
    manifest_documents,
    manifest_header,
    resolve_entries,
    usable_entries,
)
from pagelore.session import materialize


@dataclass(frozen=True)
class Validation:
    manifest: DataFrame
    header: DataFrame
    report: dict[str, DataFrame]


@dataclass(frozen=True)
class Chunked:
    chunks: DataFrame
    statistics: DataFrame
    outcomes: DataFrame


def validate_corpus(documents: DataFrame, site: CrawlConfig | None = None) -> Validation:
    """Manifest, its header and the report tables of a set of documents."""
    rows = materialize(build_manifest(documents, site), "manifest")
    return Validation(
        usable_entries(rows),
        manifest_header(rows),
        {
            "duplicate_urls": duplicate_members(rows, "canonical_url"),
            "duplicate_content": duplicate_members(rows, "content_hash"),
            "invalid": rows.filter("status = 'invalid'"),
            "warnings": rows.filter("status = 'warning'"),
        },
    )


def chunk_corpus(manifest: DataFrame, documents: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> Chunked:
    """Unique chunks of all documents the manifest leads to, with counters."""
    entries = materialize(resolve_entries(manifest, documents), "entries")
    every = materialize(chunk_documents(manifest_documents(entries, documents), cfg), "chunks")
    unique = dedupe_chunks(every)
    return Chunked(
        unique.drop("position", "copies"),
        chunk_statistics(every, unique, cfg),
        entry_outcomes(entries),
    )


def document_passages(manifest: DataFrame, documents: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """All chunks of all documents the manifest leads to, also those that other documents have."""
    entries = materialize(resolve_entries(manifest, documents), "entries")
    return chunk_documents(manifest_documents(entries, documents), cfg).drop("position", "copies")


def embed_corpus(chunks: DataFrame, encoder) -> DataFrame:
    """Points of chunks, ready for the point table."""
    return build_points(embed_chunks(chunks, encoder), encoder.dimension)
