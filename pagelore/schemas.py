"""Record shapes passed between the stages."""

from __future__ import annotations

HEADING = "struct<level:int, text:string>"
LINK = "struct<url:string, text:string>"
SECTION = (
    "struct<heading:string, level:int, paragraphs:array<string>, bullets:array<string>,"
    " content:string, word_count:int>"
)

DOCUMENT = (
    "schema_version string, url string, canonical_url string, title string, description string,"
    f" page_type string, headings array<{HEADING}>, sections array<{SECTION}>,"
    f" links array<{LINK}>, content string, word_count int, status_code int, encoding string"
)

CHUNK = (
    "document_id string, chunk_id string, chunk_hash string, content_hash string,"
    " chunker_version string, url string, canonical_url string, title string, page_type string,"
    " section string, section_index int, section_level int, chunk_index int,"
    " section_chunk_index int, text string, word_count int"
)

EMBEDDED_CHUNK = (
    CHUNK + ", embedding array<float>, embedding_model string, embedding_version string,"
    " embedding_dimensions int"
)

# Payload of a point next to its id and vector, in storage order.
PAYLOAD_TEXT_FIELDS = (
    "document_id", "chunk_id", "chunk_hash", "content_hash", "chunker_version",
    "url", "canonical_url", "title", "page_type", "section", "text",
)
PAYLOAD_NUMBER_FIELDS = (
    "section_index", "section_level", "chunk_index", "section_chunk_index", "word_count",
)
SCHEMA_VERSION = "2.2"
