"""Documents to overlapping, deduplicated chunks.

Everything up to the explode happens inside one row with array functions, so
chunking a corpus is a single narrow stage; only the global deduplication shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.config import UI_TEXTS, ChunkConfig
from pagelore.functions.arrays import let
from pagelore.functions.ids import chunk_id, sha256, text_hash
from pagelore.functions.text import clean_text, is_ui_text, section_text, section_words, split_words
from pagelore.operators.first_wins import first_per_key


_LONGEST_UI_TEXT = max(len(t.split()) for t in UI_TEXTS)


def usable_sections(sections: Column, cfg: ChunkConfig) -> Column:
    """Heading, level and words of every section worth chunking.

    Chunks are words joined by blanks, so sections travel as words from here on.
    """
    read = F.transform(
        sections,
        lambda s: F.struct(
            s["heading"].alias("heading"),
            F.coalesce(s["level"], F.lit(0)).alias("level"),
            section_words(s, cfg.dedupe_content).alias("words"),
            s.alias("source"),
        ),
    )

    def usable(s: Column) -> Column:
        n = F.size(s["words"])
        # Only a very short section can be a user-interface text.
        interface = (n <= _LONGEST_UI_TEXT) & is_ui_text(section_text(s["source"], cfg.dedupe_content))
        return (n > 0) & ~interface

    return F.filter(read, usable)


def merge_ends(word_counts: Column, small: int) -> Column:
    """Positions (1-based, inclusive) at which a run of sections is closed.

    Sections are gathered until the run holds at least ``small`` words. That covers
    both rules of the fold: a normal section closes the run it joins, and a run of
    small ones is closed as soon as it is large enough. An unfinished last run ends
    at the last position.
    """
    start = F.struct(
        F.lit(0).alias("held"),
        F.lit(0).alias("position"),
        F.array().cast("array<int>").alias("ends"),
    )

    def step(acc: Column, count: Column) -> Column:
        full = acc["held"] + count >= small
        return F.struct(
            F.when(full, F.lit(0)).otherwise(acc["held"] + count).alias("held"),
            (acc["position"] + 1).alias("position"),
            F.when(full, F.array_append(acc["ends"], acc["position"] + 1))
            .otherwise(acc["ends"])
            .alias("ends"),
        )

    return F.aggregate(
        word_counts,
        start,
        step,
        lambda acc: F.when(acc["held"] > 0, F.array_append(acc["ends"], acc["position"]))
        .otherwise(acc["ends"]),
    )


def merge_small_sections(sections: Column, cfg: ChunkConfig) -> Column:
    """Join small neighbours under the first one's heading; drop a tiny last run."""
    keep_from = min(cfg.min_chunk_words, cfg.small_section_words)

    def merged(ss: Column) -> Column:
        ends = merge_ends(F.transform(ss, lambda s: F.size(s["words"])), cfg.small_section_words)

        def runs(es: Column) -> Column:
            def run(end: Column, i: Column) -> Column:
                first = F.when(i == 0, F.lit(1)).otherwise(F.get(es, i - 1) + 1)
                return let(
                    F.slice(ss, first, end - first + 1),
                    lambda part: F.struct(
                        clean_text(part[0]["heading"]).alias("heading"),
                        part[0]["level"].alias("level"),
                        F.flatten(F.transform(part, lambda p: p["words"])).alias("words"),
                    ),
                )

            return F.transform(es, run)

        return F.filter(let(ends, runs), lambda r: F.size(r["words"]) >= keep_from)

    return let(usable_sections(sections, cfg), merged)


def window_count(words: Column, cfg: ChunkConfig) -> Column:
    """How many windows a text of ``words`` words is cut into."""
    beyond = F.ceil((words - cfg.max_words) / F.lit(float(cfg.step))).cast("int") + 1
    return F.when(words <= 0, F.lit(0)).when(words <= cfg.max_words, F.lit(1)).otherwise(beyond)


def cut_windows(words: Column, cfg: ChunkConfig) -> Column:
    """Overlapping windows of an array of words, as structs of text and word count.

    Windows start every ``step`` words and hold ``window`` words; the last one
    takes the rest.
    """
    n = F.size(words)

    def windows(k: Column) -> Column:
        def one(i: Column) -> Column:
            first = i * cfg.step + 1
            length = F.when(i == k - 1, n - first + 1).otherwise(F.lit(cfg.window))
            return F.struct(
                F.array_join(F.slice(words, first, length), " ").alias("text"),
                length.alias("word_count"),
            )

        none = F.array().cast("array<struct<text:string,word_count:int>>")
        return F.when(k == 0, none).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), one)
        )

    return let(window_count(n, cfg), windows)


def word_windows(text: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """``cut_windows`` of a text."""
    return let(split_words(text), lambda words: cut_windows(words, cfg))


def document_chunks(sections: Column, cfg: ChunkConfig) -> Column:
    """All kept chunks of a document in order, as one array."""

    def of_section(section: Column, i: Column) -> Column:
        return F.transform(
            cut_windows(section["words"], cfg),
            lambda w, j: F.struct(
                section["heading"].alias("section"),
                i.alias("section_index"),
                section["level"].alias("section_level"),
                j.alias("section_chunk_index"),
                w["text"].alias("text"),
                w["word_count"].alias("word_count"),
            ),
        )

    every = F.flatten(F.transform(merge_small_sections(sections, cfg), of_section))
    return F.filter(every, lambda c: c["word_count"] >= cfg.min_chunk_words)


def _or_else(*options: Column) -> Column:
    """The first option that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def chunk_documents(documents: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row per chunk of documents that already carry their manifest entry.

    Needs ``document_id``, ``manifest_canonical_url``, ``content_hash`` and the
    document columns; ``position`` (order of the manifest) and any other column in
    front of them pass through.
    """
    needed = {"document_id", "manifest_canonical_url", "content_hash"}
    missing = needed - set(documents.columns)
    if missing:
        raise ValueError(f"documents lack manifest columns: {sorted(missing)}")
    extra = [c for c in ("position", "copies") if c in documents.columns]
    canonical = _or_else(F.col("manifest_canonical_url"), F.col("canonical_url"), F.col("url"))
    absent = F.raise_error(F.lit("manifest entry is missing document_id"))
    head = documents.select(
        *extra,
        F.when(F.coalesce(F.col("document_id"), F.lit("")) == "", absent)
        .otherwise(F.col("document_id"))
        .alias("document_id"),
        F.when(F.coalesce(F.col("content_hash"), F.lit("")) == "", text_hash(F.col("content")))
        .otherwise(F.col("content_hash"))
        .alias("content_hash"),
        _or_else(F.col("url"), canonical).alias("url"),
        canonical.alias("canonical_url"),
        clean_text(F.col("title")).alias("title"),
        F.coalesce(F.nullif(F.col("page_type"), F.lit("")), F.lit("general")).alias("page_type"),
        document_chunks(F.col("sections"), cfg).alias("_chunks"),
    )
    kept = [c for c in head.columns if c != "_chunks"]
    # The outer form keeps the optimizer from evaluating the whole array once more for
    # a "not empty" filter below the explode.
    rows = head.select(*kept, F.posexplode_outer("_chunks").alias("chunk_index", "_chunk"))
    rows = rows.filter(F.col("_chunk").isNotNull())
    hashed = rows.withColumn("chunk_hash", sha256(F.col("_chunk.text")))
    return hashed.select(
        *extra,
        "document_id",
        chunk_id(F.col("document_id"), F.col("chunk_hash")).alias("chunk_id"),
        "chunk_hash",
        "content_hash",
        F.lit(cfg.chunker_version).alias("chunker_version"),
        "url",
        "canonical_url",
        "title",
        "page_type",
        F.col("_chunk.section").alias("section"),
        F.col("_chunk.section_index").alias("section_index"),
        F.col("_chunk.section_level").alias("section_level"),
        "chunk_index",
        F.col("_chunk.section_chunk_index").alias("section_chunk_index"),
        F.col("_chunk.text").alias("text"),
        F.col("_chunk.word_count").alias("word_count"),
    )


def dedupe_chunks(chunks: DataFrame, position: str = "position") -> DataFrame:
    """Keep the first chunk of each text in manifest order; indexes stay as they are."""
    return first_per_key(chunks, ["chunk_hash"], [F.col(position), F.col("chunk_index")])


def chunk_statistics(chunks: DataFrame, unique: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row of counters over all chunks and over the unique ones."""
    weight = F.col("copies") if "copies" in chunks.columns else F.lit(1)
    raw = chunks.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("raw_chunks"))
    words = F.col("word_count")
    kept = unique.agg(
        F.count(F.lit(1)).alias("unique_chunks"),
        F.coalesce(F.avg(words), F.lit(0.0)).alias("average_words"),
        F.count_if(words < cfg.min_chunk_words).alias("tiny_chunks"),
        F.count_if(words > cfg.max_words).alias("oversized_chunks"),
    )
    # Two one-row aggregates side by side.
    both = raw.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("duplicate_chunks", F.col("raw_chunks") - F.col("unique_chunks"))
