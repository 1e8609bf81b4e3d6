"""Hybrid search for a batch of questions as one plan keyed by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.config import SearchConfig
from pagelore.functions.text import strip
from pagelore.operators.diversity import select_diverse
from pagelore.operators.joins import join_unique
from pagelore.operators.nearest import nearest_points
from pagelore.operators.ranking import (
    coverage_anchors,
    drop_duplicate_results,
    eligible_results,
    is_broad_question,
    keep_coverage_if_any,
    lexical_overlap,
    rerank_score,
    with_lexical,
)
from pagelore.session import materialize

RESULT_FIELDS = (
    "id", "score", "chunk_id", "document_id", "chunk_hash", "title", "url", "canonical_url",
    "page_type", "section", "section_index", "section_level", "chunk_index",
    "section_chunk_index", "text", "word_count", "embedding_model", "embedding_version",
)

# Coverage rows rank behind every semantic row of the same question.
_ANCHOR_OFFSET = 1_000_000


def prepare_questions(questions: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Stripped, non-blank questions with their intent flag."""
    asked = questions.withColumn("question", strip(F.coalesce("question", F.lit(""))))
    return asked.filter(F.col("question") != "").withColumn(
        "broad", is_broad_question(F.col("question"), cfg.intent)
    )


def result_rows(points: DataFrame, *extra: str) -> DataFrame:
    """Points as result rows: stringified payload with defaults, plus the vector."""
    shown = []
    for name in RESULT_FIELDS:
        if name == "score":
            continue
        if name.endswith("_index") or name == "section_level":
            shown.append(F.col(name))
        elif name == "word_count":
            shown.append(F.coalesce(F.col(name), F.lit(0)).alias(name))
        else:
            shown.append(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name))
    return points.select(*shown, "vector", *extra)


def semantic_results(points: DataFrame, questions: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The ``candidate_k`` nearest points of every question with their payload.

    The similarity scan reads ids and vectors only; texts are fetched afterwards for
    the points that were found: by broadcasting those ids while they are few, else by
    a join that spreads points found by very many questions.
    """
    top = nearest_points(
        points, questions, cfg.candidate_k, cfg.score_decimals, cfg.question_block_bytes
    )
    rows = result_rows(points)
    if questions.count() * cfg.candidate_k <= cfg.broadcast_rows:
        found = rows.join(F.broadcast(top), "id")
    else:
        found = join_unique(materialize(top, "nearest"), rows, "id", "query_id")
    return found.withColumnRenamed("rank", "input_pos")


def candidates(points: DataFrame, questions: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Semantic rows and, for broad questions, the coverage rows behind them.

    The result is hash-partitioned by question once; every later step reuses that.
    """
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), "question", "broad")
    found = semantic_results(points, questions, cfg)
    urls = cfg.intent.coverage_urls
    if urls:
        anchors = coverage_anchors(points, cfg.intent).withColumnRenamed("url", "wanted")
        rows = result_rows(anchors.withColumn("url", F.col("wanted")), "anchor_pos", "wanted")
        wanted = asked.filter("broad").select(
            "query_id", F.explode(F.array(*[F.lit(u) for u in dict.fromkeys(urls)])).alias("wanted")
        )
        # At most rows_per_url rows for each of the listed pages.
        anchored = (
            wanted.join(F.broadcast(rows), "wanted")
            .drop("wanted")
            .withColumn("input_pos", F.col("anchor_pos") + _ANCHOR_OFFSET)
            .withColumn("score", F.lit(0.0))
            .drop("anchor_pos")
        )
        found = found.unionByName(anchored)
    return found.repartition("query_id").join(asked, "query_id")


def rerank(rows: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Adds ``rerank_score`` and ``rerank_pos`` (1 is best; ties keep input order)."""
    if "lexical_score" not in rows.columns:
        overlap = lexical_overlap(F.col("question"), F.col("title"), F.col("section"), F.col("text"))
        rows = rows.withColumn("lexical_score", overlap)
    scored = rows.withColumn(
        "rerank_score",
        rerank_score(
            F.col("score"), F.col("lexical_score"), F.col("url"), F.col("title"), F.col("broad"), cfg
        ),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "input_pos")
    return scored.withColumn("rerank_pos", F.row_number().over(order))


def search(points: DataFrame, questions: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Ranked results of every question.

    ``questions`` has ``query_id`` (unique), ``question`` and ``vector``; ``points`` is
    the point table, read by every step and therefore stored, not computed. The result
    has one row per picked chunk with ``pick`` as its place, and no vectors.
    """
    # Stored, because the vectors of the questions are needed more than once.
    asked = materialize(prepare_questions(questions, cfg), "questions")
    rows = drop_duplicate_results(with_lexical(candidates(points, asked, cfg)))
    if cfg.intent.coverage_urls:
        rows = keep_coverage_if_any(rows, cfg.intent)
    ranked = rerank(rows, cfg)
    picked = select_diverse(
        eligible_results(ranked, cfg), cfg.top_k, cfg.mmr_lambda, cfg.score_decimals
    )
    return picked.select(
        "query_id", "question", "pick", *RESULT_FIELDS, "rerank_score", "mmr_score"
    )
