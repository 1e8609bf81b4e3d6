"""Questions to answers as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.config import AnswerConfig, SearchConfig
from pagelore.operators.answering import ExtractiveGenerator, answer_from_results, valid_question
from pagelore.plans.search import search


def embed_questions(questions: DataFrame, encoder) -> DataFrame:
    """Questions (query_id, question) with their vectors."""
    return questions.withColumn("vector", encoder.encode(F.coalesce("question", F.lit(""))))


def answer_questions(
    points: DataFrame,
    questions: DataFrame,
    encoder,
    generator=None,
    search_cfg: SearchConfig = SearchConfig(),
    cfg: AnswerConfig = AnswerConfig(),
    replies: str | None = None,
) -> DataFrame:
    """One answer row per question; rejected questions are never searched for.

    ``replies`` names a folder where the generator's replies are kept, so that none is paid for twice.
    """
    valid = questions.filter(valid_question(F.col("question"), cfg))
    results = search(points, embed_questions(valid, encoder), search_cfg)
    return answer_from_results(questions, results, generator or ExtractiveGenerator(), cfg, replies)
