"""Running the stages continuously: new pages into points, questions into answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelore.config import AnswerConfig, ChunkConfig, CrawlConfig, SearchConfig
from pagelore.functions.ids import document_id
from pagelore.functions.urls import identity_url
from pagelore.operators.extract import extract_pages
from pagelore.operators.frontier import latest_documents
from pagelore.operators.holders import replace_documents
from pagelore.operators.points import read_points
from pagelore.plans.chat import answer_questions
from pagelore.plans.corpus import document_passages, embed_corpus, validate_corpus
from pagelore.session import Scratch


def pages_into_points(
    pages: DataFrame,
    points_path: str,
    checkpoint: str,
    encoder,
    site: CrawlConfig,
    chunking: ChunkConfig = ChunkConfig(),
    **trigger,
) -> StreamingQuery:
    """Extract, validate, chunk and embed new pages and merge them into the point table.

    All points of a page that comes again are replaced, also if too little of it is left to be
    stored. A passage that several documents have is stored once and passes to the next
    of them when its document loses it (``operators/holders.py``). A repeated batch changes
    nothing. Intermediate tables of a batch go when it is done.
    """

    def merge(batch: DataFrame, _: int) -> None:
        with Scratch(batch.sparkSession, "stream") as scratch:
            extracted = scratch.keep(extract_pages(batch))
            documents = scratch.keep(latest_documents(extracted.filter(F.col("word_count") >= site.min_document_words)))
            manifest = validate_corpus(documents, site).manifest
            points = scratch.keep(embed_corpus(document_passages(manifest, documents, chunking), encoder))
            source = F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("url"))
            came = extracted.select(document_id(identity_url(source, site)).alias("document_id"))
            replace_documents(points, came.filter(F.col("document_id").isNotNull()), points_path, encoder.dimension)

    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def questions_into_answers(
    questions: DataFrame,
    points_path: str,
    answers_path: str,
    checkpoint: str,
    encoder,
    generator=None,
    search_cfg: SearchConfig = SearchConfig(),
    cfg: AnswerConfig = AnswerConfig(),
    **trigger,
) -> StreamingQuery:
    """Answer every arriving question (query_id, question); one folder per batch."""

    def answer(batch: DataFrame, number: int) -> None:
        with Scratch(batch.sparkSession, "stream-questions") as scratch:
            asked = scratch.keep(batch.select("query_id", "question"))
            points = read_points(batch.sparkSession, points_path)
            answers = answer_questions(points, asked, encoder, generator, search_cfg, cfg)
            answers.write.mode("overwrite").parquet(f"{answers_path}/batch={number}")

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
