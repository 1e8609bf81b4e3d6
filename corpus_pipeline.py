"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and read again as the next stage's ``docs``. Texts stay where they are: decisions are
narrow rows that are sent to the texts if their number is small, and joined by a shuffle if
it is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import decontaminate, minhash, mixing, quality_model, suffix
from pagelore.llm.common import small_or_shuffled, table
from pagelore.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``row_key``, and the ids that do not name one row.

    The key is the doc_id. Rows without one, and rows that repeat one, get a hash of the whole
    row instead, so that what is decided about one of them does not hold for another; only
    rows that agree in all columns share a key.
    """
    ids = materialize(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_again")), "repeated-ids")
    n = ids.count()
    if not n:
        return docs.withColumn("row_key", F.col("doc_id")), None
    marked = docs.join(small_or_shuffled(ids.withColumn("_marked", F.lit(True)), n), F.col("doc_id").eqNullSafe(F.col("_again")), "left")
    # Above the ids of other rows, which so come first where the order of ids decides.
    drawn = F.shiftrightunsigned(F.xxhash64(*COLUMNS), 2) + F.lit(1 << 62)
    key = F.when(F.col("_marked"), drawn).otherwise(F.col("doc_id"))
    return marked.withColumn("row_key", key).drop("_again", "_marked"), ids


def _distinct(docs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``docs`` with one row of each key; only rows of repeated ids are compared."""
    if ids is None:
        return docs
    marks, same = small_or_shuffled(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("_again"))
    again = docs.join(marks, same, "left_semi").dropDuplicates(["row_key"])
    return docs.join(marks, same, "left_anti").unionByName(again)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the rows whose row_key is a doc_id of ``keys``; the columns of documents."""
    gone = materialize(keys.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(small_or_shuffled(gone, gone.count()), F.col("row_key") == F.col("_gone"), "left_anti").select(*COLUMNS)


def _as_id(docs: DataFrame) -> DataFrame:
    """Key and text of ``docs``, as the operators read them."""
    return docs.select(F.col("row_key").alias("doc_id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. An empty text has the score of the bias alone.

    Without a single label nothing was learned about quality, and all documents stay.
    """
    config = quality_model.QualityConfig()
    labels = table(spark, sf_dir, "labels")
    if labels.where(F.col("quality").isNotNull()).isEmpty():
        return docs.select(*COLUMNS)
    weights = quality_model.train(docs, labels, config)
    scored = quality_model.score(docs.select(*COLUMNS), weights, config)
    return scored.where(F.col("score") >= config.threshold).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 80 percent): the one with the smallest doc_id.

    Rows that repeat a doc_id, or have none, are judged one by one, after all others; rows that agree in all columns are one.
    """
    keyed, ids = _keyed(docs.select(*COLUMNS))
    keyed = _distinct(keyed, ids)
    found = minhash.near_duplicates(_as_id(keyed), minhash.MinHashConfig(words=5, percent=80))
    return _without(keyed, found.where(~F.col("kept")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document (or the same one before) has too; ``n_chars`` counts anew.

    A document of which nothing is left goes.
    """
    keyed, _ = _keyed(docs.select(*COLUMNS))
    cut = suffix.remove_repeats(keyed.withColumnRenamed("doc_id", "own_id").withColumnRenamed("row_key", "doc_id"))
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", length).drop("doc_id").withColumnRenamed("own_id", "doc_id").select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    keyed, _ = _keyed(docs.select(*COLUMNS))
    return _without(keyed, decontaminate.contaminated(_as_id(keyed), table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the columns of documents, and ``copy``, counted from 1.

    Rows that agree in all columns count as the copies of one.
    """
    keyed, ids = _keyed(docs.select(*COLUMNS))
    mixed = mixing.mix(keyed.select(F.col("row_key").alias("doc_id"), "source", "text"))
    copies = mixed.where(F.col("copies") > 0).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").cast("int").alias("copies"))
    taken = materialize(copies, "taken")
    out = _distinct(keyed, ids).join(small_or_shuffled(taken, taken.count()), F.col("row_key") == F.col("_id"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS, "copy")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", contamination),
    ("mixing", mix),
]

#: Training a model and drawing copies at random have no SQL form; tests/llm/test_pipeline.py has plain statements of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
