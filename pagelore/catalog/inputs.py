"""The supplied tables in the shapes the stages expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.config import CrawlConfig, EmbedConfig, IntentConfig, SearchConfig
from pagelore.operators.chunking import chunk_documents, dedupe_chunks
from pagelore.operators.embedding import HashedWords, embed_chunks
from pagelore.operators.points import build_points
from pagelore.plans.search import prepare_questions
from pagelore.session import materialize, spread

HOST = "kb.example.org"
DIMENSION = 64
ENCODER = HashedWords(EmbedConfig(dimension=DIMENSION))

# Words that make a question broad in the languages of the supplied texts, and the
# pages a broad question has to cover. The last page has no documents.
INTENT = IntentConfig(
    topic_terms=("la", "the", "der", "los"),
    broad_terms=("in", "que", "und", "to"),
    title_signals=("src3", "fr"),
    overview_url=f"https://{HOST}/src0",
    coverage_urls=tuple(f"https://{HOST}/src{i}" for i in (0, 3, 5, 7, 11, 13, 99)),
)
SEARCH = SearchConfig(intent=INTENT)
SITE = CrawlConfig(canonical_host="www.ththen.example.com", bare_host="ththen.example.com")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table whose rows need much work, on all cores even if it is one small file."""
    return spread(table(spark, folder, name))


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as extraction would give them: a titled first section, one per line after it."""
    title = F.concat_ws(" ", "source", "lang")

    def section(line, i):
        heading = F.when(i == 0, title).otherwise(F.lit(""))
        content = F.array_join(F.filter(F.array(heading, line), lambda p: p != ""), "\n")
        return F.struct(
            heading.alias("heading"),
            F.when(i == 0, F.lit(1)).otherwise(F.lit(0)).alias("level"),
            F.array(line).alias("paragraphs"),
            F.array().cast("array<string>").alias("bullets"),
            content.alias("content"),
            F.lit(0).alias("word_count"),
        )

    home = F.concat(F.lit(f"https://{HOST}/"), F.col("source"))
    return text_table(spark, folder).select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".json")).alias("file"),
        "doc_id",
        home.alias("url"),
        F.concat(home, F.lit("/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        title.alias("title"),
        F.col("lang").alias("description"),
        F.lit("general").alias("page_type"),
        F.transform(F.split("text", "\n"), section).alias("sections"),
        F.col("text").alias("content"),
        # The stored count is in characters / 6, so that some documents do not match it.
        (F.col("n_chars") / 6).cast("int").alias("word_count"),
    )


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents, each document under its own id, not yet deduplicated."""
    from pagelore.functions.ids import document_id

    docs = document_records(spark, folder).drop("description")
    keyed = docs.withColumns(
        {
            "position": F.col("file"),
            "document_id": document_id(F.col("canonical_url")),
            "manifest_canonical_url": F.col("canonical_url"),
            "content_hash": F.lit(""),
        }
    )
    return chunk_documents(keyed)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the input files: a changed input is another input."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table_status in files.listStatus(place):
        inner = files.listStatus(table_status.getPath()) if table_status.isDirectory() else [table_status]
        found += [f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in inner]
    return ";".join(sorted(found))


def stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A table that several queries read, built once per session and input."""
    key = (spark.sparkContext.applicationId, _state(spark, folder), name)
    if key not in _STORED:
        _STORED[key] = materialize(build(spark, folder), name)
    return _STORED[key]


def forget(*kept: str) -> None:
    """Drop the stored tables except those named, so that they are built again."""
    for key in [k for k in _STORED if k[2] not in kept]:
        del _STORED[key]


def _build_points(spark: SparkSession, folder: str) -> DataFrame:
    chunks = dedupe_chunks(document_chunks(spark, folder)).drop("position")
    return build_points(embed_chunks(chunks, ENCODER), DIMENSION)


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The point table of all documents."""
    return stored(spark, folder, "points", _build_points)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn of the conversations as a question."""
    turns = text_table(spark, folder, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))


def _build_questions(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    return asked.withColumn("vector", ENCODER.encode(F.col("question")))


def embedded_questions(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "questions", _build_questions)


def prepared_questions(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_questions(embedded_questions(spark, folder), SEARCH)
