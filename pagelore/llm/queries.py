"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import chat_format, language, licence, mixing, quality_model, sql
from pagelore.llm.collocations import collocations
from pagelore.llm.common import fold, table
from pagelore.llm.minhash import MinHashConfig, near_duplicates
from pagelore.llm.decontaminate import contaminated
from pagelore.llm.html_main import extract_main_text
from pagelore.llm.quality_rules import quality_rules
from pagelore.llm.ranked_search import ranked_search
from pagelore.llm.registry import ORACLES, QUERIES, query
from pagelore.llm.secrets import SecretLedger, report
from pagelore.llm.suffix import suffix_dedup_report
from pagelore.session import new_folder


@query("op1_license_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licence.scan(docs, licence.train(docs))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query(
    "op3_chat_formatting",
    r"""
    WITH all_rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), shown AS (
        SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*(\||/?s>|</?SYS>>))', '\1\\\2', 'g'),
                                 '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS escaped
        FROM all_rows
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           sum(length('<|start|>') + length(role) + length('<|body|>') + length(escaped) + length('<|end|>'))::BIGINT AS formatted_chars
    FROM shown GROUP BY conv_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_messages(rows)).drop("n_attachments")


@query("op4_minhash_near_dedup", sql.NEAR_DUPLICATES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinHashConfig(words=3, percent=85))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    config = quality_model.QualityConfig()
    weights = quality_model.train(docs, table(spark, sf_dir, "labels"), config)
    return quality_model.score(docs, weights, config).select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= config.threshold, 1).otherwise(0).alias("predicted"),
    )


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_suffix_dedup", sql.REPEATED_BYTES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_report(table(spark, sf_dir, "documents")).drop("spans")


@query("op11_secret_scans", sql.SECRETS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = SecretLedger(spark, new_folder(spark, "secret-ledger"))
    return report(ledger.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op12_ranked_search", sql.RANKED_SEARCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_collocations", sql.COLLOCATIONS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def llm_queries():
    return dict(QUERIES)


def llm_oracles():
    return dict(ORACLES)
