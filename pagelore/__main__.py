"""Command line: one subcommand per stage, each reading and writing stage tables.

python -m pagelore crawl --host www.example.org --out work
python -m pagelore validate --host www.example.org --out work
python -m pagelore chunk --out work
python -m pagelore embed --out work
python -m pagelore index --out work
python -m pagelore search --out work --questions questions.json
python -m pagelore answer --out work --questions questions.json
"""

from __future__ import annotations

import argparse
import importlib
from datetime import datetime, timezone

from pagelore.config import AnswerConfig, CrawlConfig, EmbedConfig, IntentConfig, SearchConfig
from pagelore.operators.answering import ChatGenerator, results_report
from pagelore.operators.embedding import HashedWords, ModelEncoder, embed_chunks, verify_embeddings
from pagelore.operators.frontier import crawl, crawl_counts, crawl_lists, crawl_metadata, latest_documents
from pagelore.operators.points import build_points, health, index_points, read_points, readiness
from pagelore.plans.chat import answer_questions, embed_questions
from pagelore.plans.corpus import chunk_corpus, validate_corpus
from pagelore.plans.search import search
from pagelore.session import build_session
from pagelore.sources import tables
from pagelore.sources.fetch import fetch_over_http


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pagelore")
    parser.add_argument(
        "stage", choices=("crawl", "validate", "chunk", "embed", "index", "health", "search", "answer")
    )
    parser.add_argument("--out", required=True, help="folder of the stage tables")
    parser.add_argument("--master", help="Spark master; the cluster's own setting if absent")
    parser.add_argument("--host", default="", help="canonical host of the site")
    parser.add_argument("--bare-host", default="", help="host that means the same site")
    parser.add_argument("--max-pages", type=int, default=1000, help="0: no limit")
    parser.add_argument("--documents", help="folder of documents, one JSON file each")
    parser.add_argument("--dimension", type=int, default=EmbedConfig.dimension)
    parser.add_argument("--keep", action="store_true", help="merge into the point table")
    parser.add_argument("--encoder", help="module:factory of a sentence encoder, see ModelEncoder; a stand-in if absent")
    parser.add_argument("--generator", help="module:factory of a chat model, see ChatGenerator; a stand-in if absent")
    parser.add_argument("--replies", help="folder of earlier replies of the generator; a prompt found there is not sent")
    parser.add_argument("--questions", help="JSON lines with query_id and question")
    parser.add_argument("--top-k", type=int, default=SearchConfig.top_k)
    parser.add_argument("--candidate-k", type=int, default=SearchConfig.candidate_k)
    parser.add_argument("--overview-url", default="")
    parser.add_argument("--coverage-url", action="append", default=[])
    parser.add_argument("--knowledge-base", default=AnswerConfig.knowledge_base)
    return parser.parse_args()


def _loader(name: str):
    """The function ``module:factory`` names. It is called once per Python worker and returns the model."""
    module, _, factory = name.partition(":")

    def load():
        return getattr(importlib.import_module(module), factory)()

    return load


def main() -> None:
    args = _arguments()
    spark = build_session("pagelore", args.master)
    out = args.out.rstrip("/")
    site = CrawlConfig(args.host, args.bare_host, max_pages=args.max_pages or None)
    made = EmbedConfig(dimension=args.dimension)
    encoder = ModelEncoder(_loader(args.encoder), made) if args.encoder else HashedWords(made)
    generator = ChatGenerator(_loader(args.generator)) if args.generator else None

    def documents():
        if args.documents:
            return tables.read_document_files(spark, args.documents)
        return tables.read_documents(spark, f"{out}/documents")

    if args.stage == "crawl":
        started = datetime.now(timezone.utc)
        found = crawl(spark, lambda urls: fetch_over_http(urls, site), site)
        tables.write_raw_pages(found.pages, f"{out}/html")
        tables.write_documents(latest_documents(found.documents), f"{out}/documents")
        found.log.write.mode("overwrite").parquet(f"{out}/crawl_log")
        tables.write_report(crawl_lists(found.log), f"{out}/crawl_lists")
        if site.max_pages is not None:
            meta = crawl_metadata(found.log, site, started, datetime.now(timezone.utc))
            meta.coalesce(1).write.mode("overwrite").json(f"{out}/crawl_metadata")
        crawl_counts(found.log, site).show(truncate=False)
    elif args.stage == "validate":
        checked = validate_corpus(documents(), site)
        tables.write_manifest(checked.manifest, checked.header, f"{out}/manifest")
        tables.write_report(checked.report, f"{out}/report")
        checked.header.show(truncate=False)
    elif args.stage == "chunk":
        made = chunk_corpus(tables.read_manifest(spark, f"{out}/manifest"), documents())
        tables.write_chunks(made.chunks, f"{out}/chunks")
        made.outcomes.show(truncate=False)
        made.statistics.show(truncate=False)
    elif args.stage == "embed":
        chunks = tables.read_chunks(spark, f"{out}/chunks")
        tables.write_embeddings(embed_chunks(chunks, encoder), f"{out}/embeddings")
        written = tables.read_embeddings(spark, f"{out}/embeddings")
        verify_embeddings(written, args.dimension, chunks.count())
    elif args.stage == "index":
        points = build_points(tables.read_embeddings(spark, f"{out}/embeddings"), args.dimension)
        index_points(
            points, f"{out}/points", args.dimension, not args.keep, replace_documents=args.keep
        ).show(truncate=False)
    elif args.stage == "health":
        readiness(health(spark, f"{out}/points")).show(truncate=False)
    else:
        asked = spark.read.schema("query_id string, question string").json(args.questions)
        points = read_points(spark, f"{out}/points")
        intent = IntentConfig(overview_url=args.overview_url, coverage_urls=tuple(args.coverage_url))
        cfg = SearchConfig(top_k=args.top_k, candidate_k=args.candidate_k, intent=intent)
        if args.stage == "search":
            results = search(points, embed_questions(asked, encoder), cfg)
            results.write.mode("overwrite").parquet(f"{out}/results")
            stored = spark.read.parquet(f"{out}/results")
            results_report(asked, stored).write.mode("overwrite").json(f"{out}/results_report")
        else:
            answers = answer_questions(
                points, asked, encoder, generator, search_cfg=cfg, cfg=AnswerConfig(args.knowledge_base), replies=args.replies
            )
            answers.write.mode("overwrite").json(f"{out}/answers")
    spark.stop()


if __name__ == "__main__":
    main()
