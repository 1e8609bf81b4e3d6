"""All registered queries."""

from __future__ import annotations

from pagelore.catalog.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    from pagelore.catalog import corpus_queries, page_queries, search_queries, text_queries  # noqa: F401

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    all_queries()
    return dict(ORACLES)
