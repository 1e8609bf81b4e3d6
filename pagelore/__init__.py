"""Spark-native engine for building and querying a text knowledge base."""

import sys

from pyspark import cloudpickle

from pagelore.config import (
    AnswerConfig,
    ChunkConfig,
    CrawlConfig,
    EmbedConfig,
    IntentConfig,
    SearchConfig,
)
from pagelore.session import build_session

__all__ = [
    "AnswerConfig",
    "ChunkConfig",
    "CrawlConfig",
    "EmbedConfig",
    "IntentConfig",
    "SearchConfig",
    "build_session",
]

# Functions of this package travel inside the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
