"""Vectors for texts: encoders, the embed stage and its checks.

An encoder is any object with a ``dimension``, a ``model`` name, a ``version`` and
``encode(text_column) -> array<float> column``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.config import EmbedConfig
from pagelore.functions.text import lexical_words
from pagelore.functions.vectors import is_finite

_VECTOR = T.ArrayType(T.FloatType())


class HashedWords:
    """Offline stand-in encoder: word counts hashed into buckets, unit length.

    It says nothing about meaning; it only gives equal words equal directions.
    Each distinct word of an Arrow batch is hashed once; whole batches are counted with numpy.
    """

    def __init__(self, cfg: EmbedConfig = EmbedConfig()) -> None:
        self.dimension = cfg.dimension
        self.model = cfg.model
        self.version = cfg.version

    def encode(self, text: Column) -> Column:
        dim = self.dimension

        def count(batch: pa.Array) -> pa.Array:
            lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = len(batch)
            owner = np.repeat(np.arange(rows, dtype=np.int64), lengths)
            coded = batch.flatten().dictionary_encode()
            digests = (hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist())
            buckets = np.fromiter((int(d[:8], 16) % dim for d in digests), np.int64, len(coded.dictionary))
            cells = owner * dim + buckets[coded.indices.to_numpy(zero_copy_only=False)]
            matrix = np.bincount(cells, minlength=rows * dim).reshape(rows, dim).astype(np.float64)
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            norms[norms == 0.0] = 1.0
            flat = (matrix / norms[:, None]).astype(np.float32).ravel()
            offsets = np.arange(0, rows * dim + 1, dim, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

        count.__annotations__ = {"batch": pa.Array, "return": pa.Array}
        return F.arrow_udf(count, _VECTOR)(lexical_words(text))


class ModelEncoder:
    """Wraps a sentence encoder; ``load`` runs once per Python worker.

    ``load`` returns an object whose ``encode(list_of_texts)`` gives one vector per text.
    """

    def __init__(self, load: Callable[[], object], cfg: EmbedConfig = EmbedConfig()) -> None:
        self.load = load
        self.dimension = cfg.dimension
        self.batch_size = cfg.batch_size
        self.model = cfg.model
        self.version = cfg.version

    def encode(self, text: Column) -> Column:
        load, size = self.load, self.batch_size

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                out: list[list[float]] = []
                for at in range(0, len(texts), size):
                    part = np.asarray(model.encode(texts.iloc[at : at + size].tolist()), dtype=np.float32)
                    lengths = np.linalg.norm(part, axis=1, keepdims=True)
                    lengths[lengths == 0.0] = 1.0
                    out.extend((part / lengths).tolist())
                yield pd.Series(out)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        # A model must not run twice because a filter looks at its result.
        return F.pandas_udf(run, _VECTOR).asNondeterministic()(text)


def require_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fail the job at the first row in which one of ``fields`` is NULL or empty."""
    checks = [
        F.when(
            F.coalesce(F.col(f).cast("string"), F.lit("")) == "",
            F.raise_error(F.lit(f"missing required field '{f}'")),
        ).otherwise(F.col(f)).alias(f)
        for f in fields
    ]
    rest = [c for c in df.columns if c not in fields]
    return df.select(*checks, *rest).select(*df.columns)


def embed_chunks(chunks: DataFrame, encoder) -> DataFrame:
    """Chunks plus vector and model columns; blank required fields and odd sizes fail."""
    checked = require_fields(chunks, ("chunk_id", "document_id", "chunk_hash", "text"))
    vectors = checked.withColumn("embedding", encoder.encode(F.col("text")))
    wrong = F.raise_error(
        F.concat(
            F.lit(f"embedding dimension mismatch: expected {encoder.dimension}, got "),
            F.size("embedding").cast("string"),
        )
    )
    return vectors.withColumn(
        "embedding",
        F.when(F.size("embedding") == encoder.dimension, F.col("embedding")).otherwise(wrong),
    ).withColumns(
        {
            "embedding_model": F.lit(encoder.model),
            "embedding_version": F.lit(encoder.version),
            "embedding_dimensions": F.lit(encoder.dimension),
        }
    )


def embedding_report(embedded: DataFrame, dimension: int, key: str = "chunk_id") -> DataFrame:
    """One row: rows, repeated keys, vectors of the wrong size, non-finite vectors."""
    per_key = embedded.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).alias("wrong_size"),
        F.count_if(~F.coalesce(is_finite(F.col("embedding")), F.lit(False))).alias("not_finite"),
    )
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeated_ids"),
        F.coalesce(F.sum("wrong_size"), F.lit(0)).alias("wrong_size"),
        F.coalesce(F.sum("not_finite"), F.lit(0)).alias("not_finite"),
    )


def verify_embeddings(embedded: DataFrame, dimension: int, expected_rows: int | None = None) -> None:
    """Raise if a written embedding table is not what the embed stage promises."""
    found = embedding_report(embedded, dimension).first()
    if expected_rows is not None and found.records != expected_rows:
        raise RuntimeError(f"record count mismatch: {found.records} != {expected_rows}")
    if found.repeated_ids:
        raise RuntimeError("duplicate chunk ids detected")
    if found.wrong_size:
        raise RuntimeError("invalid vector dimension")
    if found.not_finite:
        raise RuntimeError("non-finite embedding value")
