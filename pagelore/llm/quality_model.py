"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A word counts in two views: its bytes, and its shape (runs of letters, digits and each
other sign folded to one; a mark where it equals the word before). Features are hashed
single words, shapes, and pairs of shapes; a feature's value is its share of the text.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import as_bytes, fold, small_batches


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 18
    #: Labelled rows the model is fitted on at most, those with the smallest hash of their id.
    max_train_rows: int = 6000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    scale: float = 8.0
    threshold: float = 0.7
    #: Words kept in a task's cache before it starts anew.
    cache_words: int = 400_000


class WordFeatures:
    """Turns a text into hashed features. Words are looked up once per task, not once per use."""

    _FOLD = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"))
    _RUN = re.compile(rb"([^aA9])\1+")

    def __init__(self, config: QualityConfig) -> None:
        self.config, self.words, self.shapes = config, {}, {}
        self.mask = (1 << config.bits) - 1

    def _new(self, word: bytes) -> int:
        shape = word
        for pattern, to in self._FOLD:
            shape = pattern.sub(to, shape)
        shape = self._RUN.sub(rb"\1", shape)[:24]
        code = zlib.crc32(word) << 32 | zlib.crc32(shape, 7)
        if len(self.words) >= self.config.cache_words:
            self.words.clear()
        self.words[word] = code
        return code

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Feature numbers of all n-grams of the text, repeats included."""
        words = (text or b"").split()
        if not words:
            return np.zeros(0, dtype=np.int64)
        known, new = self.words.get, self._new
        codes = np.array([known(w) or new(w) for w in words], dtype=np.uint64)
        one, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        shape[1:][codes[1:] == codes[:-1]] ^= np.uint64(0x5BD1E995)
        two = shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        odd = np.uint64(0xFF51AFD7ED558CCD)
        parts = ((one * odd) >> np.uint64(40), ((shape + np.uint64(1)) * odd) >> np.uint64(39), two >> np.uint64(41))
        return (np.concatenate(parts) & np.uint64(self.mask)).astype(np.int64)


def fit(rows: list[tuple[bytes | None, int]], config: QualityConfig) -> np.ndarray:
    """FTRL-proximal over the rows in the given order; the last weight is the bias."""
    features, size = WordFeatures(config), (1 << config.bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    examples = []
    for text, label in rows:
        at, times = np.unique(features(text), return_counts=True)
        x = np.append(times / max(1, times.sum()) * config.scale, 1.0)
        examples.append((np.append(at, size - 1), x, float(label)))
    order = np.random.default_rng(5)
    for _ in range(config.epochs):
        for k in order.permutation(len(examples)):
            at, x, label = examples[k]
            zi, ni = z[at], n[at]
            wi = np.where(
                np.abs(zi) <= config.l1, 0.0,
                -(zi - np.sign(zi) * config.l1) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2),
            )
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / config.alpha * wi
            n[at] += g * g
    w = np.where(np.abs(z) <= config.l1, 0.0,
                 -(z - np.sign(z) * config.l1) / ((config.beta + np.sqrt(n)) / config.alpha + config.l2))
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> np.ndarray:
    """Fit on labelled rows outside the held-out quarter, ``config.max_train_rows`` at most.

    The rows are chosen on ids alone, so texts of other documents are never moved. The fit
    runs in one task; only the weights come back. Without labelled rows all weights are 0
    (every score is 0.5). Null labels and ids are left out; of an id labelled twice the
    smaller label counts.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .where(fold(F.col("doc_id")) != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_train_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in stream:
            rows += zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("quality").to_pylist())
        rows.sort(key=lambda r: (r[0], r[1] or b"", r[2]))
        yield pa.RecordBatch.from_arrays([pa.array([fit([r[1:] for r in rows], config).tobytes()], pa.binary())], ["weights"])

    found = sample.repartition(1).mapInArrow(run, "weights binary").collect()
    if not found:
        return np.zeros((1 << config.bits) + 1, dtype=np.float32)
    return np.frombuffer(found[0].weights, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, config: QualityConfig = QualityConfig()) -> DataFrame:
    """All columns of ``docs`` and ``score``: the model's probability of label 1.

    A null or empty text has the score of the bias alone. Every row is scored, repeated
    ones too; no column but ``text`` is looked at.
    """
    sparse = np.flatnonzero(weights[:-1])
    shipped = sparse.astype(np.int32), weights[sparse], float(weights[-1])

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << config.bits, dtype=np.float32)
        dense[shipped[0]] = shipped[1]
        features = WordFeatures(config)
        for batch in texts:
            out = []
            for text in batch:
                at = features(text.encode("utf-8") if text else None)
                dot = float(dense[at].sum(dtype=np.float64)) * config.scale / len(at) if len(at) else 0.0
                out.append(1 / (1 + np.exp(-np.clip(dot + shipped[2], -30, 30))))
            yield pd.Series(out, dtype="float64")

    return small_batches(docs).withColumn("score", probability(F.col("text")))
