"""Depth-limited radix passes over suffixes: repeated windows found digit by digit.

The first ``depth`` bytes of a suffix are split into digits. The first pass orders all suffixes
by their first digit; every further pass orders what is left by the next digit within its group.
Groups of one go after each pass, and the groups of the last pass are exactly the repeated windows.

Rows are (group, doc_id, at). A pass streams rows in the order group, document, position and
carries one row from batch to batch, so a group may be of any size, but a group is read by one
task. Digits are compared by 64-bit hashes within their group. The result is that of
``suffix.repeated_bytes``, which sends a row per anchor where this sends one per suffix.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import as_bytes, batches, mix64, small_batches
from pagelore.llm.suffix import SuffixConfig, _beside_texts, _merge_marks
from pagelore.session import materialize

_RNG = np.random.default_rng(17)
_ODD = _RNG.integers(1 << 62, size=512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = "group long, doc_id long, at int"


def _digit_hashes(raw: bytes, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes (8 at least) from each start."""
    eight = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = np.zeros(len(starts), dtype=np.uint64)
    for k in [*range(0, width - 8, 8), width - 8]:
        h += mix64(eight[starts + k] * _ODD[k])
    return mix64(h)


def _rows(group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(group.view(np.int64)), pa.array(doc, pa.int64()), pa.array(at.astype(np.int32))], ["group", "doc_id", "at"])


def _all_suffixes(texts: DataFrame, depth: int, width: int) -> DataFrame:
    """A row for every suffix of at least ``depth`` bytes, grouped by its first digit."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in batches(whole, "text", 1 << 20):
                for doc, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                    for low in range(0, max(0, len(raw) - depth + 1), 1 << 18):
                        at = np.arange(low, min(low + (1 << 18), len(raw) - depth + 1))
                        yield _rows(_digit_hashes(raw, at, width), np.full(len(at), doc), at)

    return small_batches(texts).mapInArrow(run, _ROWS)


def _next_digit(texts: DataFrame, left: DataFrame, skip: int, width: int, config: SuffixConfig) -> DataFrame:
    """The suffixes that are left, grouped by their group and the digit after ``skip`` bytes."""
    per_doc = left.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("group").alias("groups"), F.collect_list("at").alias("places"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in batches(whole, "text", 1 << 20):
                lists = zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("groups"), batch.column("places"))
                for doc, raw, groups, places in lists:
                    at, group = places.values.to_numpy().astype(np.int64), groups.values.to_numpy().view(np.uint64)
                    # A doc_id on several rows may have texts of several lengths.
                    inside = at + config.depth <= len(raw)
                    at, group = at[inside], group[inside]
                    if len(at):
                        yield _rows(mix64(group * _ODD[9] + _digit_hashes(raw, at + skip, width)), np.full(len(at), doc), at)

    return _beside_texts(texts, per_doc, False, "inner").mapInArrow(run, _ROWS)


def _groups(rows: DataFrame, last: bool) -> DataFrame:
    """Rows of groups that hold two places or more; of the last pass, those that are not their group's first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        goes_on = False  # whether the held row's group has an earlier place
        for batch in stream:
            group, doc, at = (np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held))
            # Rows of one doc_id may agree in group and place: they are one place.
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
            group, doc, at = group[new], doc[new], at[new]
            same = np.concatenate([[goes_on], group[1:] == group[:-1]])  # as the row before
            keep = same[:-1] if last else same[:-1] | same[1:]
            yield _rows(group[:-1][keep], doc[:-1][keep], at[:-1][keep])
            held, goes_on = (group[-1:], doc[-1:], at[-1:]), bool(same[-1])
        if goes_on:
            yield _rows(*held)

    return rows.repartition("group").sortWithinPartitions("group", "doc_id", "at").mapInArrow(run, _ROWS)


def repeated_bytes(docs: DataFrame, config: SuffixConfig = SuffixConfig(), passes: int = 2) -> DataFrame:
    """Stored rows doc_id, from_byte, to_byte: the maximal runs that repeated windows cover."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    edges = [config.depth * k // passes for k in range(passes + 1)]
    rows = _all_suffixes(texts, config.depth, edges[1])
    for k in range(1, passes):
        left = materialize(_groups(rows, last=False), f"radix-{k}")
        rows = _next_digit(texts, left, edges[k], edges[k + 1] - edges[k], config)
    repeats = _groups(rows, last=True)
    marks = repeats.select("doc_id", F.col("at").alias("from_byte"), (F.col("at") + config.depth).cast("int").alias("to_byte"))
    return materialize(_merge_marks(marks), "radix-marks")
