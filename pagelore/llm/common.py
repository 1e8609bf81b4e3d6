"""What several operators share: word bytes, hashing and model shipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, written out: the separators of ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column. ``bytes.split()`` then splits on ASCII white space only."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the bytes of a batch sent to Python in this session.

    The default bounds rows alone, and ten thousand long texts are more than a worker's
    memory should hold.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def batches(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts take about ``limit`` bytes; a longer text is a slice of its own."""
    sizes = np.array([v or 0 for v in pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks the held-out quarter. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_or_shuffled(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df`` of narrow rows, marked for broadcast if it is known to have at most ``limit`` rows; else as it is."""
    return F.broadcast(df) if rows <= limit else df
