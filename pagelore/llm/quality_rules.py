"""Quality rules: compression bands.

A text is compressed as a whole and in fixed chunks. Repetitive text compresses too
well, random text hardly at all; how well good text compresses depends on its length,
so limits hold for length bands. Two plain counts (few words, words in repeated
windows) come first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelore.llm.common import as_bytes, batches, small_batches

#: (bytes up to, least ratio, greatest ratio). A band without a least ratio says nothing
#: about incompressible text: short texts never compress well.
BANDS = (
    (256, 0.0, 2.6),
    (1024, 1.2, 3.2),
    (4096, 1.4, 4.0),
    (65536, 1.5, 5.0),
    (float("inf"), 1.5, 7.0),
)


@dataclass(frozen=True)
class CompressionRules:
    level: int = 3
    bands: tuple[tuple[float, float, float], ...] = BANDS
    chunk_bytes: int = 2048
    chunk_least: float = 1.3
    chunk_most: float = 4.0
    #: A text goes when more than this share of its full chunks is out of limits.
    chunk_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_repetitive long, "
    "n_chunks_incompressible long, verdict string"
)
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.array([number[w] for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, windows, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = times[windows] > 1
    if not hit.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def quality_rules(docs: DataFrame, rules: CompressionRules = CompressionRules(), text: str = "text") -> DataFrame:
    """Counts, compression ratios and a verdict for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words, fail the base rules and have ratio null. Repeated
    rows give repeated results; a null doc_id stays null; other columns are not read.
    ``verdict`` is ``base``, ``repetitive``, ``incompressible`` or ``kept``. Narrow: no shuffle.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=rules.level)

        def row(raw: bytes | None) -> tuple:
            raw = raw or b""
            words = raw.split()
            joined = b"".join(words)
            chars = len(joined.decode("utf-8", "replace"))
            symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
            lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
            repeat = repeated_words(words)
            failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
            ratio, chunks, high, low, verdict = None, 0, 0, 0, "kept"
            if raw:
                ratio = len(raw) / len(squeeze.compress(raw))
                _, least, most = next(b for b in rules.bands if len(raw) <= b[0])
                for at in range(0, len(raw) - rules.chunk_bytes + 1, rules.chunk_bytes):
                    part = rules.chunk_bytes / len(squeeze.compress(raw[at : at + rules.chunk_bytes]))
                    chunks += 1
                    high += part > rules.chunk_most
                    low += part < rules.chunk_least
                if ratio > most or high > rules.chunk_share * chunks:
                    verdict = "repetitive"
                elif ratio < least or low > rules.chunk_share * chunks:
                    verdict = "incompressible"
            if failed:
                verdict = "base"
            return (len(words), chars, symbols, len(lines) - len(set(lines)), repeat, failed,
                    verdict == "kept", ratio, chunks, high, low, verdict)

        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 3 + [pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for whole in stream:
            for batch in batches(whole, text):
                columns = list(zip(*map(row, as_bytes(batch.column(text))))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names
                )

    return small_batches(docs).select("doc_id", text).mapInArrow(run, SCHEMA)
