"""Dedup of repeated windows by minimizer grouping, in place of a radix sort of suffixes.

Repeated windows of ``depth`` bytes are found without ordering suffixes digit by digit: they
are grouped by one of their own 32-byte strings, the digit, and compared whole, by hash,
in one further step. Groups of one are dropped in between.

The digit is the window's string with the least hash.
Equal windows have it at equal offsets, so equal windows stay together; and as neighbouring
windows mostly share it, one row (an anchor) stands for all windows around it:

1.  Anchors are grouped by the digit. In a group, anchors whose whole surroundings agree are
    repeats of the first of them in every window; the first ones go on if their group has
    others.
2.  Those are ordered by the rest of the window, left and right of the anchor, for all
    offsets: in the task that holds the group, or, for a very large group, window by window
    as one more pass over the cluster.

Identity of surroundings and windows is judged by 64-bit hashes within a group of one digit.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import as_bytes, batches, mix64, small_batches
from pagelore.session import materialize


@dataclass(frozen=True)
class SuffixConfig:
    #: Bytes through which suffixes are ordered; at least 40.
    depth: int = 100
    digit: int = 32
    #: Members of a group that one task orders; larger groups take another pass.
    group_rows: int = 50_000
    #: Anchors or spans (12 and 8 bytes each, listed by document) that may be sent to all executors;
    #: beyond, the texts are shuffled, packed.
    broadcast_rows: int = 3_000_000

    @property
    def slack(self) -> int:
        """How far a window's start may lie before its anchor."""
        return self.depth - self.digit


_RNG = np.random.default_rng(91)
_ODD = _RNG.integers(1 << 62, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() over each ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return out if have == width else best(out[: len(x) - width + 1], out[width - have : len(x) - have + 1])


def anchors(raw: bytes, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a text and their digit hashes."""
    n = len(raw)
    if n < config.depth:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    eight = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=raw, strides=(1,))
    count = n - config.digit + 1
    h = np.zeros(count, dtype=np.uint64)
    for k in range(0, config.digit, 8):
        h += eight[k : k + count] * _ODD[k // 8]
    h = mix64(h)
    least = _sliding(h, config.slack + 1, np.minimum)
    # A digit is an anchor if it is the least of some window: compare with the greatest of those minima.
    around = np.concatenate([np.repeat(least[:1] * 0, config.slack), least, np.repeat(least[:1] * 0, config.slack)])
    at = np.flatnonzero(h == _sliding(around, config.slack + 1, np.maximum))
    return at, h[at]


def _anchor_rows(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """digit, around, doc_id, at, extent of every anchor whose surroundings are new to its document.

    Anchors that repeat one of their own document are marked at once: their runs go along
    as rows with a negative extent (the run's length) and a digit that only spreads them. So a
    text that repeats a few words over and over sends a few rows, not thousands for one digit.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for whole in stream:
            for batch in batches(whole, "text", 2 << 20):
                ids, keys, around, places, ends = [], [], [], [], []
                for doc, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                    at, digits = anchors(raw or b"", config)
                    if not len(at):
                        continue
                    start, stop = np.maximum(at - config.slack, 0), np.minimum(at + config.depth, len(raw))
                    left = at - start
                    kind = np.array([xxh3_64_intdigest(raw[s:e], k) for s, e, k in zip(start.tolist(), stop.tolist(), left.tolist())], dtype=np.uint64)
                    extent = left * 256 + stop - at
                    _, first = np.unique(digits * _ODD[7] + kind, return_index=True)
                    if len(first) < len(at):
                        again = np.ones(len(at), dtype=bool)
                        again[first] = False
                        reach = np.maximum.accumulate(stop[again])
                        cut = np.flatnonzero(np.concatenate([[True], start[again][1:] > reach[:-1]]))
                        run, until = start[again][cut], reach[np.concatenate([cut[1:], [len(reach)]]) - 1]
                        first.sort()
                        spread = mix64((run + 1).astype(np.uint64) * _ODD[6] + np.uint64(doc & (1 << 64) - 1))
                        digits, kind = np.concatenate([digits[first], spread]), np.concatenate([kind[first], spread])
                        at, extent = np.concatenate([at[first], run]), np.concatenate([extent[first], run - until])
                    ids.append(np.full(len(at), doc, dtype=np.int64))
                    keys.append(digits)
                    around.append(kind)
                    places.append(at.astype(np.int32))
                    ends.append(extent.astype(np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(around).view(np.int64)),
                         pa.array(np.concatenate(ids)), pa.array(np.concatenate(places)), pa.array(np.concatenate(ends))],
                        ["digit", "around", "doc_id", "at", "extent"],
                    )

    return small_batches(docs).mapInArrow(run, "digit long, around long, doc_id long, at int, extent int")


_MARKS = "digit long, doc_id long, from_byte int, to_byte int"


def _first_pass(rows: DataFrame, config: SuffixConfig) -> DataFrame:
    """Marks (digit null) and anchors that go on (digit, from_byte their position).

    Rows stream in the order digit, surroundings, document, position; what is carried from
    batch to batch is one row, so a group may be of any size.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the open digit: digit, its last surroundings, their first document and position,
        # and the one anchor that waits for a second kind of surroundings.
        last_digit = last_around = None
        head, waiting = (0, 0), None
        for batch in stream:
            digit, around, doc, at, extent = (batch.column(i).to_numpy() for i in range(5))
            marked = extent < 0
            if marked.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(int(marked.sum()), pa.int64()), pa.array(doc[marked]), pa.array(at[marked]), pa.array((at - extent)[marked])],
                    ["digit", "doc_id", "from_byte", "to_byte"],
                )
                digit, around, doc, at, extent = (x[~marked] for x in (digit, around, doc, at, extent))
            n = len(digit)
            if not n:
                continue
            new_digit = np.concatenate([[digit[0] != last_digit if last_digit is not None else True], digit[1:] != digit[:-1]])
            new_around = new_digit | np.concatenate([[around[0] != last_around], around[1:] != around[:-1]])
            # The first of each run of equal surroundings; -1: it was in an earlier batch.
            first = np.maximum.accumulate(np.where(new_around, np.arange(n), -1))
            first_doc, first_at = np.where(first < 0, head[0], doc[first]), np.where(first < 0, head[1], at[first])
            repeat = ~new_around & ((doc != first_doc) | (at != first_at))
            heads = np.flatnonzero(new_around)
            out_digit, out_doc, out_from, out_to, null = [], [], [], [], []
            if repeat.any():
                out_digit.append(digit[repeat])
                out_doc.append(doc[repeat])
                out_from.append(at[repeat] - extent[repeat] // 256)
                out_to.append(at[repeat] + extent[repeat] % 256)
                null.append(np.ones(int(repeat.sum()), dtype=bool))
            goes = np.zeros(len(heads), dtype=bool)
            if len(heads):
                # Heads of one digit are neighbours. One goes on if the next or the last has its digit.
                same = digit[heads[1:]] == digit[heads[:-1]]
                goes[1:] |= same
                goes[:-1] |= same
                if not new_digit[heads[0]] and digit[heads[0]] == last_digit:
                    goes[0] = True
                    if waiting:
                        out_digit.append(np.array([last_digit], dtype=np.int64))
                        out_doc.append(np.array([waiting[0]], dtype=np.int64))
                        out_from.append(np.array([waiting[1]], dtype=np.int32))
                        out_to.append(np.array([0], dtype=np.int32))
                        null.append(np.zeros(1, dtype=bool))
                    waiting = None
                pick = heads[goes]
                out_digit.append(digit[pick])
                out_doc.append(doc[pick])
                out_from.append(at[pick])
                out_to.append(np.zeros(len(pick), dtype=np.int32))
                null.append(np.zeros(len(pick), dtype=bool))
                if new_digit[heads].any() or not goes[-1]:
                    waiting = None if goes[-1] else (int(doc[heads[-1]]), int(at[heads[-1]]))
            head = (int(first_doc[-1]), int(first_at[-1]))
            last_digit, last_around = int(digit[-1]), int(around[-1])
            if out_digit:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_digit), pa.int64(), mask=np.concatenate(null)),
                     pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_from).astype(np.int32)),
                     pa.array(np.concatenate(out_to).astype(np.int32))],
                    ["digit", "doc_id", "from_byte", "to_byte"],
                )

    return rows.repartition("digit").sortWithinPartitions("digit", "around", "doc_id", "at").mapInArrow(run, _MARKS)


def _beside_texts(docs: DataFrame, per_doc: DataFrame, bounded: bool, how: str) -> DataFrame:
    """``docs`` joined with one narrow row per ``_id``; the texts only move if that table is not bounded."""
    if bounded:
        return docs.join(F.broadcast(per_doc), F.col("doc_id").cast("long") == F.col("_id"), how).drop("_id")

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        return pd.Series([None if t is None else squeeze.compress(t.encode("utf-8")) for t in texts], dtype="object")

    @F.pandas_udf("string")
    def unpack(texts: pd.Series) -> pd.Series:
        import zstandard

        back = zstandard.ZstdDecompressor()
        return pd.Series([None if t is None else back.decompress(t).decode("utf-8") for t in texts], dtype="object")

    packed = docs.withColumn("text", pack("text"))
    joined = packed.join(per_doc, F.col("doc_id").cast("long") == F.col("_id"), how).drop("_id")
    return joined.withColumn("text", unpack("text"))


def _surroundings(docs: DataFrame, going: DataFrame, config: SuffixConfig, bounded: bool) -> DataFrame:
    """Anchors that go on, with the bytes around them: digit, doc_id, at, left, bytes."""
    per_doc = going.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("digit").alias("digits"), F.collect_list("from_byte").alias("places"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in batches(whole, "text", 4 << 20):
                out: list[tuple] = []
                for doc, raw, digits, places in zip(
                    batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")),
                    batch.column("digits").to_pylist(), batch.column("places").to_pylist(),
                ):
                    for digit, at in zip(digits, places):
                        start = max(0, at - config.slack)
                        part = raw[start : at + config.depth] if raw else b""
                        if len(part) >= config.depth:
                            out.append((digit, doc, at, at - start, part))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["digit", "doc_id", "at", "left", "bytes"])

    joined = _beside_texts(docs, per_doc, bounded, "inner")
    # A doc_id on several rows may have several texts; only those with the digit at its place belong.
    return joined.mapInArrow(run, "digit long, doc_id long, at int, left int, bytes binary").distinct()


def _window_hashes(parts: list[bytes], left: np.ndarray, config: SuffixConfig) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset before the anchor: the offset, rows that have the whole window, and its hashes."""
    width = config.slack + config.depth
    matrix = np.zeros((len(parts), width), dtype=np.uint8)
    right = np.empty(len(parts), dtype=np.int64)
    for i, part in enumerate(parts):
        at = config.slack - int(left[i])
        matrix[i, at : at + len(part)] = np.frombuffer(part, dtype=np.uint8)
        right[i] = len(part) - left[i]
    power = np.multiply.accumulate(np.full(config.depth, _BASE, dtype=np.uint64))  # _BASE ** 1 ..
    h = np.zeros(len(parts), dtype=np.uint64)
    for k in range(config.depth):
        h = h * _BASE + _BYTE[matrix[:, config.slack + config.depth - 1 - k]]
    for offset in range(config.slack + 1):
        if offset:
            gone = _BYTE[matrix[:, config.slack - offset + config.depth]]
            h = (h - gone * power[config.depth - 2]) * _BASE + _BYTE[matrix[:, config.slack - offset]]
        rows = np.flatnonzero((left >= offset) & (right >= config.depth - offset))
        yield offset, rows, h[rows]


def repeated_extents(ids: list[tuple[int, int]], left: np.ndarray, parts: list[bytes], config: SuffixConfig) -> list[tuple[int, int, int]]:
    """(doc_id, from, to) for rows, in the order of (document, position), whose windows an earlier row has."""
    n = len(parts)
    low = np.full(n, config.depth, dtype=np.int64)  # least and greatest offset of a repeated window
    high = np.full(n, -1, dtype=np.int64)
    if n <= 6:
        for i in range(1, n):
            for j in range(i):
                if ids[i] == ids[j]:
                    continue
                back = _agree(parts[i][: left[i]][::-1], parts[j][: left[j]][::-1])
                ahead = _agree(parts[i][left[i] :], parts[j][left[j] :])
                if back + ahead >= config.depth:
                    high[i] = max(high[i], back)
                    low[i] = min(low[i], config.depth - ahead)
    else:
        order = np.cumsum([0] + [a != b for a, b in zip(ids[1:], ids)])  # rows of one place are one
        for offset, rows, hashes in _window_hashes(parts, left, config):
            _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            again = rows[order[rows] > order[rows[first]][of]]
            high[again] = np.maximum(high[again], offset)
            low[again] = np.minimum(low[again], offset)
    return [(ids[i][0], ids[i][1] - int(high[i]), ids[i][1] - max(0, int(low[i])) + config.depth) for i in np.flatnonzero(high >= 0).tolist()]


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _second_pass(going: DataFrame, config: SuffixConfig) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit, ids, left, parts, found = None, [], [], [], []

        def settle() -> None:
            if len(ids) > 1:
                found.extend(repeated_extents(ids, np.array(left), parts, config))
            ids.clear(), left.clear(), parts.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), (), ()]
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "from_byte", "to_byte"])

        for batch in stream:
            for d, doc, at, before, part in zip(*(c.to_pylist() for c in batch.columns)):
                if d != digit:
                    settle()
                    digit = d
                ids.append((doc, at))
                left.append(before)
                parts.append(part)
            yield flush()
        settle()
        yield flush()

    ordered = going.select("digit", "doc_id", "at", "left", "bytes").repartition("digit").sortWithinPartitions("digit", "doc_id", "at")
    return ordered.mapInArrow(run, "doc_id long, from_byte int, to_byte int")


def _window_pass(going: DataFrame, config: SuffixConfig) -> DataFrame:
    """The pass for very large groups: one row per window, the first of each kept by an aggregate."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            doc, at = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy().astype(np.int64)
            digit, left = batch.column("digit").to_numpy(), batch.column("left").to_numpy().astype(np.int64)
            for offset, rows, hashes in _window_hashes(batch.column("bytes").to_pylist(), left, config):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digit[rows]), pa.array(np.full(len(rows), offset, dtype=np.int32)), pa.array(hashes.view(np.int64)),
                     pa.array(doc[rows]), pa.array((at[rows] - offset).astype(np.int32))],
                    ["digit", "offset", "window", "doc_id", "from_byte"],
                )

    windows = materialize(
        going.select("digit", "doc_id", "at", "left", "bytes").mapInArrow(run, "digit long, offset int, window long, doc_id long, from_byte int"),
        "windows",
    )
    key = ["digit", "offset", "window"]
    first = windows.groupBy(*key).agg(F.min(F.struct("doc_id", "from_byte")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return (
        windows.join(first.select(*key, "first"), key)
        .where(F.struct("doc_id", "from_byte") > F.col("first"))
        .select("doc_id", "from_byte", (F.col("from_byte") + config.depth).cast("int").alias("to_byte"))
    )


def _merge_marks(marks: DataFrame) -> DataFrame:
    """Maximal runs of each document. Marks stream in order; what is carried over is one run."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc_id", "from_byte", "to_byte"])

        held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        for batch in stream:
            doc, start, stop = (np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held))
            if not len(doc):
                continue
            # Documents are laid end to end, so one running maximum serves all of them.
            base = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 32
            reach = np.maximum.accumulate(stop + base)
            first = np.flatnonzero(np.concatenate([[True], start[1:] + base[1:] > reach[:-1]]))
            last = np.concatenate([first[1:], [len(doc)]]) - 1
            runs = doc[first], start[first], reach[last] - base[last]
            held = tuple(r[-1:] for r in runs)
            yield rows(*(r[:-1] for r in runs))
        yield rows(*held)

    ordered = marks.select("doc_id", "from_byte", "to_byte").repartition("doc_id").sortWithinPartitions("doc_id", "from_byte")
    return ordered.mapInArrow(run, "doc_id long, from_byte int, to_byte int")


def repeated_bytes(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> tuple[DataFrame, int]:
    """Stored rows doc_id, from_byte, to_byte, the maximal runs that repeated windows cover, and their number."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    passed = materialize(_first_pass(_anchor_rows(texts, config), config), "first-pass")
    going = passed.where(F.col("digit").isNotNull())
    n_going = going.count()
    parts = [passed.where(F.col("digit").isNull()).select("doc_id", "from_byte", "to_byte")]
    if n_going:
        around = materialize(_surroundings(texts, going, config, n_going <= config.broadcast_rows), "surroundings")
        # At most rows / group_rows digits.
        large = materialize(around.groupBy("digit").count().where(F.col("count") > config.group_rows).select("digit"), "large-groups")
        if large.isEmpty():
            parts.append(_second_pass(around, config))
        else:
            parts.append(_second_pass(around.join(large, "digit", "left_anti"), config))
            parts.append(_window_pass(around.join(large, "digit", "left_semi"), config))
    marks = parts[0]
    for part in parts[1:]:
        marks = marks.unionByName(part)
    marks = materialize(_merge_marks(marks), "marks")
    return marks, marks.count()


def merge_spans(starts: list[int] | None, stops: list[int] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, within a text of ``size`` bytes."""
    if not starts:
        return []
    order = sorted(zip(starts, stops))
    out = [list(order[0])]
    for a, b in order[1:]:
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out if a < size]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans cut back to whole characters, so that what is left is still UTF-8."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_marks(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    marks, n = repeated_bytes(docs, config)
    per_doc = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("from_byte").alias("_starts"), F.collect_list("to_byte").alias("_stops"))
    return _beside_texts(docs, per_doc, n <= config.broadcast_rows, "left")


def suffix_dedup_report(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte goes if a ``depth``-byte string that covers it also starts earlier: in a smaller
    doc_id, or before in the same one. Null texts are empty. Rows with a null doc_id are left
    whole and are no one's earlier copy; rows that repeat a doc_id are one document, so equal
    rows are equally treated. Other columns are not read.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in batches(whole, "text"):
                out = []
                for raw, starts, stops in zip(as_bytes(batch.column("text")), batch.column("_starts").to_pylist(), batch.column("_stops").to_pylist()):
                    raw = raw or b""
                    spans, state, at = merge_spans(starts, stops, len(raw)), hashlib.sha256(), 0
                    for a, b in spans:
                        state.update(raw[at:a])
                        at = b
                    state.update(raw[at:])
                    out.append((len(raw), sum(b - a for a, b in spans), len(spans), [{"start": a, "stop": b} for a, b in spans], state.hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
                )

    return _with_marks(docs.select("doc_id", "text"), config).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``, to whole characters.

    A document of which nothing but white space is left goes; one that had no words before
    stays. Other columns stay as they are; rows with a null doc_id or text are left whole.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, starts, stops):
            if text is None or a is None or not len(a):
                out.append(text)
                continue
            raw = text.encode("utf-8")
            left, at = [], 0
            for s, e in whole_characters(raw, merge_spans(list(map(int, a)), list(map(int, b)), len(raw))):
                left.append(raw[at:s])
                at = e
            rest = b"".join([*left, raw[at:]])
            out.append(rest.decode("utf-8") if at and rest.strip() else None if at else text)
        return pd.Series(out, dtype="object")

    # Other columns travel in a struct, so that none of them can clash with the marks.
    inner = docs.select("doc_id", "text", F.struct(*docs.columns).dropFields("text").alias("row"))
    marked = _with_marks(inner, config).withColumn("_cut", cut("text", "_starts", "_stops"))
    return marked.where(F.col("_cut").isNotNull() | F.col("text").isNull()).select(
        *[F.col("_cut").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )
