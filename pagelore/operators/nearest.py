"""Exact nearest points of a batch of questions.

A task keeps a running top-k per question while it streams its share of the points by id, so
neither the question x point product nor any ungrouped list of it is ever materialised, and
the shuffle afterwards carries at most k rows per question and task. Questions that fit
one block are sent to all tasks. More of them are dealt to blocks and the points to splits, both as
rows; each pair of a block and a split is one group of one job, and the top-k of the pairs
are merged. Nothing but sizes and a bounded sample of points passes the driver then.

Where there is much work, every question first meets a sample of the points. The k-th of the best scores
of groups of it is one that its k-th best of all points reaches, so all tasks start from that bar: what lies
below it is no result, whatever the points are, and need not be scored exactly, ranked or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.operators.first_wins import first_per_key
from pagelore.session import materialize

# Scores held at once by a task: so many questions by so many points.
_TILE_QUESTIONS = 512
_TILE_POINTS = 512
# Points after which the hits of all their tiles are ranked at once.
_STEP_POINTS = 8192
# Partial results that may reach the shuffle, as far as there is a task for every core.
_PARTIAL_ROWS = 10_000_000
# Pairs of a question and a point for which the points are worth a shuffle.
_DEALT_PAIRS = 10_000_000
# Pairs that a task scores in about the time that one more partial result takes. The sample has the share of the
# points at which both cost the least, as far as its vectors in single precision fit one block.
_PAIRS_PER_PARTIAL = 2_500
# Groups of the sample of which a question keeps the best score each, for every wanted row and at least.
_CELLS_PER_RESULT = 16
_CELLS = 512
# By so much each sample of the points is larger than the one before, where questions are dealt to blocks.
_GROWTH = 4
# More hits than this per wanted row, and a tile is cut down before its scores are computed exactly.
_HITS_PER_RESULT = 4


def _as_matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Rows as unit vectors; a NULL, odd-sized or zero vector becomes a zero row."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = lengths == dimension
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if good.all():
        matrix = flat.reshape(-1, dimension)
    else:
        matrix = np.zeros((len(lengths), dimension))
        matrix[good] = flat[np.repeat(good, lengths)].reshape(-1, dimension)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0.0)


def _as_whole_matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """``_as_matrix`` of many rows, whose copies on the way are those of a few of them."""
    matrix = np.empty((len(vectors), dimension))
    for at in range(0, len(vectors), _STEP_POINTS):
        matrix[at : at + _STEP_POINTS] = _as_matrix(vectors.slice(at, _STEP_POINTS), dimension)
    return matrix


def _true_places(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a flat mask that is false nearly everywhere, eight flags at a time."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    places = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[flags[places]], whole + np.flatnonzero(flags[whole:])])


def _margin(dimension: int, decimals: int) -> float:
    """More than a score in single precision and the rounded exact one can be apart."""
    return 10.0**-decimals + 2.0 * (dimension + 4) * 2.0**-24


def _least_scores(matrix: np.ndarray, sample: np.ndarray, k: int, decimals: int) -> np.ndarray:
    """For each question a score that its k-th best of the sample reaches; minus infinity below k points.

    The sample is dealt to groups, and the best score of each group kept. The k-th best of these
    is reached by k points at least, whatever the groups are, and no point has to be ranked.
    """
    cells = max(_CELLS, _CELLS_PER_RESULT * k)
    coarse, least = matrix.astype(np.float32), np.empty(len(matrix))
    for first in range(0, len(matrix), _TILE_QUESTIONS):
        rows = coarse[first : first + _TILE_QUESTIONS]
        best = np.full((len(rows), cells), -np.inf, np.float32)
        room = np.empty(best.size, np.float32)
        for at in range(0, len(sample), cells):
            points = sample[at : at + cells]
            scores = np.matmul(rows, points.T, out=room[: len(rows) * len(points)].reshape(len(rows), len(points)))
            kept = best[:, : len(points)]
            np.fmax(kept, scores, out=kept)
        least[first : first + len(rows)] = np.partition(best, cells - k, axis=1)[:, cells - k]
    return least - _margin(matrix.shape[1], decimals)


class _Top:
    """The running top-k of a block of questions over points that come in the order of their ids.

    Of equal scores the earlier point wins, so a later one has to be better than the k-th so far.
    Tiles are scored in single precision; what could reach the k-th best is scored again in
    double precision, and only the questions that it betters are sorted anew. ``least`` has a score for each
    question below which nothing is wanted.
    """

    def __init__(self, names: list[str], matrix: np.ndarray, k: int, decimals: int, least: np.ndarray | None = None) -> None:
        self.names, self.matrix, self.k, self.decimals = names, matrix, k, decimals
        self.least = np.full(len(names), -np.inf) if least is None else least
        self.score = np.full((len(names), k), -np.inf)
        self.place = np.full((len(names), k), np.iinfo(np.int64).max)
        # A question without direction scores 0 everywhere, and no cosine is above 1.
        self.highest = np.where(matrix.any(axis=1), 1.0, 0.0)
        # Rounding moves a score by half a step, single precision by less than the other term.
        self.margin = _margin(matrix.shape[1], decimals)
        # One tile's scores, written over by the next one.
        self.room = np.empty(_TILE_QUESTIONS * _TILE_POINTS, np.float32)
        self.ids: list[pa.Array] = []
        self.seen = 0

    def add(self, ids: pa.Array, points: np.ndarray) -> None:
        # A copy, since a slice would keep the vectors of its batch.
        self.ids.append(ids.take(pa.array(np.arange(len(ids)))))
        coarse, at = points.astype(np.float32), 0
        while at < len(points):
            # Short steps first: they set the bar for the longer ones.
            upto = at + min(_STEP_POINTS, max(2 * self.k, self.seen))
            for first in range(0, len(self.names), _TILE_QUESTIONS):
                self._step(slice(first, first + _TILE_QUESTIONS), points[at:upto], coarse[at:upto])
            self.seen += len(points[at:upto])
            at = upto

    def _step(self, part: slice, points: np.ndarray, coarse: np.ndarray) -> None:
        score, place, least = self.score[part], self.place[part], self.least[part]
        floor = score[:, -1]
        bar = np.where(floor >= self.highest[part], np.inf, np.maximum(floor, least) - self.margin).astype(np.float32)[:, None]
        rows = self.matrix[part].astype(np.float32)
        tiles = [self._hits(rows, coarse[at : at + _TILE_POINTS], bar) for at in range(0, len(points), _TILE_POINTS)]
        question = np.concatenate([q for q, _ in tiles])
        row = np.concatenate([r + i * _TILE_POINTS for i, (_, r) in enumerate(tiles)])
        for at in range(0, len(row), _TILE_POINTS * 64):
            some = slice(at, at + _TILE_POINTS * 64)
            self._merge(score, place, self.matrix[part], points, question[some], row[some], least)

    def _hits(self, rows: np.ndarray, coarse: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, row) of what could reach the bar in a tile; most questions have no such row."""
        k, width = self.k, len(coarse)
        scores = np.matmul(rows, coarse.T, out=self.room[: len(rows) * width].reshape(len(rows), width))
        # Asked this way round, a score that is no number hides no other one.
        open_ = np.flatnonzero(~(scores.max(axis=1) < bar[:, 0]))
        scores = scores[open_]
        hits = scores >= bar[open_]
        if width > k and np.count_nonzero(hits) > _HITS_PER_RESULT * k * len(scores):
            kth = np.partition(np.where(hits, scores, -np.inf), width - k, axis=1)[:, width - k, None]
            hits &= scores >= kth - np.float32(self.margin)
        question, row = np.divmod(_true_places(hits.ravel()), width)
        return open_[question], row

    def _merge(self, score, place, matrix, points, question, row, least) -> None:
        """Put the hits that better a question's k-th score into its row of ``score`` and ``place``."""
        k = self.k
        # Adding zero turns a rounded -0.0 into 0.0.
        exact = np.round(np.einsum("ij,ij->i", matrix[question], points[row]), self.decimals) + 0.0
        better = (exact > score[question, -1]) & (exact >= least[question])
        question, row, exact = question[better], row[better], exact[better]
        if not len(row):
            return
        touched = np.unique(question)
        owner = np.concatenate([np.repeat(touched, k), question])
        scores = np.concatenate([score[touched].ravel(), exact])
        places = np.concatenate([place[touched].ravel(), row + self.seen])
        order = np.lexsort((places, -scores, owner))
        best = order[np.searchsorted(owner[order], touched)[:, None] + np.arange(k)]
        score[touched], place[touched] = scores[best], places[best]

    def columns(self) -> list[pa.Array]:
        question, rank = np.nonzero(self.score > -np.inf)
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.string())
        return [
            pa.array(self.names, pa.string()).take(pa.array(question)),
            ids.take(pa.array(self.place[question, rank])),
            pa.array(self.score[question, rank]),
        ]


_FOUND = "query_id string, id string, score double"


def _scanner(questions, dimension: int, k: int, decimals: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, least = questions.value
        top = _Top(names, matrix, k, decimals, least)
        for batch in batches:
            top.add(batch.column(0), _as_matrix(batch.column(1), dimension))
        columns = top.columns()
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    return scan


def _pair_scanner(dimension: int, k: int, decimals: int):
    def scan(points: pa.Table, questions: pa.Table) -> pa.Table:
        names = questions.column("query_id").to_pylist()
        vectors = questions.column("vector").combine_chunks()
        matrix = _as_whole_matrix(vectors, dimension) if names else np.zeros((0, dimension))
        top = _Top(names, matrix, k, decimals, questions.column("least").to_numpy())
        if names and len(points):
            ids, vectors = (points.column(c).combine_chunks() for c in ("id", "vector"))
            order = pc.sort_indices(ids)
            # A step at a time, so that a split takes the room of its rows as they were sent.
            for at in range(0, len(order), _STEP_POINTS):
                some = order.slice(at, _STEP_POINTS)
                top.add(ids.take(some), _as_matrix(vectors.take(some), dimension))
        return pa.Table.from_arrays(top.columns(), names=["query_id", "id", "score"])

    return scan


def _paired(points: DataFrame, questions: DataFrame, dimension: int, k: int, decimals: int, blocks: int, splits: int) -> DataFrame:
    """Top-k of every pair of a block of questions and a split of points, as one job of blocks x splits groups."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides need the keys in one type: an int and a long of one value are dealt to different tasks.
    one = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = points.select("id", "vector", one("id", splits).alias("split"), every(blocks).alias("block"))
    right = questions.select("query_id", "vector", "least", one("query_id", blocks).alias("block"), every(splits).alias("split"))
    pairs = left.groupBy("block", "split").cogroup(right.groupBy("block", "split"))
    return pairs.applyInArrow(_pair_scanner(dimension, k, decimals), _FOUND)


def _with_least(points: DataFrame, questions: DataFrame, dimension: int, k: int, decimals: int, share: float) -> DataFrame:
    """``questions`` with ``least``, a score that their k-th best among a sample of the points reaches.

    Any sample gives a right bar, so results do not depend on which points are drawn. Where it has
    fewer than k points, the bar is below all scores.
    """
    context = points.sparkSession.sparkContext
    vectors = points.select("vector")
    drawn = (vectors if share >= 1.0 else vectors.sample(share, 0)).toArrow().column("vector").combine_chunks()
    shared = context.broadcast(_as_matrix(drawn, dimension).astype(np.float32))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _as_matrix(batch.column("vector"), dimension)
            yield batch.append_column("least", pa.array(_least_scores(matrix, shared.value, k, decimals)))

    spread = questions.select("query_id", "vector").repartition(4 * context.defaultParallelism)
    return materialize(spread.mapInArrow(least, questions.select("query_id", "vector", F.lit(0.0).alias("least")).schema), "least")


def _with_kth(found: DataFrame, questions: DataFrame, k: int, decimals: int) -> DataFrame:
    """``questions`` with ``least`` raised to the k-th best score found among some of the points."""
    order = [F.col("score").desc(), F.col("id")]
    kth = with_rank(first_per_key(found, ["query_id"], order, k)).filter(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("_asked"), (F.col("score") - 10.0**-decimals).alias("_kth"))
    raised = questions.join(kth, F.col("query_id").eqNullSafe(F.col("_asked")), "left")
    return materialize(raised.select("query_id", "vector", F.greatest("least", "_kth").alias("least")), "least")


def nearest_points(
    points: DataFrame,
    questions: DataFrame,
    k: int,
    decimals: int = 9,
    block_bytes: int = 64 << 20,
    tasks: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` most similar points of every question.

    ``points`` has ``id`` and ``vector``, ``questions`` has ``query_id`` and ``vector``.
    A task holds one block of questions, of about ``block_bytes`` at most, and of the points a
    batch or, if there are more questions, a split of as many bytes.
    """
    spark = points.sparkSession
    questions = questions.select(
        F.col("query_id").cast("string").alias("query_id"), "vector"
    ).filter(F.col("vector").isNotNull())
    size = questions.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")
    ).first()
    empty = spark.createDataFrame([], "query_id string, id string, score double, rank int")
    if not size.n:
        return empty
    blocks = -(-size.n * size.d * 8 // block_bytes)
    context = spark.sparkContext
    scanned = points.select(F.col("id").cast("string").alias("id"), "vector")
    cores = context.defaultParallelism
    stored = points.count()
    much = size.n * stored > _DEALT_PAIRS
    if much:
        # A bar from a share of the points lets k / share of them pass.
        share = min(1.0, (k * _PAIRS_PER_PARTIAL / stored) ** 0.5, block_bytes / (4.0 * max(1, size.d) * stored))
        questions = _with_least(scanned, questions, size.d, k, decimals, share)
    else:
        questions = questions.withColumn("least", F.lit(float("-inf")))
    if blocks > 1:
        # The points are sent once for every block and the questions once for every split, so both count what
        # is sent, not its copies in double precision, of which a task has a step of the points at a time.
        sent = lambda rows, table: -(-rows * size.d * _width(table) // block_bytes)
        blocks = max(2, sent(size.n, questions))
        fill = -(-2 * cores // blocks)
        # The first sample fits one block. Of many points that leaves k / share partial results for a question,
        # so larger samples, which are dealt like the points, raise the bar until a few times k are left.
        while much and share * _GROWTH <= 0.5:
            share *= _GROWTH
            some = max(fill, sent(int(stored * share) + 1, scanned))
            drawn = _paired(scanned.sample(share, 0), questions, size.d, k, decimals, blocks, some)
            questions = _with_kth(drawn, questions, k, decimals)
        splits = max(fill, sent(stored, scanned))
        found = _paired(scanned, questions, size.d, k, decimals, blocks, splits)
    else:
        # Every task sends up to k rows per question, so many questions call for longer tasks. Much work is
        # dealt anew: a stored table may be one file, and so one task, however many questions there are.
        tasks = tasks or max(cores, min(4 * cores, _PARTIAL_ROWS // (size.n * k)))
        scanned = scanned.repartition(tasks, "id") if much else scanned.coalesce(tasks)
        table = questions.toArrow()
        matrix = _as_matrix(table.column("vector").combine_chunks(), size.d)
        shared = context.broadcast((table.column("query_id").to_pylist(), matrix, table.column("least").to_numpy()))
        found = scanned.sortWithinPartitions("id").mapInArrow(_scanner(shared, size.d, k, decimals), _FOUND)
    order = [F.col("score").desc(), F.col("id")]
    return with_rank(first_per_key(found, ["query_id"], order, k))


def _width(table: DataFrame) -> int:
    """Bytes of one component of the vectors, as rows hold them."""
    return 4 if isinstance(table.schema["vector"].dataType.elementType, T.FloatType) else 8


def with_rank(top: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return top.withColumn("rank", F.row_number().over(order))
