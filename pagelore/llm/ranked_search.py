"""Ranked lexical search of all documents for a set of items, by dense blocked matrix products.

A stated set of items, in groups of bounded size, is searched in all documents:

1.  One pass over the texts keeps, for each document, its length and the counts of those of its
    terms that an item of the group has.
2.  Collection figures (N, L and the documents of each term) are plain aggregates.
3.  Postings become tiles, a bounded number of documents times a bounded number of the
    group's terms, that hold 64-bit impacts as float64; the items' weights are tiles of the same
    terms. Their product is exact: a tile of terms ends where its partial sums could
    reach 2^53, and sums of tiles are added as 64-bit integers.
4.  A task keeps the best k documents of each item, ties by document included; the lists of all
    tasks are merged by a window that takes k rows of each task.

The driver sees a group of items at a time, at most ``group_terms`` pairs of item and term (or
one longer item), never anything about documents but N and L.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import as_bytes, batches, small_batches
from pagelore.session import materialize


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    #: Documents and terms of a tile.
    tile_docs: int = 512
    tile_terms: int = 1024
    #: Items of a tile of scores.
    tile_items: int = 512
    #: Pairs of item and term that are searched in one pass over the documents.
    group_terms: int = 250_000


#: What ends a term becomes a blank: all of ASCII but letters and digits. Only A-Z is lower-cased.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

#: An impact is below (10^9 tf) / (10^3 tf).
MAX_IMPACT = 1_000_000
EXACT = 1 << 53


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _count_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in parts:
        for part in batches(whole, "text"):
            counts = [Counter(terms_of(t)) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id"), pa.array([[t.decode() for t in c] for c in counts], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                names=["item_id", "terms", "counts"],
            )


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, count), each pair once. Rows that repeat an item_id are one item."""
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, terms array<string>, counts array<bigint>"
    rows = small_batches(items.select("item_id", "text")).mapInArrow(_count_terms, schema)
    pairs = rows.select("item_id", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return pairs.groupBy("item_id", F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("count"))


def _postings(numbers: dict[bytes, int]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "text"):
                sizes, ids, counts = [], [], []
                for text in as_bytes(part.column("text")):
                    words = terms_of(text)
                    sizes.append(len(words))
                    held = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                    ids.append(np.fromiter((h[0] for h in held), np.int32, len(held)))
                    counts.append(np.fromiter((h[1] for h in held), np.int64, len(held)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


@dataclass
class ItemMatrix:
    """Weights of a group of items by term, as sorted columns: item row, term number, count times weight."""

    rows: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_items: int

    def tiles(self, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(terms, rows, columns, weights) of tiles of at most ``width`` terms.

        Over a tile, an item's weights times the largest impact stay below 2^53. A weight that
        is too large alone is split into parts that stand in several tiles.
        """
        rows, terms, weights = self.rows, self.terms, self.weights
        part = (EXACT - 1) // MAX_IMPACT
        pieces = np.maximum(1, -(-weights // part))
        if (pieces > 1).any():
            at = np.repeat(np.arange(len(rows)), pieces)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            rows, terms, weights = rows[at], terms[at], np.minimum(part, weights[at] - nth * part)
        out, todo = [], []
        # Parts of one weight lie in different tiles: the n-th part of every pair is taken in turn.
        order = np.lexsort((rows, terms))
        rows, terms, weights = rows[order], terms[order], weights[order]
        same = np.r_[False, (rows[1:] == rows[:-1]) & (terms[1:] == terms[:-1])]
        nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(rows)))) if len(rows) else np.zeros(0, int)
        for turn in range(int(nth.max(initial=-1)) + 1):
            now = nth == turn
            names = np.unique(terms[now])
            todo += [(names[i:i + width], now) for i in range(0, len(names), width)]
        while todo:
            names, now = todo.pop()
            held = np.flatnonzero(now & (terms >= names[0]) & (terms <= names[-1]))
            most = np.bincount(rows[held], weights[held].astype(np.float64), self.n_items).max(initial=0)
            if most * MAX_IMPACT >= EXACT and len(names) > 1:
                half = len(names) // 2
                todo += [(names[:half], now), (names[half:], now)]
            else:
                out.append((names, rows[held], np.searchsorted(names, terms[held]), weights[held]))
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores above 0, ties by ascending id; all ties of the k-th are looked at."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    return found[np.lexsort((ids[found], -scores[found]))][:k]


def impacts(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * counts) // (1_000 * counts + 8 * m)


#: A null id sorts behind all others.
_NO_ID = np.iinfo(np.int64).max


def _scorer(matrix: ItemMatrix, n_docs: int, n_terms: int, n_numbers: int, config: SearchConfig):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = matrix.tiles(config.tile_terms)
        slots = [np.full(n_numbers, -1, np.int32) for _ in tiles]
        for slot, (names, *_) in zip(slots, tiles):
            slot[names] = np.arange(len(names))
        tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(matrix.n_items)]
        for part in parts:
            for start in range(0, part.num_rows, config.tile_docs):
                piece = part.slice(start, config.tile_docs)
                ids = piece.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                n = piece.column("n").to_numpy(zero_copy_only=False)
                lists = piece.column("terms")
                doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
                terms = lists.flatten().to_numpy(zero_copy_only=False)
                impact = impacts(piece.column("counts").flatten().to_numpy(zero_copy_only=False), n[doc], n_docs, n_terms)
                sums = np.zeros((matrix.n_items, len(ids)), np.int64)
                for slot, (names, rows, columns, weights) in zip(slots, tiles):
                    place = slot[terms]
                    held = place >= 0
                    right = np.zeros((len(names), len(ids)))
                    right[place[held], doc[held]] = impact[held]
                    for low in range(0, matrix.n_items, config.tile_items):
                        high = min(low + config.tile_items, matrix.n_items)
                        mine = (rows >= low) & (rows < high)
                        left = np.zeros((high - low, len(names)))
                        left[rows[mine] - low, columns[mine]] = weights[mine]
                        sums[low:high] += (left @ right).astype(np.int64)
                for item in range(matrix.n_items):
                    scores, held_ids = tops[item]
                    hits = sums[item]
                    # A full list takes a document only if it is not behind its last one.
                    at = np.flatnonzero(hits >= scores[-1]) if len(scores) == config.k else np.flatnonzero(hits)
                    if len(at):
                        scores, held_ids = np.r_[scores, hits[at]], np.r_[held_ids, ids[at]]
                        order = best(scores, held_ids, config.k)
                        tops[item] = scores[order], held_ids[order]
        sizes = [len(s) for s, _ in tops]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(matrix.n_items), sizes).astype(np.int32)),
             pa.array(np.concatenate([i for _, i in tops] or [np.zeros(0, np.int64)])),
             pa.array(np.concatenate([s for s, _ in tops] or [np.zeros(0, np.int64)]))],
            names=["row", "doc_id", "score"],
        )

    return run


def _group(docs: DataFrame, pairs: DataFrame, config: SearchConfig) -> DataFrame:
    """The best documents of a group of items: (item_id, doc_id, score), k rows a task and item at most."""
    spark = docs.sparkSession
    # Bounded by ``group_terms``; ids travel as they are.
    held = pairs.orderBy("item_id", "term").toArrow()
    terms, numbers = np.unique(np.array(held.column("term").to_pylist(), dtype=object), return_inverse=True)
    items = held.column("item_id").combine_chunks()
    keys = items.unique()
    place = {k: i for i, k in enumerate(keys.to_pylist())}
    rows = np.array([place[v] for v in items.to_pylist()], np.int64)
    known = {t.encode(): i for i, t in enumerate(terms)}
    schema = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
    source = docs.select(F.col("doc_id").cast("long"), "text")
    postings = materialize(small_batches(source).mapInArrow(_postings(known), schema), "postings")
    n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for term, count in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    matrix = ItemMatrix(rows, numbers, np.array(held.column("count").to_pylist(), np.int64) * weight[numbers], len(keys))
    found = postings.mapInArrow(_scorer(matrix, n_docs, n_terms, len(terms), config), "row int, doc_id bigint, score bigint")
    names = spark.createDataFrame(
        pa.table({"row": pa.array(range(len(keys)), pa.int32()), "item_id": keys}),
        schema=f"row int, item_id {pairs.schema['item_id'].dataType.simpleString()}",
    )
    unmarked = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    return found.join(F.broadcast(names), "row").select("item_id", unmarked.alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item, best first, equal scores by ascending doc_id.

    Items without a term, or whose terms no document has, give no row; fewer hits than k give
    fewer rows. Rows that repeat an item_id count as one item with the terms of all; a null
    item_id is an item too. Rows that repeat a doc_id are documents of their own and may
    each have a rank; a null doc_id ranks behind equal scores. Empty and null texts are no
    documents (N leaves them out). Texts are read whole. Other columns play no part. Empty tables
    give no rows.
    """
    pairs = materialize(item_terms(items), "item-terms")
    groups = max(1, -(-pairs.count() // config.group_terms))
    lane = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    found = reduce(DataFrame.unionByName, [_group(docs, pairs.where(lane == g), config) for g in range(groups)])
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k)
    return ranked.select("item_id", "rank", "doc_id", "score")
