"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star edges.

1.  Every text becomes its set of word shingles, hashed to 64 bits; one pass over the sorted
    hashes gives the minimum of each bin, and empty bins borrow from bins drawn at random
    (optimal densification). The bins are cut into bands.
2.  Texts with one set are one node. Nodes that share a band's bucket get an edge to the
    smallest node of the bucket only, so a bucket of n gives n - 1 edges, not n * n / 2.
3.  Components of these edges are candidate clusters: nodes of different clusters share no
    bucket. Inside a cluster every pair that could be similar enough is settled on the full
    sets, so a pair that shares a bucket with a common, dissimilar centre is not lost.
    A prefix filter (a pair as similar as that shares one of the rarest shingles) and
    components that are joined already leave few pairs to look at.
4.  A cluster too large for one task is settled by rounds: some nodes at a time are sent to
    all parts of the cluster, until those that have not been sent lie in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import as_bytes, batches, mix64, small_batches, small_or_shuffled
from pagelore.llm.components import components
from pagelore.session import materialize


@dataclass(frozen=True)
class MinHashConfig:
    words: int = 5
    #: Percent of the union that two sets have to share.
    percent: int = 80
    bins: int = 128
    band_rows: int = 4
    #: Shingles of a cluster that one task settles; larger ones go by rounds.
    cluster_shingles: int = 6_000_000
    #: Nodes and shingles sent in one round.
    round_nodes: int = 256
    round_shingles: int = 2_000_000
    cache_words: int = 400_000


class Shingles:
    """Distinct shingles of a text as sorted, scrambled 64-bit hashes of its lower-cased words."""

    def __init__(self, config: MinHashConfig) -> None:
        self.config, self.known = config, {}
        rng = np.random.default_rng(2017)
        self.odd = rng.integers(1 << 62, size=config.words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _new(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= self.config.cache_words:
            self.known.clear()
        code = xxhash.xxh3_64_intdigest(word)
        self.known[word] = code
        return code

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        get, new = self.known.get, self._new
        codes = np.array([get(w) or new(w) for w in words], dtype=np.uint64)
        k = min(self.config.words, len(codes))
        total = np.full(len(codes) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            total += mix64(codes[i : len(codes) - k + 1 + i] * self.odd[i])
        return np.unique(mix64(total))


class OnePermutation:
    """Band hashes of a sorted set of hashes; the top bits of a hash name its bin."""

    def __init__(self, config: MinHashConfig) -> None:
        self.bins, self.rows = config.bins, config.band_rows
        shift = np.uint64(64 - int(np.log2(config.bins)))
        self.edges = np.arange(config.bins, dtype=np.uint64) << shift
        rng = np.random.default_rng(1729)
        #: Where an empty bin looks, attempt by attempt; the same for all texts.
        self.donors = rng.integers(config.bins, size=(4096, config.bins))
        self.odd = rng.integers(1 << 62, size=(config.bins // config.band_rows, config.band_rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.append(np.searchsorted(hashes, self.edges), len(hashes))
        full = at[1:] > at[:-1]
        source = np.arange(self.bins)
        empty = np.flatnonzero(~full)
        for attempt in self.donors:
            if not len(empty):
                break
            donor = attempt[empty]
            hit = full[donor]
            source[empty[hit]] = donor[hit]
            empty = empty[~hit]
        source[empty] = np.flatnonzero(full)[0]  # after so many attempts: the first full bin
        least = hashes[at[:-1][source]].reshape(-1, self.rows)
        return mix64((mix64(least * self.odd)).sum(axis=1, dtype=np.uint64) + np.arange(len(least), dtype=np.uint64))


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def signatures(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """Per row: the size of its shingle set, a 128-bit key of the set, and its band hashes (none for an empty set)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, bands = Shingles(config), OnePermutation(config)
        for whole in stream:
            for batch in batches(whole, "text"):
                sizes, keys, rows = [], [], []
                for text in as_bytes(batch.column("text")):
                    found = shingles(text)
                    sizes.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    rows.append(bands(found).view(np.int64) if len(found) else np.zeros(0, dtype=np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, SIGNATURE_SCHEMA)


def star_edges(nodes: DataFrame) -> DataFrame:
    """Every node of a bucket to the smallest of it: u, v. ``nodes`` has doc_id and bands."""
    placed = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    centres = placed.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("other"))
    return (
        placed.join(centres.where(F.col("centre") != F.col("other")).drop("other"), "bucket")
        .where(F.col("doc_id") != F.col("centre"))
        .select(F.col("doc_id").alias("u"), F.col("centre").alias("v")).distinct()
    )


def link_cluster(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Per set, the smallest id reachable through pairs with 100 * shared >= percent * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), dtype=np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    codes = rank[codes]
    owner = np.repeat(np.arange(m), sizes)
    by_code = np.lexsort((owner, codes))
    posting, first = owner[by_code], np.searchsorted(codes[by_code], np.arange(len(times) + 1))
    ordered = codes[np.lexsort((codes, owner))]
    part = np.arange(m)
    members = {i: [i] for i in range(m)}

    def join(a: int, b: int) -> None:
        a, b = part[a], part[b]
        if a == b:
            return
        if len(members[a]) < len(members[b]):
            a, b = b, a
        part[members[b]] = a
        members[a] += members.pop(b)

    same = {}
    for i, key in enumerate(ids.tolist()):
        if key in same:
            join(same[key], i)
        same.setdefault(key, i)
    present = np.zeros(len(times), dtype=bool)
    for p in range(m):
        n = int(sizes[p])
        mine = ordered[starts[p] : starts[p + 1]]
        prefix = mine[: n - -(-percent * n // 100) + 1]
        found = np.unique(np.concatenate([posting[first[c] : first[c + 1]] for c in prefix.tolist()]))
        found = found[(found > p) & (part[found] != part[p]) & (100 * np.minimum(sizes[found], n) >= percent * np.maximum(sizes[found], n))]
        if not len(found):
            continue
        present[mine] = True
        for q in found.tolist():
            if part[q] != part[p]:
                shared = int(np.count_nonzero(present[ordered[starts[q] : starts[q + 1]]]))
                if 100 * shared >= percent * (n + int(sizes[q]) - shared):
                    join(p, q)
        present[mine] = False
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids)
    return least[part]


def _sets(docs: DataFrame, clusters: DataFrame, config: MinHashConfig) -> DataFrame:
    """doc_id, cluster and the shingle set of every node in ``clusters``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(config)
        for whole in stream:
            for batch in batches(whole, "text"):
                sets = [shingles(t).tobytes() for t in as_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cluster"), pa.array(sets, pa.binary())], ["doc_id", "cluster", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = small_or_shuffled(clusters, clusters.count())
    return texts.join(narrow, "doc_id").mapInArrow(run, "doc_id long, cluster long, hashes binary").where(F.length("hashes") > 0)


def _settle_small(sets: DataFrame, config: MinHashConfig) -> DataFrame:
    """node and root, by clusters that fit into a task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, ids, sets = None, [], []

        def settle() -> pa.RecordBatch:
            nodes = np.array(ids, dtype=np.int64)
            roots = link_cluster(nodes, sets, config.percent) if ids else nodes
            ids.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots, pa.int64())], ["node", "root"])

        for batch in stream:
            for c, i, hashes in zip(*(batch.column(k).to_pylist() for k in ("cluster", "doc_id", "hashes"))):
                if c != cluster and ids:
                    yield settle()
                cluster = c
                ids.append(i)
                sets.append(np.frombuffer(hashes, dtype=np.uint64))
        if ids:
            yield settle()

    return sets.repartition("cluster").sortWithinPartitions("cluster", "doc_id").mapInArrow(run, "node long, root long")


def _settle_large(sets: DataFrame, config: MinHashConfig) -> DataFrame:
    """node and root, by rounds over stored sets: some nodes at a time meet all others of their cluster."""
    stored = materialize(sets, "large-clusters")
    roots = materialize(stored.select(F.col("doc_id").alias("node"), "cluster", F.col("doc_id").alias("root")).distinct(), "roots")
    sent = None
    while True:
        # Open: clusters of more than one component; of their nodes the unsent ones, those of small components first.
        parts = roots.groupBy("cluster", "root").agg(F.count("*").alias("members"))
        apart = parts.groupBy("cluster").agg(F.count("*").alias("n"), F.max("members").alias("greatest")).where("n > 1")
        waiting = roots.join(parts, ["cluster", "root"]).join(apart, "cluster")
        if sent is not None:
            waiting = waiting.join(sent, "node", "left_anti")
            order = (F.col("members") == F.col("greatest")).cast("int")
        else:
            order = F.col("members") * 0
        # Only two unsent nodes of different components can still be an unseen link.
        unsettled = waiting.groupBy("cluster").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("cluster")
        waiting = waiting.join(unsettled, "cluster", "left_semi")
        chosen = [r.node for r in waiting.orderBy(order, F.xxhash64("node"), "node").select("node").limit(config.round_nodes).collect()]
        if not chosen:
            return roots.select("node", "root")
        # A bounded number of sets; where they are large, fewer of them.
        picked, held = [], 0
        for r in stored.where(F.col("doc_id").isin(chosen)).toLocalIterator():
            if picked and held + len(r.hashes) // 8 > config.round_shingles:
                break
            picked.append((r.cluster, r.doc_id, bytes(r.hashes)))
            held += len(r.hashes) // 8
        now = {p[1] for p in picked}
        spark = stored.sparkSession
        added = spark.createDataFrame([(n,) for n in sorted(now)], "node long")
        sent = materialize(added if sent is None else sent.unionAll(added), "sent")
        pivots = spark.sparkContext.broadcast(picked)

        def run(stream: Iterator[pa.RecordBatch], pivots=pivots) -> Iterator[pa.RecordBatch]:
            by_cluster: dict[int, list] = {}
            for c, i, hashes in pivots.value:
                by_cluster.setdefault(c, []).append((i, np.frombuffer(hashes, dtype=np.uint64)))
            for batch in stream:
                u, v = [], []
                for c, i, hashes in zip(*(batch.column(k).to_pylist() for k in ("cluster", "doc_id", "hashes"))):
                    mine = np.frombuffer(hashes, dtype=np.uint64)
                    for j, other in by_cluster.get(c, ()):
                        small, large = sorted((len(mine), len(other)))
                        if i != j and 100 * small >= config.percent * large:
                            shared = len(np.intersect1d(mine, other, assume_unique=True))
                            if 100 * shared >= config.percent * (small + large - shared):
                                u.append(i)
                                v.append(j)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        links = stored.mapInArrow(run, "u long, v long")
        joined = components(links.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        roots = materialize(
            roots.drop("root").join(joined, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root")), "roots"
        )


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable through pairs of rows whose shingle
    sets share ``percent`` of their union; a row is ``kept`` if it is its own. A text with
    fewer words than a shingle is one shingle. Null and empty texts have no shingles and
    link with nothing. Rows with a null doc_id link with nothing, have component null and
    are kept. Rows that repeat a doc_id share one node. Other columns are not read.
    """
    stored = materialize(signatures(docs, config), "signatures")
    usable = stored.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "sets")
    nodes = usable.join(reps, (usable.set_key == reps.set_key) & (usable.doc_id == reps.rep), "left_semi")
    clusters = materialize(components(star_edges(nodes)), "clusters")
    sized = clusters.withColumnRenamed("root", "cluster").join(
        nodes.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("n")), "node"
    )
    large = sized.groupBy("cluster").agg(F.sum("n").alias("n")).where(F.col("n") > config.cluster_shingles).select("cluster")
    large = materialize(large, "large")
    members = clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    settled = _settle_small(_sets(docs, members.join(large, "cluster", "left_anti"), config), config)
    if not large.isEmpty():
        settled = settled.unionAll(_settle_large(_sets(docs, members.join(large, "cluster", "left_semi"), config), config))
    settled = settled.where(F.col("node") != F.col("root")).distinct()
    found = reps.join(settled, reps.rep == settled.node, "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    return (
        stored.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key"))
        .join(found, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )
