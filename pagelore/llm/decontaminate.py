"""Benchmark decontamination: spaced seeds.

A seed is a fixed mask over neighbouring words: some positions are hashed, the others are
ignored, so a substituted word spoils only the seeds that look at it. The masks are chosen so
that whatever words the rule allows to differ, some seed sees none of them. Hashes of the training
texts are joined with those of the benchmark items; a hit says how item and text line up, and
around it the two are compared word by word. Everything is a column expression; the texts
are not shuffled unless the benchmark, or what was found, is too large to be sent to all executors.
Seeds carry no words: these are fetched once per item and text that a hit lines up.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import small_or_shuffled
from pagelore.operators.joins import join_unique
from pagelore.session import materialize


def lost_patterns(masks: tuple[str, ...], n: int, wrong: int) -> int:
    """In how many of the ways to change ``wrong`` of ``n`` words no mask at any place looks at unchanged words only."""
    seen = [
        {i + o for o, c in enumerate(mask) if c == "1"}
        for mask in masks for i in range(n - len(mask) + 1)
    ]
    return sum(not any(s.isdisjoint(changed) for s in seen) for changed in combinations(range(n), wrong))


@dataclass(frozen=True)
class SeedConfig:
    #: 1: the word is hashed; 0: it is ignored. Every mask begins and ends with 1.
    masks: tuple[str, ...] = ("11101011", "110100111")
    #: Masks of items shorter than ``window``, from one word on. Texts are only hashed for the lengths that occur.
    short_masks: tuple[tuple[str, ...], ...] = (
        ("1",), ("11",), ("111",), ("1111",), ("111", "1101"), ("1111", "11011"), ("11011",), ("11011",),
        ("111011",), ("1111", "11011"), ("111101", "110010011"), ("11111", "111011"),
    )
    #: A text is contaminated by an item if, in some stretch of ``window`` aligned words (or the
    #: whole item if it is shorter), ``match_percent`` of the words agree.
    window: int = 13
    match_percent: int = 80
    #: Seed rows sent to all executors at most, and bytes of seeds or of item words.
    broadcast_seeds: int = 2_000_000
    broadcast_bytes: int = 192 << 20

    def masks_of(self, n: int) -> tuple[str, ...]:
        """The masks of items of ``n`` words."""
        return self.masks if n >= self.window else self.short_masks[n - 1]

    def __post_init__(self) -> None:
        # Whatever words the rule allows to differ, one seed has to be clean of them.
        for n in range(1, self.window + 1):
            if lost_patterns(self.masks_of(n), n, n * (100 - self.match_percent) // 100):
                raise ValueError(f"masks lose matches of {n} words")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    # Everything else becomes one blank, and blanks at the ends go, so the split has no empty parts.
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _seed_hashes(hashes: Column, size: Column, masks: list[str]) -> Column:
    """For every mask and place: struct(at, seed). ``hashes`` are the words' 64-bit hashes."""

    def seeds(mask: str) -> Column:
        at = [i for i, c in enumerate(mask) if c == "1"]
        places = F.when(size >= len(mask), F.sequence(F.lit(0), size - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(int(mask, 2)), *[F.get(hashes, i + o) for o in at]).alias("seed"))
        )

    return F.concat(*[seeds(mask) for mask in masks])


#: Bytes of a seed row in memory: its four numbers, their header and its place in the table.
SEED_BYTES = 64


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, item (its words) of every item with words, repeated rows once."""
    tokens = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    return tokens.select(F.xxhash64("item_id", "item").alias("item_key"), "item_id", "item")


def item_seeds(items: DataFrame, config: SeedConfig) -> DataFrame:
    """item_key, n_item (its words), item_at, seed: by the masks for the item's number of words."""
    hashed = items.select("item_key", F.size("item").alias("n_item"), F.transform("item", lambda w: F.xxhash64(w)).alias("h"))
    found = _seed_hashes(F.col("h"), F.col("n_item"), list(config.masks))
    for n in range(1, config.window):
        found = F.when(F.col("n_item") == n, _seed_hashes(F.col("h"), F.col("n_item"), list(config.masks_of(n)))).otherwise(found)
    rows = hashed.select("item_key", "n_item", F.explode(found).alias("s"))
    return rows.select("item_key", "n_item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, config: SeedConfig = SeedConfig()) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, doc_from, n_aligned, n_matched, best_matched.

    One row per pair, for its best alignment (ties: the first place). ``doc_from`` is the place
    of the item's first word in the document, counted in words, and may be negative where
    the text begins inside the item; ``n_aligned`` words of both lie against each other, of
    which ``n_matched`` agree; ``best_matched`` is the best stretch's count. Null and empty
    texts and items match nothing; rows with a null id are left out; repeated rows give
    one pair. Other columns are not read.
    """
    known = materialize(item_words(benchmark), "items")
    seeds = materialize(item_seeds(known, config), "item-seeds")
    n_seeds = seeds.count()
    lengths = [r.n for r in seeds.select(F.least("n_item", F.lit(config.window)).alias("n")).distinct().collect()]
    masks = sorted({mask for n in lengths for mask in config.masks_of(n)}) or list(config.masks)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    hashed = texts.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    found = _seed_hashes(F.col("h"), F.size("h"), masks)
    placed = hashed.select("doc_id", F.explode(found).alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    small = n_seeds <= config.broadcast_seeds and n_seeds * SEED_BYTES <= config.broadcast_bytes
    # Narrow rows first: one for every way an item lies against a text, whatever the number of seeds that say so.
    start = (F.col("at") - F.col("item_at")).alias("doc_from")
    hits = placed.join(F.broadcast(seeds) if small else seeds, "seed").select("doc_id", "item_key", "n_item", start).distinct()
    hits = materialize(hits, "hits")
    # Then the words: those of the texts that were hit, cut to what lies against the item, and the item's own.
    n_hits = hits.count()
    ids = hits.select("doc_id").distinct()
    touched = texts.join(small_or_shuffled(ids, n_hits), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    theirs = touched.join(small_or_shuffled(hits, n_hits), "doc_id").select(
        "doc_id", "item_key", "doc_from",
        F.slice("w", F.greatest("doc_from", F.lit(0)) + 1, F.col("n_item") + F.least("doc_from", F.lit(0))).alias("theirs"),
    )
    # 24 bytes are what a word takes in an array besides its letters.
    held = known.agg(F.sum(F.aggregate("item", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 24))).first()[0] or 0
    if small and held <= config.broadcast_bytes:
        both = theirs.join(F.broadcast(known), "item_key")
    else:
        both = join_unique(theirs, known, "item_key", "doc_id")
    # Words of the text against words of the item, from the first place both have.
    lined_up = both.select(
        "doc_id", "item_id", "doc_from", "theirs",
        F.slice("item", F.greatest(-F.col("doc_from"), F.lit(0)) + 1, F.size("item")).alias("ours"),
        F.size("item").alias("n_item"),
    )
    n = F.least(F.size("theirs"), F.size("ours"))
    agree = F.transform(F.slice("ours", 1, n), lambda x, i: (x == F.get("theirs", i)).cast("int"))
    span = F.least(F.lit(config.window), F.col("n_item"))
    checked = lined_up.select("doc_id", "item_id", "doc_from", n.alias("n_aligned"), agree.alias("agree"), span.alias("span"))
    sums = F.transform(F.sequence(F.lit(0), F.col("n_aligned") - F.col("span")), lambda i: F.aggregate(F.slice("agree", i + 1, F.col("span")), F.lit(0), lambda a, x: a + x))
    judged = (
        checked.where(F.col("n_aligned") >= F.col("span"))
        .withColumn("best_matched", F.array_max(sums))
        .where(F.col("best_matched") * 100 >= F.col("span") * config.match_percent)
        .withColumn("n_matched", F.aggregate("agree", F.lit(0), lambda a, x: a + x))
    )
    best = judged.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_matched", (-F.col("doc_from")).alias("neg_from"), "n_aligned", "best_matched")).alias("b")
    )
    return best.select("doc_id", "item_id", (-F.col("b.neg_from")).alias("doc_from"), "b.n_aligned", "b.n_matched", "b.best_matched")
