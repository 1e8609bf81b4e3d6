"""Phrases of two to five words whose words stand together more often than chance has it.

Counts are weighted acyclic automata (``automata.py``):

1.  A shard, some megabytes of text in a task, sorts its n-grams and builds an automaton of their
    counts for each prefix range. A range is a hash range of an n-gram's first words, as many
    as the shortest n-grams of the pass have; a first word is spread over an eighth of the ranges.
2.  The task of a range adds the automata of all shards and keeps the phrases that reach the least count.
3.  The parts of all candidates are looked up by composing, range by range, the automaton of
    the counts with the automaton of the parts.

The texts are read three times: for words, for pairs and for three to five words. A phrase that
reaches the least count has only words and pairs that reach it, so after the first pass
n-grams with a rare word, after the second those with a rare pair need no counting. What is
frequent is sent to the tasks as a bit set of fixed size; a phrase that shares a bit with a
frequent one is counted in vain and dropped in its range, so the bit set decides no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.automata import CountAutomaton, Phrase
from pagelore.llm.common import as_bytes, batches, mix64, small_batches
from pagelore.session import materialize


@dataclass(frozen=True)
class CollocationConfig:
    least: int = 100
    longest: int = 5
    per_lang: int = 2000
    #: Bytes of text of a shard.
    shard_bytes: int = 32 << 20
    #: Bits of the set of frequent words, or pairs; a multiple of 32768.
    filter_bits: int = 1 << 26
    #: Phrases and parts of a range that are composed at once.
    range_rows: int = 50_000


#: A-Z is lower-cased, what ends a piece becomes a line feed, a tab a blank.
_FOLD = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)
)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def _extend(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are a word longer."""
    return mix64(hashes * _NEXT + words)


def phrase_hash(lang: str, phrase: Phrase) -> int:
    seed = xxhash.xxh64_intdigest(lang)
    words = np.array([xxhash.xxh64_intdigest(w, seed) for w in phrase], np.uint64)
    out = words[:1]
    for i in range(1, len(words)):
        out = _extend(out, words[i:i + 1])
    return int(out[0])


class _Shard:
    """Some megabytes of text, by language, with line feeds between pieces and blanks between words."""

    def __init__(self) -> None:
        self.texts: dict[str, list[bytes]] = {}
        self.held = 0

    def add(self, lang: str, text: bytes) -> None:
        self.texts.setdefault(lang, []).append(text.translate(_FOLD))
        self.held += len(text)

    def rows(self, shortest: int, longest: int, bits: np.ndarray | None, ranges: int) -> Iterator[tuple[int, str, int, bytes]]:
        """(range, lang, words, automaton); the words of a language are counted in one of its rows."""
        for lang, texts in self.texts.items():
            tokens, names = _numbered(texts)
            seed = xxhash.xxh64_intdigest(lang)
            hashes = np.fromiter((xxhash.xxh64_intdigest(n, seed) for n in names), np.uint64, len(names))
            left = int((tokens >= 0).sum())
            for number, runs in _grams(tokens, hashes, shortest, longest, bits, ranges):
                spelled = ((tuple([names[w] for w in prefix]), [names[w] for w in last], counts) for prefix, last, counts in runs)
                yield number, lang, left, CountAutomaton.build_runs(spelled).to_bytes()
                left = 0
            if left:
                yield 0, lang, left, CountAutomaton.build(()).to_bytes()


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words as places in the sorted list of distinct words, -1 between pieces; and that list."""
    whole = b"\n".join(texts).replace(b"\n", b" \n ")
    coded = pc.split_pattern(pa.array([whole], pa.large_binary()), b" ").flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names = coded.dictionary.take(order).to_pylist()
    # What lies between two blanks, and the line feed, sort before and between the words.
    marks = [i for i, name in enumerate(names) if name in (b"", b"\n")]
    place = np.arange(len(names)) - np.searchsorted(marks, np.arange(len(names)))
    place[marks] = [-2 if names[i] == b"" else -1 for i in marks]
    of_code = np.empty(len(names), np.int64)
    of_code[order.to_numpy()] = place
    tokens = of_code[coded.indices.to_numpy()]
    return tokens[tokens != -2], [name for name in names if name not in (b"", b"\n")]


def _grams(tokens, hashes, shortest, longest, bits, ranges) -> Iterator[tuple[int, Iterator[tuple[list[int], list[int], list[int]]]]]:
    """The distinct n-grams of each range with their counts, in order of their words, as runs that share all but the last."""
    n, width = len(tokens), len(hashes)
    if not width:
        return
    good = tokens >= 0
    ids, digest = tokens.copy(), hashes[tokens]
    # Words of the n-grams that ``ids`` numbers.
    spelled = np.arange(width)[:, None]
    # Windows of one word less than the shortest n-gram are looked up in the bits.
    for length in range(2, shortest):
        shift = length - 1
        good[:n - shift] &= tokens[shift:] >= 0
        good[n - shift:] = False
        digest[:n - shift] = _extend(digest[:n - shift], hashes[tokens[shift:]])
    if bits is not None:
        slots = (digest % np.uint64(8 * len(bits))).astype(np.int64)
        good &= (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
    frequent = good.copy()
    columns, counts = [], []
    for length in range(max(1, shortest - 1), longest + 1):
        at = np.flatnonzero(good)
        shift = length - 1
        if length >= shortest and length > 1:
            at = at[at + shift < n]
            at = at[(tokens[at + shift] >= 0) & frequent[at + length - max(1, shortest - 1)]]
            good = np.zeros(n, bool)
            good[at] = True
        if not len(at):
            break
        if length > 1:
            # Windows below the shortest length are numbered word by word, n-grams by the numbers of their prefixes.
            keys = ids[at] * width + tokens[at + shift]
            found, count = np.unique(keys, return_counts=True)
            spelled = np.column_stack([spelled[found // width], found % width])
            if length < longest:
                ids[at] = np.searchsorted(found, keys)
        elif shortest == 1:
            found, count = np.unique(tokens[at], return_counts=True)
            columns.append(found[:, None])
            counts.append(count)
            continue
        if length >= shortest:
            columns.append(spelled)
            counts.append(count)
    if not columns:
        return
    sizes = np.concatenate([np.full(len(c), c.shape[1]) for c in columns])
    grams = np.concatenate([np.pad(c, ((0, 0), (0, longest - c.shape[1])), constant_values=-1) for c in columns])
    counts = np.concatenate(counts)
    prefix = hashes[grams[:, 0]]
    for i in range(1, shortest - 1):
        prefix = _extend(prefix, hashes[grams[:, i]])
    if shortest > 1:
        # A prefix is spread over an eighth of the ranges by its next word.
        prefix = prefix % np.uint64(ranges) + hashes[grams[:, shortest - 1]] % np.uint64(max(1, ranges // 8))
    number = (prefix % np.uint64(ranges)).astype(np.int32)
    keys = (number,) if len(columns) == 1 else (*grams.T[::-1], number)
    order = np.lexsort(keys)
    grams, counts, number, sizes = grams[order], counts[order], number[order], sizes[order]
    last = grams[np.arange(len(grams)), sizes - 1]
    # A run ends where the range, the length or a word before the last one changes.
    differs = (grams[1:] != grams[:-1]) & (np.arange(longest) != sizes[1:, None] - 1)
    fresh = np.r_[True, differs.any(axis=1) | (sizes[1:] != sizes[:-1]) | (number[1:] != number[:-1])]
    begins = np.flatnonzero(fresh)
    ends = np.r_[begins[1:], len(grams)].tolist()
    prefixes = [g[:k - 1] for g, k in zip(grams[begins].tolist(), sizes[begins].tolist())]
    last, counts, of_run, begins = last.tolist(), counts.tolist(), number[begins], begins.tolist()
    edges = np.flatnonzero(np.r_[True, of_run[1:] != of_run[:-1]]).tolist() + [len(of_run)]
    for a, b in zip(edges, edges[1:]):
        yield int(of_run[a]), ((prefixes[i], last[begins[i]:ends[i]], counts[begins[i]:ends[i]]) for i in range(a, b))


_SHARD_SCHEMA = "range int, lang string, words bigint, automaton binary"
_COUNT_SCHEMA = "lang string, phrase string, f bigint, slot bigint"


def _shards(shortest: int, longest: int, bits: Broadcast | None, ranges: int, config: CollocationConfig):
    def out(shard: _Shard) -> Iterator[pa.RecordBatch]:
        held = [[], [], [], []]
        for row in shard.rows(shortest, longest, None if bits is None else bits.value, ranges):
            for column, value in zip(held, row):
                column.append(value)
            if len(held[0]) == 64:
                yield pa.RecordBatch.from_arrays(_typed(held), names=["range", "lang", "words", "automaton"])
                held = [[], [], [], []]
        yield pa.RecordBatch.from_arrays(_typed(held), names=["range", "lang", "words", "automaton"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for whole in parts:
            for part in batches(whole, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text"))):
                    if text:
                        shard.add(lang, text)
                    if shard.held >= config.shard_bytes:
                        yield from out(shard)
                        shard = _Shard()
        yield from out(shard)

    return run


def _typed(held: list[list]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(held, (pa.int32(), pa.string(), pa.int64(), pa.binary()))]


def _add_up(least: int, filter_bits: int):
    """Automata of a range from all shards -> phrases that reach ``least``, and the words of each language."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[Phrase, int]] = {}
        words: dict[str, int] = {}
        for part in parts:
            for lang, count, data in zip(*(part.column(c).to_pylist() for c in ("lang", "words", "automaton"))):
                words[lang] = words.get(lang, 0) + count
                CountAutomaton.from_bytes(data).add_to(sums.setdefault(lang, {}))
        for lang, counted in sums.items():
            found = list(CountAutomaton.union(counted, least).items())
            slots = [phrase_hash(lang, p) % filter_bits + 1 for p, _ in found]
            total = [words[lang]] if words[lang] else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(found) + len(total)), pa.string()),
                 pa.array([b" ".join(p).decode() for p, _ in found] + [None] * len(total), pa.string()),
                 pa.array([w for _, w in found] + total, pa.int64()), pa.array(slots + [None] * len(total), pa.int64())],
                names=["lang", "phrase", "f", "slot"],
            )

    return run


def count_phrases(docs: DataFrame, shortest: int, longest: int, bits: Broadcast | None, config: CollocationConfig) -> DataFrame:
    """(lang, phrase, f, slot) of phrases that reach the least count; rows without a phrase add up to a language's words."""
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = small_batches(docs).mapInArrow(_shards(shortest, longest, bits, ranges, config), _SHARD_SCHEMA)
    dealt = shards.repartitionById(ranges, F.col("range"))
    return materialize(dealt.mapInArrow(_add_up(config.least, config.filter_bits), _COUNT_SCHEMA), "phrases")


def frequent_bits(counts: DataFrame, config: CollocationConfig) -> Broadcast:
    """The slots of ``counts`` as a bit set of ``filter_bits`` bits, in pieces of 4096 bytes through the driver."""
    spark = counts.sparkSession
    pieces = (
        counts.where(F.col("slot").isNotNull()).groupBy(F.bitmap_bucket_number("slot").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    )
    bits = np.zeros(config.filter_bits // 8, np.uint8)
    for piece, held in pieces:
        bits[(piece - 1) * 4096:piece * 4096] = np.frombuffer(bytes(held), np.uint8)
    return spark.sparkContext.broadcast(bits)


def _compose(counts: pa.Table, parts: pa.Table) -> pa.Table:
    """The counts of one range's parts."""
    def by_lang(table: pa.Table, weights: list[int]) -> dict[str, CountAutomaton]:
        held: dict[str, list] = {}
        for lang, phrase, weight in zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist(), weights):
            held.setdefault(lang, []).append((tuple(phrase.encode().split(b" ")), weight))
        return {lang: CountAutomaton.build(sorted(v)) for lang, v in held.items()}

    known = by_lang(counts, counts.column("f").to_pylist())
    rows = [
        (lang, b" ".join(phrase).decode(), weight)
        for lang, wanted in by_lang(parts, [1] * parts.num_rows).items() if lang in known
        for phrase, weight in known[lang].compose(wanted)
    ]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table({"lang": pa.array(columns[0], pa.string()), "part": pa.array(columns[1], pa.string()), "f": pa.array(columns[2], pa.int64())})


def part_counts(counts: DataFrame, parts: DataFrame, config: CollocationConfig) -> DataFrame:
    """(lang, part, f) of distinct ``parts`` (lang, phrase), by composition in prefix ranges."""
    ranges = max(1, -(-counts.count() // config.range_rows))
    number = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2)), F.lit(ranges)).alias("range")
    left = counts.select(number, "lang", "phrase", "f").groupBy("range")
    right = parts.select(number, "lang", "phrase").groupBy("range")
    return left.cogroup(right).applyInArrow(_compose, "lang string, part string, f bigint")


def score() -> Column:
    """floor(1000 a n / (l r)): the products in decimals of 38 digits, the result at most 1000 n."""
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"({big('1000 * a')} * {big('n')}) DIV ({big('l')} * {big('r')})")


def collocations(docs: DataFrame, config: CollocationConfig = CollocationConfig()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut, ``n`` the words of the
    language; score is floor(1000 a n / (l r)). A phrase inside a longer one that is as frequent
    goes. Ties rank by count, then by phrase in the order of its UTF-8 bytes, so ranks
    are unique. Null and empty texts have no words; a null language is ``und``, together with
    documents that are marked so. Repeated rows count as often as they stand there. Texts are
    read whole. Other columns play no part. An empty table, or one without a frequent phrase,
    gives no rows.
    """
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = count_phrases(texts, 1, 1, None, config)
    pairs = count_phrases(texts, 2, 2, frequent_bits(words, config), config)
    longer = count_phrases(texts, 3, config.longest, frequent_bits(pairs, config), config)
    totals = words.where(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    counts = words.unionByName(pairs).unionByName(longer).where(F.col("phrase").isNotNull()).select("lang", "phrase", "f")
    held = F.split("phrase", " ")
    candidates = counts.withColumn("words", held).where(F.size("words") >= 2)
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"), "words"
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("right"),
    )
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct()
    known = materialize(part_counts(counts, parts, config), "parts")
    lefts = known.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang").withColumn("score", score())
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return _ranked(worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), candidates, config)


def _ranked(scored: DataFrame, candidates: DataFrame, config: CollocationConfig) -> DataFrame:
    long = candidates.where(F.size("words") >= 3)
    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    covered = long.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("whole"))
    alone = scored.join(covered, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (F.col("whole") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= config.per_lang)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
