"""Language identification: word-first backoff.

A known word adds its log frequency in every language. An unseen word is judged by its
character n-grams: the longest order of which any is known decides, else the next
shorter one, down to single characters.
"""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import fold, small_batches


@dataclass(frozen=True)
class LanguageConfig:
    #: Documents of each language the tables are counted on at most, those with the smallest hash of their id.
    max_train_docs: int = 1500
    #: Words of each language kept, the most frequent ones.
    max_words: int = 20_000
    min_count: int = 2
    orders: tuple[int, ...] = (4, 3, 2, 1)
    max_grams: int = 10_000
    #: Words kept in a task's cache of unseen words before it starts anew.
    cache_words: int = 200_000


_RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters (Unicode L). Numbers that are no decimal digits, such as fractions, part them."""
    runs = _RUNS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass
class LanguageModel:
    langs: list[str]
    #: Entry -> one number per language.
    words: dict[str, tuple[float, ...]]
    grams: dict[int, dict[str, tuple[float, ...]]]
    config: LanguageConfig

    def unseen(self, word: str) -> list[float]:
        padded = f"^{word}$"
        for order in self.config.orders:
            known = self.grams[order]
            found = [known[g] for g in (padded[i : i + order] for i in range(len(padded) - order + 1)) if g in known]
            if found:
                return [sum(column) / len(found) for column in zip(*found)]
        return [0.0] * len(self.langs)


def _log_table(counts: dict[str, Counter], langs: list[str], keep: dict[str, set]) -> dict[str, tuple[float, ...]]:
    """Per entry, its smoothed log frequency in each language, less their mean."""
    entries = sorted(set().union(*keep.values())) if keep else []
    totals = [sum(counts[k].values()) + len(entries) + 1 for k in langs]
    out = {}
    for e in entries:
        row = [math.log((counts[k][e] + 0.5) / t) for k, t in zip(langs, totals)]
        mean = sum(row) / len(row)
        out[e] = tuple(x - mean for x in row)
    return out


def build(words: dict[str, Counter], config: LanguageConfig) -> LanguageModel:
    langs = sorted(words)
    keep = {
        k: {w for w, n in sorted(words[k].items(), key=lambda x: (-x[1], x[0]))[: config.max_words] if n >= config.min_count}
        for k in langs
    }
    grams = {}
    for order in config.orders:
        counts: dict[str, Counter] = {k: Counter() for k in langs}
        for k in langs:
            for w, n in words[k].items():
                padded = f"^{w}$"
                for i in range(len(padded) - order + 1):
                    counts[k][padded[i : i + order]] += n
        best = {k: {g for g, _ in sorted(counts[k].items(), key=lambda x: (-x[1], x[0]))[: config.max_grams]} for k in langs}
        grams[order] = _log_table(counts, langs, best)
    return LanguageModel(langs, _log_table(words, langs, keep), grams, config)


def train(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Count words by language on a bounded sample outside the held-out quarter.

    Rows without language, text or id teach nothing. Per language the sample is cut by a
    hash of the id; counting runs in Spark, and of each language the most frequent words come
    back, twice ``max_words`` for the n-grams.
    """
    usable = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)
    )
    langs = [r.lang for r in usable.select("lang").distinct().collect()]
    if not langs:
        return build({}, config)
    # A window keeps a bounded number of ids of each language in every task.
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("lang", "doc_id").withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= config.max_train_docs)
    chosen = chosen.select("lang", "doc_id").distinct()
    sample = usable.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "text")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    counted = (
        sample.select("lang", F.explode(tokens).alias("word")).groupBy("lang", "word").count()
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * config.max_words)
    )
    words: dict[str, Counter] = defaultdict(Counter)
    for r in counted.collect():
        words[r.lang][r.word] = r["count"]
    return build({k: words[k] for k in langs}, config)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``lang_pred`` and ``score``, its probability; columns of these names give way.

    ``und`` with score 0 for a text that is null or has no letter, or where no language was
    learned. Ties go to the first language by name. Only the text is looked at.
    """
    config = model.config

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # Known words first, then unseen ones up to the cache's size.
        table = np.zeros((len(model.words) + config.cache_words, len(model.langs)), dtype=np.float32)
        cache: dict[str, int] = {}
        for i, (word, row) in enumerate(model.words.items()):
            cache[word] = i
            table[i] = row

        def number(word: str) -> int:
            at = len(cache)
            if at == len(table):
                return -1
            table[at] = model.unseen(word)
            cache[word] = at
            return at

        for batch in texts:
            names, scores = [], []
            for text in batch:
                found = letter_runs(text.lower()) if text else []
                if not found or not model.langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                ids = [cache[w] if w in cache else number(w) for w in found]
                if min(ids) < 0:
                    # The cache is full: words beyond it are looked up for this text alone, then it starts anew.
                    total = table[[i for i in ids if i >= 0]].sum(axis=0, dtype=np.float64)
                    for word, i in zip(found, ids):
                        if i < 0:
                            total += model.unseen(word)
                    for word in list(cache)[len(model.words):]:
                        del cache[word]
                else:
                    total = table[ids].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                total = np.exp((total - total[best]) / math.sqrt(len(ids)))
                names.append(model.langs[best])
                scores.append(float(total[best] / total.sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    row = F.struct(*[docs[c] for c in kept]).alias("row")
    return small_batches(docs).select(row, predict(F.col(text)).alias("p")).select("row.*", "p.lang_pred", "p.score")
