"""Licence scans: a trained paragraph classifier.

Paragraphs (lines, wrapped ones joined) are word n-grams of length one and two. A softmax
regression with a sparse weight table gives the probability of each licence family, of licence
wording of no known family, and of no licence. A prediction below a calibrated probability, or
with less than a calibrated share of word pairs that are the family's own, counts as unknown; both limits come from families that a model was fitted without. A family is
confirmed if that share is large enough. The corpus is scored by column expressions and one join with the weight
table, whose size is that of the templates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.decontaminate import words
from pagelore.llm.licence_texts import OTHER, TEMPLATES, UNKNOWN
from pagelore.session import materialize

NONE = "none"


@dataclass(frozen=True)
class LicenceConfig:
    #: Corpus paragraphs that the model sees as "no licence" at most; those with the smallest hash.
    max_corpus_paragraphs: int = 1500
    variants: int = 24
    rounds: int = 300
    rate: float = 4.0
    l1: float = 2e-4
    #: Steps of the fits that leave a family out.
    calibration_rounds: int = 100
    #: Least template share of a confirmed paragraph.
    confirm_share: float = 0.5


#: A line break inside a sentence, with the comment marks of the next line: the line before has over 50
#: characters and ends in no mark, and the next begins with a small letter; or the line before ends in a
#: comma, and the next does not begin like a sentence, with a capital and a small letter.
WRAP = (
    r"\n(?:(?<=[^\n]{50}[^.!?:;\s][ \t\r]{0,8}\n)[ \t#*/;%>]{0,40}(?=\p{Ll})"
    r"|(?<=[^\n]{50},[ \t\r]{0,8}\n)[ \t#*/;%>]{0,40}(?=[^\s#*/;%>])(?!\p{Lu}\p{Ll}))"
)


def paragraphs(text: Column) -> Column:
    """The lines of a text; a line that goes on with the sentence of the one before belongs to it."""
    return F.split(F.regexp_replace(text, WRAP, " "), "\n")


def _grams(tokens: list[str]) -> list[tuple]:
    return [(w,) for w in tokens] + list(zip(tokens, tokens[1:]))


@dataclass
class LicenceModel:
    classes: list[str]
    bias: np.ndarray
    #: (word, next word or None) -> weights by class, and whether it stands in a family's templates
    table: dict[tuple, tuple[np.ndarray, np.ndarray]]
    temperature: float
    limit: float
    #: Template share below which the family is not named.
    least_share: float


def _variants(tokens: list[str], noise: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The tokens with words dropped, numbers changed, and words of the corpus before and after."""
    out = [tokens]
    for _ in range(n):
        kept = [str(rng.integers(1, 30)) if w.isdigit() else w for w in tokens if len(tokens) < 4 or rng.random() > 0.06]
        extra = [noise[i] for i in rng.integers(len(noise), size=int(rng.integers(0, 1 + len(tokens) // 3)))] if noise else []
        out.append(kept + extra if rng.random() < 0.5 else extra + kept)
    return out


def train(docs: DataFrame, config: LicenceConfig = LicenceConfig()) -> LicenceModel:
    """Fit on the templates, their variants, and a bounded sample of corpus paragraphs as "no licence"."""
    spark = docs.sparkSession
    rng = np.random.default_rng(11)
    told = [(k, t) for k, texts in TEMPLATES.items() for t in texts] + [("unknown", t) for t in UNKNOWN] + [(NONE, t) for t in OTHER]
    split = spark.createDataFrame(told, "kind string, text string").select("kind", words(F.col("text")).alias("w")).collect()
    # Ids choose the sample before texts are split.
    picked = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_corpus_paragraphs // 3)
    sample = (
        docs.join(F.broadcast(picked), "doc_id").select(F.explode(paragraphs(F.col("text"))).alias("line"))
        .select(words(F.col("line")).alias("w")).where((F.size("w") > 1) & (F.size("w") <= 400))
        .orderBy(F.xxhash64("w"), "w").limit(config.max_corpus_paragraphs).collect()
    )
    families = sorted(TEMPLATES)
    classes = [*families, "unknown", NONE]
    pairs: dict[tuple, np.ndarray] = {}
    for r in split:
        if r.kind in families:
            for g in zip(r.w, r.w[1:]):
                pairs.setdefault(g, np.zeros(len(families)))[families.index(r.kind)] = 1
    corpus = [r.w for r in sample if sum(g in pairs for g in zip(r.w, r.w[1:])) * 3 < len(r.w)]
    noise = [w for line in corpus[:200] for w in line[:20]]
    rows = [(classes.index(r.kind), v) for r in split for v in _variants(list(r.w), noise, rng, config.variants)]
    rows += [(len(classes) - 1, list(w)) for w in corpus]
    vocabulary: dict[tuple, int] = {}
    for r in split:
        for g in _grams(list(r.w)):
            vocabulary.setdefault(g, len(vocabulary))
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, (_, tokens) in enumerate(rows):
        grams = _grams(tokens)
        for g in grams:
            if g in vocabulary:
                x[i, vocabulary[g]] += 1 / np.sqrt(len(grams))
    y = np.array([k for k, _ in rows])
    held = rng.random(len(rows)) < 0.2
    weights, bias = _fit(x[~held], y[~held], len(classes), config.rounds, config)
    logits = x[held] @ weights + bias
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(held.sum()), y[held]])).mean())
    none = len(classes) - 1
    shares = np.zeros((len(rows), len(families)))
    for i, (k, tokens) in enumerate(rows):
        if k != none:
            told = [pairs[g] for g in zip(tokens, tokens[1:]) if g in pairs]
            own = sum((t / t.sum() for t in told), np.zeros(len(families)))
            shares[i] = own / np.maximum(1e-9, len(tokens) - 1 - sum(told, np.zeros(len(families))) + own)
    known = held & (y < len(families))
    sure = _softmax((x[known] @ weights + bias) / temperature)[np.arange(known.sum()), y[known]], shares[known, y[known]]
    # What the likeliest other family gets for wording of a family that the fit has not seen.
    strange: list[tuple[np.ndarray, np.ndarray]] = []
    for f in range(len(families)):
        out = y == f
        w, b = _fit(x[~held & ~out], y[~held & ~out], len(classes), config.calibration_rounds, config)
        power = _softmax((x[out] @ w + b) / temperature)
        power[:, f] = 0
        best = power[:, : len(families)].argmax(axis=1)
        strange.append((power[np.arange(len(best)), best], shares[out, best]))
    false = tuple(np.concatenate(v) for v in zip(*strange))
    limit, least_share = _limits(sure, false)
    table = {}
    for g, i in vocabulary.items():
        if np.any(weights[i]) or g in pairs:
            table[g] = weights[i], pairs.get(g, np.zeros(len(families)))
    return LicenceModel(classes, bias, table, temperature, limit, least_share)


def _limits(sure: tuple[np.ndarray, np.ndarray], false: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """The probability and the template share that tell wording of seen families best from that of unseen ones.

    Best is the greatest difference of the two parts that reach both limits; ties go to the smaller limits.
    """
    def part(values: tuple[np.ndarray, np.ndarray], at: tuple[float, float]) -> float:
        return float(((values[0] >= at[0]) & (values[1] >= at[1])).mean()) if len(values[0]) else 0.0

    grid = [(p / 20, t / 40) for p in range(6, 20) for t in range(4, 25)]
    return max(grid, key=lambda at: (round(part(sure, at) - part(false, at), 6), -at[0] - at[1]))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int, config: LicenceConfig) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by proximal gradient steps; small weights become 0. Classes weigh the same."""
    target = np.eye(k, dtype=np.float32)[y]
    share = (1 / np.maximum(1, target.sum(axis=0)))[y][:, None] / k
    w, b = np.zeros((x.shape[1], k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - target) * share
        w -= config.rate * 10 * (x.T @ g)
        w = np.sign(w) * np.maximum(0, np.abs(w) - config.rate * 10 * config.l1 / 10)
        b -= config.rate * g.sum(axis=0)
    return w, b


def _weight_table(spark: SparkSession, model: LicenceModel) -> DataFrame:
    n_classes, n_families = len(model.classes), len(model.classes) - 2
    rows = [
        (g[0], g[1] if len(g) > 1 else None, *map(float, w), *map(float, t), *map(float, t / max(1, t.sum())))
        for g, (w, t) in sorted(model.table.items(), key=lambda e: (e[0][0], e[0][1:]))
    ]
    names = [*(f"w{i}" for i in range(n_classes)), *(f"t{i}" for i in range(n_families)), *(f"u{i}" for i in range(n_families))]
    schema = "a string, b string, " + ", ".join(f"{n} double" for n in names)
    return materialize(
        spark.createDataFrame(rows, schema).select(
            F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", F.lit(1), "b")).alias("gram"), *names
        ),
        "licence-weights",
    )


def scan(docs: DataFrame, model: LicenceModel, config: LicenceConfig = LicenceConfig()) -> DataFrame:
    """Paragraphs that read like a licence: doc_id, paragraph, n_words, family, probability, template_share, confirmed.

    One row per paragraph whose likeliest class is not "none" and, for a family, that has a
    word pair of the family's templates. ``family`` is ``unknown`` if the likeliest family's
    probability or ``template_share`` is below its calibrated limit; ``confirmed`` tells whether
    the share is enough (never for unknown). ``template_share`` sets the paragraph's word pairs
    that the family's templates have, each divided by the number of families that have it,
    against these and the pairs that they lack: common licence wording counts little either way. Ties go to the first family by name. ``paragraph`` numbers
    the paragraphs of a text from 0, blank ones included. A text of any length is scanned whole;
    an empty table gives no rows. Null and empty texts have no paragraphs; rows with a null
    doc_id are scanned like others; repeated rows of a doc_id count once, by their text.
    Other columns are not read.
    """
    spark, k = docs.sparkSession, len(model.classes)
    families = model.classes[: k - 2]
    weights = _weight_table(spark, model)
    lines = docs.select("doc_id", "text").where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("copy"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "line")
    )
    w = F.col("w")
    tokens = lines.select("doc_id", "copy", "paragraph", words(F.col("line")).alias("w")).where(F.size("w") > 0)
    grams = F.concat(
        F.transform(w, lambda x: F.xxhash64(x)),
        F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.lit(1), x)),
    )
    exploded = tokens.select("doc_id", "copy", "paragraph", F.size("w").alias("n_words"), F.explode(grams).alias("gram"))
    # The weight table has as many rows as the templates have n-grams.
    sums = (
        exploded.join(F.broadcast(weights), "gram").groupBy("doc_id", "copy", "paragraph", "n_words")
        .agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(k)], *[F.sum(f"{t}{i}").alias(f"{t}{i}") for t in "tu" for i in range(len(families))])
    )
    scale = F.sqrt(2 * F.col("n_words") - 1)
    logits = F.array(*[(F.col(f"w{i}") / scale + F.lit(float(model.bias[i]))) / F.lit(model.temperature) for i in range(k)])

    def pick(values: Column) -> Column:
        return F.array_position(values, F.array_max(values)).cast("int")

    judged = (
        sums.withColumn("logits", logits)
        .withColumn("power", F.transform("logits", lambda z: F.exp(z - F.array_max(F.col("logits")))))
        .withColumn("class", pick(F.col("logits")))
        .where(F.col("class") < k)
        .withColumn("total", F.aggregate("power", F.lit(0.0), lambda a, x: a + x))
        .withColumn("best", pick(F.slice("logits", 1, len(families))))
        .withColumn("probability", F.element_at("power", F.col("best")) / F.col("total"))
    )
    names = F.array(*[F.lit(c) for c in families])
    told, own = (F.element_at(F.array(*[F.col(f"{t}{i}") for i in range(len(families))]), F.col("best")) for t in "tu")
    share = F.when(own > 0, own / (F.col("n_words") - 1 - told + own)).otherwise(0.0)
    sure = (F.col("probability") >= model.limit) & (F.col("class") == F.col("best")) & (share >= model.least_share)
    # A family without any word pair of its templates is no more than a stray word.
    licence = (F.col("class") == len(families) + 1) | (share > 0)
    return judged.where(licence).select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("n_words").cast("long").alias("n_words"),
        F.when(sure, F.element_at(names, F.col("best"))).otherwise("unknown").alias("family"), F.round("probability", 6).alias("probability"),
        F.round(share, 6).alias("template_share"), (sure & (share >= config.confirm_share)).alias("confirmed"),
    ).distinct()
