"""Quality rules, quality classifier, language identification."""

import random
import re

import zstandard

from pagelore.llm import language, quality_model
from pagelore.llm.quality_rules import quality_rules, repeated_words
from tests.llm.helpers import DOCS, awkward, collected, documents, prose


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_rules_match_plain_counts(spark):
    texts = awkward() + [(20, "x y z\nx y z\n\n \nx y z"), (21, "a # b | <c> d\u0085e"), (22, "r s t " * 60), (23, prose(4, 300))]
    got = quality_rules(documents(spark, texts, "kept", "n_words", "ratio"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, *names) == sorted([(i, *plain_rules(t)) for i, t in texts], key=repr)
    assert all(r.kept == (r.verdict == "kept") and not (r.base_failed and r.kept) for r in got.collect())


def test_repeated_words_of_short_lists():
    assert [repeated_words([b"a"] * n) for n in range(6)] == [0, 0, 0, 0, 4, 5]


def test_compression_bands(spark):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40)) for _ in range(120))
    long_cycle = " ".join(f"item{k % 40}" + ("x" * (k // 40 % 7)) for k in range(4000))
    good = prose(5, 900, 5000)
    got = {r.doc_id: r for r in quality_rules(documents(spark, [(1, noise), (2, good), (3, long_cycle)])).collect()}
    assert got[1].verdict == "incompressible" and got[2].verdict == "kept" and got[3].verdict in ("repetitive", "base")
    raw = good.encode()
    assert abs(got[2].ratio - len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))) < 1e-9


def test_rules_of_an_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def labelled(spark, n=400):
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).upper().replace(" ", "!! ")) for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    return documents(spark, rows, "quality", "score2"), labels


def test_quality_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    config = quality_model.QualityConfig()
    weights = quality_model.train(docs, labels, config)
    from pyspark.sql import functions as F

    held = quality_model.score(docs, weights, config).where(quality_model.fold(F.col("doc_id")) == 2).collect()
    assert len(held) > 60
    assert sum((r.score >= 0.7) == (r.doc_id % 2 == 1) for r in held) >= 0.97 * len(held)
    # Held-out labels do not reach the model.
    turned = labels.withColumn("quality", F.when(quality_model.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_model.train(docs, turned, config) == weights).all()


def test_quality_of_awkward_texts(spark):
    docs, labels = labelled(spark, 80)
    weights = quality_model.train(docs, labels)
    rows = quality_model.score(documents(spark, awkward(), "quality"), weights).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").split()} and len({r.score for r in rows if not (r.text or "").strip()}) == 1


def test_quality_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = quality_model.train(empty, none)
    assert not weights.any()
    assert quality_model.score(empty, weights).collect() == []


VOCABULARY = {"en": "the house stands near water while birds sing", "de": "das haus steht nahe wasser während vögel singen", "fr": "la maison près de l'eau où chantent oiseaux"}


def spoken(seed, lang, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(n))


def test_language_words_and_backoff(spark):
    rows = [(i, spoken(i, k), k, "s", 0) for i in range(0, 300, 3) for i, k in ((i, "en"), (i + 1, "de"), (i + 2, "fr"))]
    rows += [(900, "unlabelled", None, "s", 0), (901, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(docs)
    assert model.langs == ["de", "en", "fr"] and "haus" in model.words
    asked = [(1, spoken(7, "fr")), (2, None), (3, "12 34 !!"), (4, "HÄUSER vögelsingen"), (5, "housestands birdsing"), (6, ""), (None, spoken(8, "de")), (1, spoken(7, "fr"))]
    got = language.identify(documents(spark, asked, "lang_pred"), model).collect()
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3, 4, 5, 6, None)] == ["fr", "und", "und", "de", "en", "und", "de"]
    assert len(got) == len(asked) and all(0 <= r.score <= 1 for r in got)


def test_language_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    model = language.train(empty)
    assert language.identify(empty, model).collect() == []
    assert [r.lang_pred for r in language.identify(documents(spark, [(1, "abc")]), model).collect()] == ["und"]


def test_language_cache_overflow(spark):
    rows = [(i, spoken(i, k), k, "s", 0) for i in range(0, 120, 2) for i, k in ((i, "en"), (i + 1, "de"))]
    docs = spark.createDataFrame(rows, DOCS)
    asked = documents(spark, [(i, spoken(i, "de") + f" wort{'abcdefgh'[i % 8]} " + prose(i, 5)) for i in range(12)])
    wide = language.identify(asked, language.train(docs)).collect()
    narrow = language.identify(asked, language.train(docs, language.LanguageConfig(cache_words=3))).collect()
    assert [(r.doc_id, r.lang_pred) for r in wide] == [(r.doc_id, r.lang_pred) for r in narrow]
    assert all(abs(a.score - b.score) < 1e-5 for a, b in zip(wide, narrow))


def test_every_language_keeps_its_own_words(spark):
    rows = [(i, " ".join(f"common{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in range(60)), "en", "s", 0) for i in range(40)]
    rows += [(100 + i, "zwei drei vier", "zz", "s", 0) for i in range(8)]
    model = language.train(spark.createDataFrame(rows, DOCS), language.LanguageConfig(max_words=5))
    assert {"zwei", "drei", "vier"} <= set(model.words) and len(model.words) == 8
    got = language.identify(documents(spark, [(1, "zwei vier"), (2, "dreivier")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "zz", 2: "zz"}


def test_long_runs_of_letters_are_judged_whole(spark):
    rows = [(i, spoken(i, k), k, "s", 0) for i in range(0, 120, 2) for i, k in ((i, "en"), (i + 1, "de"))]
    docs, run = spark.createDataFrame(rows, DOCS), "q" * 70 + "dashausstehtnahewasserwährendvögelsingen"
    asked = documents(spark, [(1, run), (2, f"{run} {run}x")])
    for cache_words in (1, 1000):
        got = language.identify(asked, language.train(docs, language.LanguageConfig(cache_words=cache_words))).collect()
        assert [r.lang_pred for r in got] == ["de", "de"]
