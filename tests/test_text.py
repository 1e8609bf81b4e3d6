"""Text functions against tables of inputs and outputs, and properties that hold for any input."""

import random

import pytest

from pagelore.functions import text

PIECES = ["a", "B", "9", "é", "ß", ".", ",", ";", "!", "'", "-", "_", " ", "  ", "\t", "\n", "\n\n\n",
          "\r", "\r\n", "\xa0", "\u2003", "\x1c", "\x0b", "\x85", "word", "x.y", "日本", "İ"]


@pytest.fixture(scope="module")
def samples():
    rnd = random.Random(5)
    fixed = ["", " ", "\n", "a.b.c", "a.  b", "\xa0x\xa0", "one\r\ntwo\rthree", "let's talk-shop", "--a--'b'"]
    return fixed + ["".join(rnd.choices(PIECES, k=rnd.randint(0, 25))) for _ in range(400)]


@pytest.mark.parametrize("fn, cases", [
    (text.clean_text, {
        "": "", " ": "", " a ": "a", "a  b\t\tc": "a b c", "\xa0x\xa0y": "x y", "a\r\nb\rc": "a\nb\nc",
        "a\n\n\n\n\nb": "a\n\nb", "a\n\nb": "a\n\nb", "a \n b": "a \n b", "\n\na\n": "a", "x\u2003y": "x\u2003y",
    }),
    (text.space_sentences, {
        "": "", "One.Two": "One. Two", "a!b?c": "a! b? c", "3.14": "3.14", "x.y.z": "x. y. z", "a,b;c:d": "a, b; c: d",
        "a. b": "a. b", "a..b": "a.. b", "a.9": "a.9", "a,\u00e9": "a,\u00e9", "see:\nA": "see:\nA",
    }),
    (text.canonical_lines, {
        "": "", " a \n\n\t\n b  c ": "a\nb c", "a\r\nb\rc": "a\nb\nc", "\n": "", "a\n\n\nb": "a\nb",
    }),
    (text.lexical_form, {
        "": "", "Let's TALK-shop!": "let s talk shop", "\u00c9t\u00e9 9": "t 9", "  a\n b ": "a b", "_x_": "x", "...": "",
    }),
    (text.split_words, {"": [], "a  b\nc": ["a", "b", "c"], "\xa0a\xa0b": ["a", "b"]}),
    (text.count_words, {"": 0, " ": 0, "a  b\nc": 3, "a-b c": 2}),
    (text.lexical_tokens, {"": [], "b a b": ["b", "a"], "A a, a!": ["a"]}),
    (text.count_word_tokens, {"": 0, "let's talk-shop": 2, "--a--": 1, "a.b": 2, "... !": 0, "\u65e5\u672c x_1": 2}),
])
def test_cases(evaluate, fn, cases):
    assert evaluate(fn, list(cases)) == list(cases.values())


def test_properties(evaluate, samples):
    cleaned = evaluate(text.clean_text, samples)
    assert not any("  " in c or "\t" in c or "\r" in c or "\xa0" in c or "\n\n\n" in c or c != c.strip() for c in cleaned)
    # Only white space is ever removed or added.
    for fn in (text.clean_text, text.space_sentences, text.canonical_lines):
        assert ["".join(r.split()) for r in evaluate(fn, samples)] == ["".join(x.split()) for x in samples]
    words = evaluate(text.lexical_tokens, samples)
    assert all(len(set(w)) == len(w) for w in words)
    assert [set(w) for w in words] == [set(f.split()) for f in evaluate(text.lexical_form, samples)]
    assert [len(w) for w in evaluate(text.split_words, samples)] == evaluate(text.count_words, cleaned)
    assert not any(line != line.strip() or not line for c in evaluate(text.canonical_lines, samples) for line in c.split("\n") if c)


def test_normal_forms_are_stable(evaluate, samples):
    for fn in (text.clean_text, text.space_sentences, text.canonical_lines, text.lexical_form):
        once = evaluate(fn, samples)
        assert evaluate(fn, once) == once


def test_noise_rules(evaluate):
    assert evaluate(text.is_noise_heading, ["", "Next  Step", "Lets talk", "Let's talk", "contact us now"]) == [
        True, True, True, True, False]
    assert evaluate(text.is_noise_passage, ["", "Tell us what you're dealing with today", "We tell"]) == [
        False, True, False]
    assert evaluate(text.is_ui_text, ["", " MENU ", "menus", "Privacy  policy"]) == [True, True, False, True]


def test_drop_repeated_lines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["a", " a", "", "b", "a", "a.b", "a. b"],)], "v array<string>")
    assert df.select(text.drop_repeated_lines(F.col("v")).alias("r")).first().r == ["a", "b", "a", "a. b"]


def test_section_text_appends_content_unless_it_is_a_part(spark):
    from pyspark.sql import functions as F

    schema = "s struct<heading:string,paragraphs:array<string>,bullets:array<string>,content:string>"
    rows = [(("H", ["p1", " "], ["b1"], "H\np1\nb1"),), (("", ["only"], [], "only"),), ((None, None, None, None),)]
    df = spark.createDataFrame(rows, schema)
    got = [r.t for r in df.select(text.section_text(F.col("s")).alias("t")).collect()]
    assert got == ["H\np1\nb1\nH\np1\nb1", "only", ""]
    once = [r.t for r in df.select(text.section_text(F.col("s"), True).alias("t")).collect()]
    assert once == ["H\np1\nb1", "only", ""]


def test_iso_timestamp(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select timestamp'2024-05-06 07:08:09.5' as t")
    assert df.select(text.iso_timestamp(F.col("t")).alias("r")).first().r == "2024-05-06T07:08:09Z"
