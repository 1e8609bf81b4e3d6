"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.config import NOISE_HEADINGS, NOISE_TEXT_PREFIXES, UI_TEXTS
from pagelore.functions.arrays import any_of, drop_adjacent_repeats, let, non_empty

# Every character Unicode, or Python's str.strip, takes for white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"[ \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\p{Z}]+"
_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def _unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _holds(text: Column, *pieces: str) -> Column:
    found = F.contains(text, F.lit(pieces[0]))
    for piece in pieces[1:]:
        found = found | F.contains(text, F.lit(piece))
    return found


def clean_text(text: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line in a row, stripped.

    Most texts need little of it: a plain substring search decides whether the
    regular expressions have to run at all.
    """

    def blanks(t: Column) -> Column:
        fixed = F.regexp_replace(t, r"[ \t\xa0]{2,}|[\t\xa0]", " ")
        return F.when(_holds(t, "  ", "\t", "\xa0"), fixed).otherwise(t)

    def gaps(t: Column) -> Column:
        fixed = F.regexp_replace(t, r"\n{3,}", "\n\n")
        return strip(F.when(_holds(t, "\n\n\n"), fixed).otherwise(t))

    return let(let(_unix_lines(F.coalesce(text, F.lit(""))), blanks), gaps)


def space_sentences(text: Column) -> Column:
    """``clean_text``, then a blank between punctuation and a following letter.

    Cleaning again afterwards would change nothing: a blank is only ever put
    between two characters that are not white space.
    """
    return F.regexp_replace(clean_text(text), r"([.!?,;:])(?=[A-Za-z])", "$1 ")


def canonical_lines(text: Column) -> Column:
    """Hashing form: single blanks, stripped lines, no empty lines."""

    def blanks(t: Column) -> Column:
        fixed = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
        return F.when(_holds(t, "  ", "\t"), fixed).otherwise(t)

    lines = F.split(let(_unix_lines(F.coalesce(text, F.lit(""))), blanks), "\n")
    return F.array_join(non_empty(F.transform(lines, strip)), "\n")


def lexical_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits in order, repeats kept."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, r"[^a-z0-9]+"), "")


def lexical_form(text: Column) -> Column:
    """The lexical words joined by single blanks."""
    return F.array_join(lexical_words(text), " ")


def lexical_tokens(text: Column) -> Column:
    return F.array_distinct(lexical_words(text))


def split_words(text: Column) -> Column:
    """White-space words; cleaning a text never changes them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE_RUN), "")


def count_words(text: Column) -> Column:
    return F.size(split_words(text))


def count_word_tokens(text: Column) -> Column:
    """Number of word tokens (letters, digits, ``_``, inner ``'`` and ``-``)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD))


def is_noise_heading(text: Column) -> Column:
    value = F.lower(space_sentences(text))
    return (value == "") | value.rlike(any_of(NOISE_HEADINGS))


def is_noise_passage(text: Column) -> Column:
    return F.lower(space_sentences(text)).rlike(any_of(NOISE_TEXT_PREFIXES))


def is_ui_text(text: Column) -> Column:
    value = F.lower(clean_text(text))
    return (value == "") | value.isin(*UI_TEXTS)


def drop_repeated_lines(lines: Column) -> Column:
    """Normalise each line, drop empty ones, keep one of each run of equals."""
    return drop_adjacent_repeats(non_empty(F.transform(lines, space_sentences)))


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def section_parts(section: Column) -> Column:
    """Heading, paragraphs and bullets of a section as one array."""
    return F.concat(
        F.array(F.coalesce(section["heading"], F.lit(""))),
        _strings(section["paragraphs"]),
        _strings(section["bullets"]),
    )


def section_text(section: Column, dedupe_content: bool = False) -> Column:
    """The text to be chunked of one section struct.

    The stored section content usually repeats heading, paragraphs and bullets;
    it is appended all the same unless it equals one of them.
    """

    def with_content(ps: Column) -> Column:
        own = F.array_join(ps, "\n")
        if dedupe_content:
            return F.when(F.size(ps) > 0, own).otherwise(clean_text(section["content"]))
        return let(
            clean_text(section["content"]),
            lambda c: F.when((c == "") | F.array_contains(ps, c), own).otherwise(
                F.array_join(F.concat(ps, F.array(c)), "\n")
            ),
        )

    return let(non_empty(F.transform(section_parts(section), clean_text)), with_content)


def section_words(section: Column, dedupe_content: bool = False) -> Column:
    """Words of ``section_text``, split part by part without building that text.

    Content can only equal a part that has the same words, so the texts themselves
    are compared in that case alone.
    """

    def build(parts: Column) -> Column:
        own = F.transform(parts, split_words)

        def append(pw: Column) -> Column:
            if dedupe_content:
                return let(
                    F.flatten(pw),
                    lambda ws: F.when(F.size(ws) > 0, ws).otherwise(split_words(section["content"])),
                )

            def unless_equal(cw: Column) -> Column:
                repeated = F.exists(pw, lambda w: w == cw) & F.array_contains(
                    F.transform(parts, clean_text), clean_text(section["content"])
                )
                return F.when(repeated, F.flatten(pw)).otherwise(F.concat(F.flatten(pw), cw))

            same = F.array_contains(parts, F.coalesce(section["content"], F.lit("")))
            return F.when(same, F.flatten(pw)).otherwise(
                let(split_words(section["content"]), unless_equal)
            )

        return let(own, append)

    return let(section_parts(section), build)


def iso_timestamp(ts: Column) -> Column:
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
