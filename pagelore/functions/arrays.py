"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda variable holds an already computed value, whereas naming a column
    twice lets the optimizer inline, and so repeat, the expression behind it.
    """
    return F.transform(F.array(value), body)[0]


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def drop_adjacent_repeats(values: Column) -> Column:
    """Keep a value only where it differs from the one before it."""
    return let(
        values,
        lambda vs: F.filter(vs, lambda v, i: (i == 0) | (v != F.get(vs, i - 1))),
    )


def any_of(patterns: tuple[str, ...]) -> str:
    """One regular expression that matches whenever one of ``patterns`` does."""
    return "|".join(f"(?:{p})" for p in patterns)


def in_list(value: Column, options: tuple[str, ...]) -> Column:
    return value.isin(*options) if options else F.lit(False)
