"""Answers as HTML: escaping, bold, tables, bullets, numbers, line breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions.arrays import let
from pagelore.functions.text import strip

# The markup the page style expects.
_TABLE_OPEN = '<div class="response-table-wrapper"><table class="response-table"><thead><tr>'
_TABLE_BODY = "</tr></thead><tbody>"
_TABLE_CLOSE = "</tbody></table></div>"
_BULLET = '<div class="response-bullet">• $1</div>'
_NUMBER = '<div class="response-number">$1. $2</div>'
_SEPARATOR_LINE = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$"


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _is_table_line(line: Column) -> Column:
    return let(strip(line), lambda t: t.startswith("|") & t.endswith("|"))


def _cells(line: Column) -> Column:
    pieces = F.split(line, r"\|", -1)
    inner = let(pieces, lambda p: F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))))
    return F.transform(inner, strip)


def _tagged(cells: Column, tag: str) -> Column:
    return F.array_join(
        F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""
    )


def _body_row(line: Column, width: Column) -> Column:
    """One table row with as many cells as the header has."""

    def padded(cells: Column) -> Column:
        whole = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
        return F.slice(whole, 1, width)

    return F.concat(F.lit("<tr>"), _tagged(let(_cells(line), padded), "td"), F.lit("</tr>"))


def with_tables(lines: Column) -> Column:
    """Replace every pipe table (header, separator, rows) by one line of markup."""
    placed = F.transform(lines, lambda v, i: F.struct(v.alias("line"), F.get(lines, i + 1).alias("below")))
    start = F.struct(
        F.array().cast("array<string>").alias("out"),
        F.lit(0).alias("mode"),  # 0 text, 1 separator comes next, 2 rows
        F.lit(0).alias("width"),
        F.lit("").alias("table"),
    )

    def closed(s: Column) -> Column:
        return F.when(
            s["mode"] > 0, F.array_append(s["out"], F.concat(s["table"], F.lit(_TABLE_CLOSE)))
        ).otherwise(s["out"])

    def state(out: Column, mode: int, width: Column, table: Column) -> Column:
        return F.struct(
            out.alias("out"), F.lit(mode).alias("mode"), width.alias("width"), table.alias("table")
        )

    def step(s: Column, p: Column) -> Column:
        opens = _is_table_line(p["line"]) & F.coalesce(p["below"].rlike(_SEPARATOR_LINE), F.lit(False))
        header = let(
            _cells(p["line"]),
            lambda c: F.struct(
                F.size(c).alias("width"),
                F.concat(F.lit(_TABLE_OPEN), _tagged(c, "th"), F.lit(_TABLE_BODY)).alias("table"),
            ),
        )
        return (
            F.when(s["mode"] == 1, state(s["out"], 2, s["width"], s["table"]))
            .when(
                (s["mode"] == 2) & _is_table_line(p["line"]),
                state(s["out"], 2, s["width"], F.concat(s["table"], _body_row(p["line"], s["width"]))),
            )
            .when(opens, let(header, lambda h: state(closed(s), 1, h["width"], h["table"])))
            .otherwise(state(F.array_append(closed(s), p["line"]), 0, F.lit(0), F.lit("")))
        )

    return F.aggregate(placed, start, step, closed)


def render_answer(text: Column) -> Column:
    """Answer markup as HTML; line breaks are only added outside table markup."""
    safe = escape_html(F.coalesce(text, F.lit("")))
    safe = F.regexp_replace(safe, r"(?i)&lt;br\s*/?&gt;", "\n")
    bold = F.regexp_replace(safe, r"\*\*(.+?)\*\*", "<strong>$1</strong>")

    def tables(t: Column) -> Column:
        folded = F.array_join(let(F.split(t, "\n"), with_tables), "\n")
        return F.when(F.contains(t, F.lit("|")), folded).otherwise(t)

    listed = F.regexp_replace(let(bold, tables), r"(?m)^[ \t]*[-*]\s+(.+)$", _BULLET)
    listed = F.regexp_replace(listed, r"(?m)^[ \t]*(\d+)\.\s+(.+)$", _NUMBER)
    return F.replace(listed, F.lit("\n"), F.lit("<br>"))
