"""Figures as text: extraction, parsing, printed forms and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import bind, rx, strip

# Patterns for figures.
NUMBER = r"\$?-?\d+(?:,\d{3})*(?:\.\d+)?%?"
SIGNED_NUMBER = r"\(?\$?-?\d+(?:,\d{3})*(?:\.\d+)?%?\)?"
CELL_NUMBER = r"\(?\$?\s*-?\d[\d,]*(?:\.\d+)?\)?"
EVAL_NUMBER = r"\$?-?\d[\d,]*(?:\.\d+)?%?"
BARE_YEAR = r"^(?:19|20)\d{2}$"
SCALES = (1_000_000.0, 1_000.0, 1.0)


def numbers(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(rx(NUMBER)), 0)


def signed_numbers(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(rx(SIGNED_NUMBER)), 0)


def is_year(token: Column) -> Column:
    return token.rlike(rx(BARE_YEAR))


def to_double(token: Column) -> Column:
    """One figure token as a number; enclosing parentheses mean negative, unreadable is null."""
    negative = token.startswith("(") & token.endswith(")")
    bare = F.regexp_replace(token, r"[$£€,()]", "")
    value = F.regexp_replace(bare, "%+$", "").try_cast("double")
    return F.when(negative, -value).otherwise(value)


def cell_values(line: Column) -> Column:
    """The figures of a statement row, left to right."""
    found = F.regexp_extract_all(line, F.lit(rx(CELL_NUMBER)), 0)

    def parse(token: Column) -> Column:
        value = F.regexp_replace(token, rx(r"[$,()\s]"), "").try_cast("double")
        return F.when(token.contains("("), -value).otherwise(value)

    return F.filter(F.transform(found, parse), lambda v: v.isNotNull())


def plain(value: Column, decimals: int) -> Column:
    """Fixed decimals without thousands separators, ties to even on the binary value."""
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def grouped(value: Column, decimals: int) -> Column:
    return F.format_number(value, decimals)


def printed_forms(value: Column) -> Column:
    """How a filing may print a figure: in millions, thousands or units, with 0 to 2 decimals, longest first."""
    size = F.abs(value)
    forms = []
    for scale in SCALES:
        scaled = size / F.lit(scale)
        for decimals in (0, 1, 2):
            forms.append(F.when(scaled >= 1, grouped(scaled, decimals)))
    distinct = F.array_distinct(F.array_compact(F.array(*forms)))
    by_length = F.transform(
        distinct, lambda t, i: F.struct((-F.length(t)).alias("len"), i.alias("pos"), t.alias("text"))
    )
    return F.transform(F.array_sort(by_length), lambda s: s["text"])


def figure_lines(page_text: Column) -> Column:
    """The lines of a page that can show a figure: not blank, with a digit. Made once per page."""
    return F.transform(F.filter(F.split(page_text, "\n"), lambda s: s.rlike("[0-9]")), strip)


def quote_line(lines: Column, value: Column) -> Column:
    """Of a page's figure lines, the one that shows a value: a labelled row if there is one, else a bare cell, else null."""

    def pick(forms: Column) -> Column:
        return F.filter(lines, lambda s: F.exists(forms, lambda f: F.contains(s, f)))

    def best(found: Column) -> Column:
        labelled = F.filter(found, lambda s: F.length(F.regexp_replace(s, r"\P{L}", "")) >= 4)
        return F.coalesce(F.get(labelled, F.lit(0)), F.get(found, F.lit(0)))

    return bind(bind(printed_forms(value), pick), best)


def display(value: Column, unit: Column) -> Column:
    """A value as an answer shows it: percent, currency in millions, or a ratio."""
    millions = F.when(F.abs(value) >= 1_000_000, value / 1_000_000).otherwise(value)
    return (
        F.when(unit == "percent", F.concat(plain(value * 100, 1), F.lit("%")))
        .when(unit == "currency", F.concat(F.lit("$"), grouped(millions, 2), F.lit(" million")))
        .otherwise(plain(value, 2))
    )
