"""Text expressions shared by all operators. Every one is a Column expression evaluated in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern whose \\s, \\w, \\d and \\b are Unicode-aware."""
    return f"(?U{flags}){pattern}"


# What \\s means in rx().
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(col: Column) -> Column:
    return F.regexp_replace(col, rx(r"\s+"), " ")


def match_form(col: Column) -> Column:
    """Lower-case, ampersands written out, single spaces."""
    return squash(F.regexp_replace(F.lower(col), rx(r"\s*&\s*"), " and "))


def raw_form(col: Column) -> Column:
    return squash(F.lower(col))


def tokens(col: Column) -> Column:
    """Runs of a-z and 0-9; accents split words."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), 0)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def matched_keys(pairs: list[tuple[str, Column]]) -> Column:
    """Keys whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(key)) for key, cond in pairs]))


def first_of(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def constant(value: object, schema: str) -> Column:
    """A constant list or map as one node of the plan, folded once; nested literals would bloat every plan using it."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def string_map(mapping: dict[str, str]) -> Column:
    return constant(mapping, "map<string,string>")
