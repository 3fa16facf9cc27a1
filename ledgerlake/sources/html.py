"""Filing markup to pages: scan, decode, split, text, tables, display markup. Expressions, but for the sanitiser."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import settings
from ledgerlake.functions.text import bind, rx, string_map, strip

# Markup patterns. Text up to a closing tag is taken by possessive runs, which step from "<" to "<" and never go back.
_BREAK = r"page-break-(?:after|before)\s*:\s*always"
PAGE_BREAK = rf"(?i)<(?:[^>p]++|p(?!{_BREAK[1:]}))*+{_BREAK}[^>]*>"
RULE = r"(?i)<hr[^>]*>"
ENVELOPE_HEAD = r"(?is)<DOCUMENT>.*?<TEXT>"
ENVELOPE_FOOT = r"(?is)</TEXT>\s*</DOCUMENT>"
BLOCK_TAGS = "p|div|br|tr|li|h1|h2|h3|h4|h5|h6|section|article|header|footer|blockquote"
HIDDEN_TAGS = "script|style|ix:header|ix:hidden|ix:references|ix:resources|(?:xbrli|xbrldi|link|xlink):[a-z0-9]+"
UNSAFE_TAGS = "script|iframe|object|embed|applet|form|link|meta|base"
URL_ATTRIBUTES = "href|src|action|background|poster"
UNSAFE_SCHEMES = "javascript:|data:|vbscript:"

# Windows-1252 differs from Latin-1 in 0x80-0x9f; five of those bytes are undefined in it.
_C1 = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder: wrong suffix, empty and oversized ones are set apart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return admit(files)


def admit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    judged = files.withColumn("original_name", name).withColumn(
        "error",
        F.when(~suffix.isin(*settings.ALLOWED_SUFFIXES), "unsupported file type")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > settings.MAX_UPLOAD_BYTES, "file too large"),
    )
    return judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL").drop("content")


def decode_text(content: Column) -> Column:
    """UTF-8, else Windows-1252, else Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    cp1252 = F.translate(latin, _C1.decode("latin-1"), _C1.decode("cp1252"))
    return (
        F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
        .when(latin.rlike(_UNDEFINED), latin)
        .otherwise(cp1252)
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def new_uploads(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads whose content is not yet in the same workspace; an absent owner is a workspace of its own."""
    first = F.min_by(F.struct(*[c for c in batch.columns if c not in ("content_hash", "user_id")]), "filing_id")
    unique = batch.groupBy("content_hash", "user_id").agg(first.alias("row")).select("content_hash", "user_id", "row.*")
    known = stored.where("deleted_at IS NULL").select(F.col("content_hash").alias("h"), F.col("user_id").alias("u")).distinct()
    same = (F.col("content_hash") == F.col("h")) & F.col("user_id").eqNullSafe(F.col("u"))
    return unique.join(known, same, "left_anti")


def body_of(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, ENVELOPE_HEAD, ""), ENVELOPE_FOOT, "")


def explicit_pages(body: Column) -> Column:
    return F.split(body, PAGE_BREAK, -1)


def split_pages(body: Column) -> Column:
    """Fragments at page-break styles, or at rules where there is no break; blank pages stay."""
    return bind(
        explicit_pages(body), lambda parts: F.when(F.size(parts) == 1, F.split(F.get(parts, F.lit(0)), RULE, -1)).otherwise(parts)
    )


def fragments(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """(filing_id, page, fragment), a narrow explode."""
    return filings.select("filing_id", F.posexplode(split_pages(body_of(F.col(html_col)))).alias("pos", "fragment")).select(
        "filing_id", (F.col("pos") + 1).alias("page"), "fragment"
    )


def _fold(text: Column, found: Column, step) -> Column:
    return F.aggregate(F.array_distinct(found), text, step)


def unescape(text: Column) -> Column:
    """Character references to characters, each once; '&' itself comes last."""
    names = {name: chr(code) for name, code in html.entities.name2codepoint.items() if name != "amp"}
    table = string_map(names)

    def decimal(acc: Column, ref: Column) -> Column:
        code = F.regexp_extract(ref, r"(\d+)", 1).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        ok = (code > 0) & (code <= 0x10FFFF) & (code != 38)
        return F.when(ok, F.replace(acc, ref, char)).otherwise(acc)

    def hexadecimal(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"(?i)&#x([0-9a-f]+);", 1)
        ok = (F.length(digits) <= 6) & (F.lower(digits) != "26")
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        return F.when(ok, F.replace(acc, ref, char)).otherwise(acc)

    def named(acc: Column, ref: Column) -> Column:
        char = F.try_element_at(table, F.substring_index(F.substring(ref, 2, 40), ";", 1))
        return F.when(char.isNotNull(), F.replace(acc, ref, char)).otherwise(acc)

    def replaced(t: Column) -> Column:
        out = _fold(t, F.regexp_extract_all(t, F.lit("(&#[0-9]{1,7};)"), 1), decimal)
        out = _fold(out, F.regexp_extract_all(t, F.lit("(&#[xX][0-9a-fA-F]{1,6};)"), 1), hexadecimal)
        out = _fold(out, F.regexp_extract_all(t, F.lit("(&[a-zA-Z][a-zA-Z0-9]*;)"), 1), named)
        return F.when(t.contains("&"), F.regexp_replace(out, "&(?:amp|#38|#[xX]26);", "&")).otherwise(t)

    return bind(text, replaced)


def until(*stops: str) -> str:
    """The text before the first of the tags; a stop is written without its "<"."""
    return rf"(?:[^<]++|<(?!{'|'.join(stops)}))*+"


def _visible(fragment: Column) -> Column:
    out = F.regexp_replace(fragment, r"(?s)<!--.*?-->", "")
    hidden = until(r"/\1\s*>")
    out = F.regexp_replace(out, rf"(?is)<(?=[silx])({HIDDEN_TAGS})\b[^>]*>{hidden}</\1\s*>", "")
    return F.regexp_replace(out, r"(?is)<!doctype[^>]*>", "")


def _cell_text(cell: Column) -> Column:
    nodes = F.transform(F.split(cell, "<[^>]*>"), lambda t: strip(unescape(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), " ")


def tables_text(fragment: Column) -> Column:
    """Each table as rows of cells joined by ' | ', without rows that hold no text."""
    tables = F.regexp_extract_all(fragment, F.lit(rf"(?is)<table\b[^>]*>({until(r'/table\s*>')})</table\s*>"), 1)
    row, cell = until(r"tr\b", r"/tr\s*>"), until(r"t[dh]\b", r"/t[dh]\s*>")

    def one(table: Column) -> Column:
        rows = F.regexp_extract_all(table, F.lit(rf"(?is)<tr\b[^>]*>({row})"), 1)
        lines = F.transform(rows, lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(rf"(?is)<t[dh]\b[^>]*>({cell})"), 1), _cell_text))
        return F.array_join(
            F.transform(F.filter(lines, lambda cells: F.exists(cells, lambda c: c != "")), lambda cells: F.array_join(cells, " | ")),
            "\n",
        )

    return F.filter(F.transform(tables, one), lambda t: t != "")


def page_text(fragment: Column) -> Column:
    """Readable text of one fragment; tables follow the prose, each behind a marker."""
    return bind(_visible(fragment), _text_of_visible)


def _text_of_visible(seen: Column) -> Column:
    lines = F.regexp_replace(seen, rf"(?i)<(?:(?:br\s*/?|/(?:{BLOCK_TAGS})\s*)>|br\s[^>]*>)", "\n")
    prose = unescape(F.regexp_replace(lines, "<[^>]*>", ""))
    prose = F.regexp_replace(prose, "[ \t\u00a0]+", " ")
    prose = strip(F.regexp_replace(prose, rx(r"\n\s*\n\s*\n+"), "\n\n"))
    blocks = F.transform(tables_text(seen), lambda t: F.concat(F.lit(settings.TABLE_MARKER + "\n"), t))
    return F.array_join(F.concat(F.array(prose), blocks), "\n\n")


def pages(filings: DataFrame, html_col: str = "html") -> DataFrame:
    return fragments(filings, html_col).select("filing_id", "page", page_text(F.col("fragment")).alias("page_text"))


def grid_text(grid: Column) -> Column:
    """An already extracted grid of cells as table text; fewer than two rows or two filled columns give null."""
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))))
    kept = F.filter(clean, lambda row: F.exists(row, lambda c: c != ""))
    width = F.array_max(F.transform(kept, F.size))
    filled = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))),
                      lambda i: F.exists(kept, lambda row: F.coalesce(F.get(row, i), F.lit("")) != ""))
    text = F.array_join(F.transform(kept, lambda row: F.array_join(row, " | ")), "\n")
    return F.when((F.size(kept) >= 2) & (F.size(filled) >= 2), text)


def readable_pages(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """pages() of the filings that have any text; a filing of blank pages gives none. Judged in the row, so no shuffle."""

    def if_any(texts: Column) -> Column:
        return F.when(F.exists(texts, lambda t: strip(t) != ""), texts)

    texts = bind(F.transform(split_pages(body_of(F.col(html_col))), page_text), if_any)
    return filings.select("filing_id", F.posexplode(texts).alias("pos", "page_text")).select("filing_id", (F.col("pos") + 1).alias("page"), "page_text")


# Possessive patterns: no step is ever taken back, so the time is linear and nothing recurses, whatever the markup.
_TOKEN = re.compile(r"""<!--(?s:.*?)-->|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?P<name>[^\s/>=]++)(?:\s*+=\s*+(?P<value>"[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_RAW = {name: re.compile(rf"</{name}[^>]*+>", re.I) for name in ("script", "iframe")}
_UNSAFE, _URLS = frozenset(UNSAFE_TAGS.split("|")), frozenset([*URL_ATTRIBUTES.split("|"), "formaction", "xlink:href"])
_SCHEMES, _EMPTY = tuple(UNSAFE_SCHEMES.split("|")), frozenset(("embed", "link", "meta", "base"))


def _safe_attribute(m: re.Match) -> str:
    name, value = m["name"].lower(), m["value"] or ""
    if name.startswith("on") or name == "srcdoc":
        return ""
    if name in _URLS:
        plain = re.sub(r"[\x00-\x20]+", "", html.unescape(value.strip("\"'"))).lower()
        return "" if plain.startswith(_SCHEMES) else m[0]
    return m[0]


def clean(markup: str | None) -> str | None:
    """Markup safe to display. An unsafe element goes with its content, or alone where it is never closed."""
    if markup is None:
        return None
    out: list[str] = []
    opened: list[tuple[str, int]] = []
    at, end_of_tags = 0, markup.rfind(">") + 1
    while m := _TOKEN.search(markup, at, end_of_tags):
        out.append(markup[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            out.append(m[0])
        elif name not in _UNSAFE:
            out.append(m[0] if m["close"] else f"<{m['name']}{_ATTRIBUTE.sub(_safe_attribute, m['rest'])}>")
        elif m["close"]:
            found = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name), None)
            if found is not None:
                del out[opened[found][1] :], opened[found:]
        elif name in _RAW:
            end = _RAW[name].search(markup, at)
            at = end.end() if end else len(markup) if name == "script" else at
        elif name not in _EMPTY:
            opened.append((name, len(out)))
    out.append(markup[at:])
    return "".join(out)


def sanitised(fragment: Column) -> Column:
    """Markup safe to display: no active tags, event handlers or script URLs. One pass per page on Arrow batches."""

    def cleaned(pages: pd.Series) -> pd.Series:
        return pages.map(clean)

    cleaned.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(cleaned, T.StringType())(fragment)


def display_pages(filings: DataFrame, html_col: str = "html") -> DataFrame:
    return fragments(filings, html_col).select("filing_id", "page", sanitised(F.col("fragment")).alias("page_html"))


def one_page(display: DataFrame, filing_id: str, page: int) -> DataFrame:
    return display.where((F.col("filing_id") == filing_id) & (F.col("page") == page))


def excerpt(page_rows: DataFrame, n_pages: int, max_chars: int) -> DataFrame:
    """The opening of each filing: its first pages joined by blank lines, cut to a length."""
    head = page_rows.where(F.col("page") <= n_pages)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_text"))), lambda r: r["page_text"]), "\n\n")
    return head.groupBy("filing_id").agg(F.substring(text, 1, max_chars).alias("excerpt"))
