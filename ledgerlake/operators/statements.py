"""Statement pages, and facts read off statements that carry no tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import settings
from ledgerlake.functions.figures import cell_values
from ledgerlake.functions.ontology import CONCEPTS
from ledgerlake.functions.text import any_of, bind, constant, rx, string_map, strip

# The phrases a statement page consists of, for reading facts.
FACT_ITEMS = {
    "cash_flow": ("cash flows from operating activities", "cash flows from investing activities",
                  "cash flows from financing activities", "net cash provided by", "depreciation and amortization",
                  "purchases of property", "dividends paid", "cash and cash equivalents at end"),
    "balance_sheet": ("total current assets", "total current liabilities", "total assets", "accounts payable",
                      "retained earnings", "total liabilities", "cash and cash equivalents", "goodwill"),
    "income": ("cost of", "operating income", "net income", "per share", "income tax", "gross", "total revenues"),
}
UNIT = r"(?i)\(?\s*(?:amounts?\s+)?in\s+(thousands|millions|billions)"
UNIT_SCALE = {"thousands": 1e3, "millions": 1e6, "billions": 1e9}
YEAR = r"\b((?:19|20)\d{2})\b"
YEAR_ROW = r"^\s*(?:19|20)\d{2}(?:[\s,]+(?:and\s+)?(?:19|20)\d{2})+\s*$"


def completeness(text: Column, items: tuple[str, ...]) -> Column:
    hits = [F.when(F.contains(text, F.lit(item)), 1).otherwise(0) for item in items]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total / len(items)


def candidates(pages: DataFrame, items: dict[str, tuple[str, ...]]) -> DataFrame:
    """(filing_id, page, page_text, statement, score) of pages complete enough to be that statement."""
    scored = F.array(
        *[F.struct(F.lit(s).alias("statement"), completeness(F.col("low"), i).alias("score")) for s, i in items.items()]
    )
    return (
        pages.withColumn("low", F.lower("page_text"))
        .select("filing_id", "page", "page_text", F.inline(scored))
        .where(F.col("score") >= settings.STATEMENT_THRESHOLD)
    )


def cluster(found: DataFrame) -> DataFrame:
    """The candidates chosen so that one page per statement lie closest together; first combination on ties.

    For every candidate as the lowest page, the best partners are the next candidate at or after it of each
    other statement. One ordered pass over a filing's candidates finds them, where trying all combinations
    would grow with their product. Candidate pages are the only text that is shuffled.
    """
    names = sorted(FACT_ITEMS)
    at_or_after = Window.partitionBy("filing_id").orderBy(F.desc("page")).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("filing_id")
    following = [F.min(F.when(F.col("statement") == n, F.col("page"))).over(at_or_after).alias(n) for n in names]
    cols = found.select("*", *following)
    present = [F.max(F.when(F.col("statement") == n, 1).otherwise(0)).over(whole) for n in names]
    kinds = sum(present[1:], present[0])
    filled = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    spread = F.greatest(*[F.coalesce(F.col(n), F.col("page")) for n in names]) - F.col("page")
    order = F.struct(spread.alias("spread"), *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    ranked = cols.withColumn("kinds", kinds).withColumn("order", F.when(filled == F.col("kinds"), order))
    best = ranked.withColumn("best", F.min("order").over(whole))
    chosen = F.coalesce(*[F.when(F.col("statement") == n, F.col("best")[n]) for n in names])
    return best.where(F.col("page") == chosen).select(found.columns)


def statement_pages(pages: DataFrame) -> DataFrame:
    return cluster(candidates(pages, FACT_ITEMS)).select("filing_id", "statement", "page")


def unit_scale(text: Column) -> Column:
    unit = F.lower(F.regexp_extract(text, UNIT, 1))
    return F.coalesce(F.try_element_at(constant(UNIT_SCALE, "map<string,double>"), unit), F.lit(1.0))


def _row_concept(statement: Column, label: Column) -> Column:
    """The first concept, in table order, of that statement with a pattern found in the label."""
    chain = None
    for key, (kind, _, patterns) in CONCEPTS.items():
        hit = (statement == kind) & any_of([label.rlike(rx(p)) for p in patterns])
        chain = F.when(hit, key) if chain is None else chain.when(hit, key)
    return chain


def _years(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rx(YEAR)), 1))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y > 1990) & (y < 2100))


def marked_lines(statement: Column, text: Column) -> Column:
    """array<struct<line, concept>>: the lines without outer blanks, each with the concept that its first cell names, or null."""

    def mark(line: Column) -> Column:
        concept = bind(F.lower(F.substring_index(line, "|", 1)), lambda label: _row_concept(statement, label))
        return F.struct(line.alias("line"), F.when(line != "", concept).alias("concept"))

    return F.transform(F.split(text, "\n"), lambda s: bind(strip(s), mark))


def column_years(marked: Column) -> Column:
    """The years of a statement's head: of the nearest table row with a year before the first row that names a concept.

    A row has cells, or is a line of two years or more and nothing else; a page whose concepts stand in no cells is read
    line by line. If no row of the head has a year, the years are all those of the lines before. Nothing depends on how far down the page the table stands.
    """
    def head(all_: Column) -> Column:
        kind = lambda m: F.when(m["concept"].isNull(), 0).when(F.contains(m["line"], F.lit("|")), 2).otherwise(1)
        first = bind(F.transform(all_, kind), lambda k: F.coalesce(F.nullif(F.array_position(k, 2), F.lit(0)), F.array_position(k, 1)))
        return bind(first.cast("int"), lambda n: F.when(n > 0, F.slice(all_, 1, n - 1)).otherwise(all_)["line"])

    def of_head(before: Column) -> Column:
        rows = F.filter(before, lambda s: F.contains(s, F.lit("|")) | s.rlike(rx(YEAR_ROW)))
        rows = F.filter(F.transform(rows, _years), lambda y: F.size(y) > 0)
        return F.coalesce(F.try_element_at(rows, F.lit(-1)), _years(F.array_join(before, "\n")))

    return bind(head(marked), of_head)


def statement_facts(pages: DataFrame) -> DataFrame:
    """facts with source 'statement': the i-th figure of a row belongs to the i-th year of the page.

    A candidate page is read where it lies, each line once; what is shuffled to choose among a filing's candidates are their
    years and the rows that name a concept.
    """
    found = candidates(pages, FACT_ITEMS).withColumn("marked", marked_lines(F.col("statement"), F.col("page_text")))
    numbered = F.transform("marked", lambda m, i: F.struct(i.alias("line_no"), m["line"].alias("line"), m["concept"].alias("concept_key")))
    read = found.select(
        "filing_id", "page", "statement", "score", column_years(F.col("marked")).alias("years"),
        unit_scale(F.col("page_text")).alias("scale"), F.filter(numbered, lambda m: m["concept_key"].isNotNull()).alias("rows"),
    )
    named = cluster(read).select("filing_id", "page", "statement", "years", "scale", F.inline("rows"))
    kept = F.slice(F.col("figures"), 1, F.greatest(F.size("years"), F.lit(1)))
    instant = string_map({k: str(v[0] == "balance_sheet").lower() for k, v in CONCEPTS.items()})
    return (
        named.withColumn("figures", cell_values(F.col("line")))
        .select("*", F.posexplode(kept).alias("i", "figure"))
        .select("filing_id", "concept_key", (F.col("figure") * F.col("scale")).alias("value"),
                F.get("years", F.col("i")).alias("fiscal_year"), "page", F.lit("statement").alias("source"),
                instant[F.col("concept_key")].cast("boolean").alias("instant"), F.lit("").alias("member"),
                F.lit("").alias("axis"),
                (F.col("page").cast("bigint") * 1000000 + F.col("line_no") * 1000 + F.col("i")).alias("doc_pos"))
    )
