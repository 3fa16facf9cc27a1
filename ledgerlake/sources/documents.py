"""Free-text documents read as filings: a document is a filing, ten lines are a page.

Lines become paragraphs; a line made of ' | ' cells becomes a table of eight cells a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import settings
from ledgerlake.sources.tables import table

LINES_PER_PAGE = 10
CELLS_PER_ROW = 8
PART_CHARS = 1 << 26
MOST_PARTS = 16


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("filing_id"), "source", "text")


def parts(spark: SparkSession, folder: str, chars: int = PART_CHARS) -> int:
    """Into how many parts jobs cut the documents that take one part after the other.

    A part has about `chars` characters, more where there would be over MOST_PARTS: each part reads the table again.
    """
    whole = documents(spark, folder).agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return min(whole // chars + 1, MOST_PARTS)


def _as_table(line: Column) -> Column:
    def rows(cells: Column) -> Column:
        n_rows = F.ceil(F.size(cells) / CELLS_PER_ROW).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n_rows - 1),
            lambda i: F.array_join(F.slice(cells, i * CELLS_PER_ROW + 1, CELLS_PER_ROW), " | "),
        )

    split_once = F.transform(F.array(F.split(line, r" \| ")), rows)
    return F.concat(F.lit("\n\n" + settings.TABLE_MARKER + "\n"), F.array_join(F.get(split_once, F.lit(0)), "\n"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    n_pages = F.floor((F.size(lines) - 1) / LINES_PER_PAGE)
    chunks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n_pages),
        lambda i: F.slice(lines, i.cast("int") * LINES_PER_PAGE + 1, LINES_PER_PAGE),
    )
    rows = documents(spark, folder).select("filing_id", F.posexplode(chunks).alias("pos", "lines"))
    prose = F.array_join(F.filter("lines", lambda s: ~F.contains(s, F.lit(" | "))), "\n\n")
    tables = F.array_join(F.transform(F.filter("lines", lambda s: F.contains(s, F.lit(" | "))), _as_table), "")
    return rows.select("filing_id", (F.col("pos") + 1).alias("page"), F.concat(prose, tables).alias("page_text"))


def line_passages(spark: SparkSession, folder: str) -> DataFrame:
    """passages with one per line of text."""
    rows = documents(spark, folder).select("filing_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))
    return rows.select(
        F.concat("filing_id", F.lit(":"), F.col("ordinal").cast("string")).alias("passage_id"), "filing_id",
        (F.floor(F.col("ordinal") / LINES_PER_PAGE) + 1).cast("int").alias("page"), "ordinal", "text",
    )


def line_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per document, asked of that document: the first sentences of its first, middle and last line."""
    rows = documents(spark, folder).select("filing_id", F.split("text", "\n", -1).alias("lines"))
    n = F.size("lines")
    picked = F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)
    sentences = F.transform(picked, lambda i: F.substring_index(F.get("lines", i), ".", 1))
    return rows.select(
        F.concat(F.lit("q"), F.col("filing_id")).alias("question_id"), "filing_id", F.array_join(sentences, " ").alias("question")
    )
