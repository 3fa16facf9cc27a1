"""Pages to passages: blocks packed to a target size, oversized tables and prose divided.

Packing carries state from block to block, so it is a fold over an array inside one row: no shuffle, no
Python process, and a page is never larger than one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import settings
from ledgerlake.functions.text import bind, rx, strip

_SPACES = " \t\n\r\f\x0b"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _when_filled(text: Column) -> Column:
    return F.when(text != "", F.array(text)).otherwise(_empty())


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rx(r"\n\s*\n")), strip), lambda p: p != "")


def blocks(text: Column) -> Column:
    """Paragraphs before the first table marker, then each table section as one block."""
    sections = F.split(text, r"\[TABLE\]", -1)
    tables = F.transform(
        F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0))),
        lambda s: F.concat(F.lit(settings.TABLE_MARKER + "\n"), strip(s)),
    )
    return F.concat(paragraphs(F.get(sections, F.lit(0))), tables)


def split_table(block: Column) -> Column:
    """Rows in runs of about the target size, each behind the marker and the header row."""
    rows = F.filter(F.split(F.regexp_replace(block, r"^[^\n]*\n?", ""), "\n"), lambda r: strip(r) != "")
    head = F.concat(F.lit(settings.TABLE_MARKER + "\n"), F.get(rows, F.lit(0)))
    data = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))

    def part(lines: Column) -> Column:
        return F.array(F.concat(head, F.lit("\n"), F.array_join(lines, "\n")))

    def step(acc: Column, row: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["size"] + F.length(row) > settings.TARGET_CHARS)
        return F.struct(
            F.when(full, F.concat(acc["parts"], part(acc["cur"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(full, F.array(row)).otherwise(F.concat(acc["cur"], F.array(row))).alias("cur"),
            (F.when(full, 0).otherwise(acc["size"]) + F.length(row) + 1).alias("size"),
        )

    start = F.struct(_empty().alias("parts"), _empty().alias("cur"), F.lit(0).alias("size"))
    divided = F.aggregate(
        data, start, step,
        lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["parts"], part(acc["cur"]))).otherwise(acc["parts"]),
    )
    return F.when(F.size(rows) < 3, F.array(block)).otherwise(divided)


def split_prose(block: Column) -> Column:
    """Sentences in runs of about the target size; a sentence beyond the maximum is cut on length."""
    sentences = F.split(block, rx(r"(?<=[.!?])\s+"))

    def step(acc: Column, sentence: Column) -> Column:
        n = F.length(sentence)
        cuts = F.greatest(F.ceil(n / settings.MAX_CHARS).cast("int") - 1, F.lit(0))
        pieces = F.when(
            cuts > 0,
            F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))),
                        lambda i: F.substr(sentence, i * settings.MAX_CHARS + 1, F.lit(settings.MAX_CHARS))),
        ).otherwise(_empty())
        rest = F.when(cuts > 0, F.substr(sentence, cuts * settings.MAX_CHARS + 1, n)).otherwise(sentence)
        joined = F.btrim(F.concat(acc["cur"], F.lit(" "), rest), F.lit(_SPACES))
        full = (acc["cur"] != "") & (F.length(joined) > settings.TARGET_CHARS)
        return F.struct(
            F.when(full, F.concat(acc["parts"], pieces, F.array(acc["cur"])))
            .otherwise(F.concat(acc["parts"], pieces)).alias("parts"),
            F.when(full, rest).otherwise(joined).alias("cur"),
        )

    start = F.struct(_empty().alias("parts"), F.lit("").alias("cur"))
    return F.aggregate(sentences, start, step, lambda acc: F.concat(acc["parts"], _when_filled(acc["cur"])))


def pack(block_list: Column) -> Column:
    """Blocks joined up to the target size; one at the maximum or above stands alone, divided if it must be."""
    sized = F.transform(
        block_list,
        lambda b: F.struct(
            b.alias("text"),
            F.when(F.length(b) < settings.MAX_CHARS, F.lit(None).cast("array<string>"))
            .when(F.length(b) <= settings.WINDOW_CHARS, F.array(b))
            .when(b.startswith(settings.TABLE_MARKER), split_table(b))
            .otherwise(split_prose(b)).alias("pieces"),
        ),
    )

    def step(acc: Column, block: Column) -> Column:
        large = block["pieces"].isNotNull()
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit("\n\n"), block["text"])).otherwise(block["text"])
        full = (acc["cur"] != "") & (F.length(joined) > settings.TARGET_CHARS)
        return F.struct(
            F.when(large, F.concat(acc["packed"], _when_filled(acc["cur"]), block["pieces"]))
            .when(full, F.concat(acc["packed"], F.array(acc["cur"])))
            .otherwise(acc["packed"]).alias("packed"),
            F.when(large, "").when(full, block["text"]).otherwise(joined).alias("cur"),
        )

    start = F.struct(_empty().alias("packed"), F.lit("").alias("cur"))
    return F.aggregate(sized, start, step, lambda acc: F.concat(acc["packed"], _when_filled(acc["cur"])))


def passage_id(filing: Column, page: Column, ordinal: Column, text: Column) -> Column:
    """Deterministic: the same page text always gives the same id."""
    key = F.concat_ws(":", filing, page.cast("string"), ordinal.cast("string"), text)
    return F.concat(filing, F.lit(":p"), page.cast("string"), F.lit(":"), ordinal.cast("string"), F.lit(":"),
                    F.substring(F.sha1(key), 1, 16))


def passages(pages: DataFrame) -> DataFrame:
    """passages(passage_id, filing_id, page, ordinal, text); blank pages give none."""
    rows = pages.where(strip(F.col("page_text")) != "").select(
        "filing_id", "page", F.posexplode(pack(blocks(F.col("page_text")))).alias("ordinal", "text")
    )
    return rows.select(
        passage_id(F.col("filing_id"), F.col("page"), F.col("ordinal"), F.col("text")).alias("passage_id"),
        "filing_id", "page", "ordinal", "text",
    )


def page_words(pages: DataFrame) -> DataFrame:
    """(filing_id, page, words): the passages of a page, lower-cased and joined in order, in the row of the page; null where it gives none."""

    def joined(texts: Column) -> Column:
        return F.when(F.size(texts) > 0, F.concat(F.lit(" "), F.array_join(F.transform(texts, F.lower), " ")))

    return pages.where(strip(F.col("page_text")) != "").select("filing_id", "page", bind(pack(blocks(F.col("page_text"))), joined).alias("words"))


def without_passages(filings: DataFrame, passage_rows: DataFrame) -> DataFrame:
    return filings.join(passage_rows.select("filing_id").distinct(), "filing_id", "left_anti")
