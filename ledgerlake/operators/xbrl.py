"""Tagged facts read from inline tags, in one pass over each filing and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.ontology import TAG_TO_CONCEPT
from ledgerlake.functions.text import bind, rx, string_map, strip
from ledgerlake.sources.html import body_of, explicit_pages, until

# Tag patterns.
FACT = r"(?i)<ix:nonfraction[^>]*>[^<]*<"
CONTEXT = rf'(?is)<xbrli:context id="[^"]+"{until("/xbrli:context>")}</xbrli:context>'
CONTEXT_BARE = rf'(?is)<context id="[^"]+"{until("/context>")}</context>'
MEMBER = r'(?i)<xbrldi:explicitMember dimension="[^"]+">[^<]+<'
SEGMENT_AXIS = r"(?i)(?:StatementBusinessSegments|OperatingSegments|ProductOrService|StatementGeographical)Axis"
YEAR = r"\b((?:19|20)\d{2})\b"


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value, empty when absent."""
    return F.regexp_extract(tag, rf'(?i){name}="([^"]*)"', 1)


def fact_value(raw: Column, scale: Column, sign: Column) -> Column:
    """A tag's text as a signed, scaled number; unreadable text is null."""
    digits = F.regexp_replace(raw, r"[^\d.\-]", "").try_cast("double")
    power = F.coalesce(strip(scale).try_cast("int"), F.lit(0))
    scaled = F.when(power == 0, digits).otherwise(digits * F.pow(F.lit(10.0), power))
    return F.when(sign == "-", -scaled).otherwise(scaled)


def _context_struct(block: Column) -> Column:
    # Each pattern runs once over a block; what several fields read is bound.
    members = F.regexp_extract_all(block, F.lit(MEMBER), 0)
    instant = F.trim(F.regexp_extract(block, r"(?i)<(?:xbrli:)?instant>([^<]+)", 1))
    end = F.trim(F.regexp_extract(block, r"(?i)<(?:xbrli:)?enddate>([^<]+)", 1))
    start = F.trim(F.regexp_extract(block, r"(?i)<(?:xbrli:)?startdate>([^<]+)", 1))

    def wanted(found: Column) -> Column:
        return F.filter(found, lambda m: F.regexp_extract(m, r'(?i)dimension="([^"]+)"', 1).rlike(SEGMENT_AXIS))

    read = F.struct(members.alias("members"), instant.alias("instant"))

    def made(r: Column, chosen: Column) -> Column:
        return F.struct(
            F.regexp_extract(block, r'(?i)context id="([^"]+)"', 1).alias("context_id"),
            F.when(r["instant"] != "", r["instant"]).otherwise(end).alias("period_end"),
            F.when(r["instant"] != "", "").otherwise(start).alias("period_start"),
            F.regexp_extract(F.coalesce(chosen, F.lit("")), ">([^<]+)<", 1).alias("member"),
            F.regexp_extract(F.coalesce(chosen, F.lit("")), r'(?i)dimension="([^"]+)"', 1).alias("axis"),
            ((F.size(r["members"]) == 0) | chosen.isNotNull()).alias("usable"),
        )

    return bind(read, lambda r: bind(F.get(wanted(r["members"]), F.lit(0)), lambda chosen: made(r, chosen)))


def contexts_of(body: Column) -> Column:
    """Usable contexts of a filing; unprefixed ones only where no prefixed one is usable."""

    def parse(pattern: str) -> Column:
        blocks = F.regexp_extract_all(body, F.lit(pattern), 0)
        return F.filter(F.transform(blocks, _context_struct), lambda c: c["usable"] & (c["period_end"] != ""))

    return bind(parse(CONTEXT), lambda found: F.when(F.size(found) > 0, found).otherwise(parse(CONTEXT_BARE)))


def context_map(found: Column) -> Column:
    """Contexts by id; where an id is declared twice the later one counts."""

    def by_id(cs: Column) -> Column:
        ids = F.transform(cs, lambda c: c["context_id"])
        last = F.filter(cs, lambda c, i: F.array_position(F.reverse(ids), c["context_id"]) == F.size(ids) - i)
        unique = F.when(F.size(F.array_distinct(ids)) < F.size(ids), last).otherwise(cs)
        return F.map_from_entries(F.transform(unique, lambda c: F.struct(c["context_id"], c)))

    return bind(found, by_id)


def contexts(filings: DataFrame, html_col: str = "html") -> DataFrame:
    return filings.select("filing_id", F.inline(contexts_of(body_of(F.col(html_col))))).drop("usable")


def tagged_facts(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """xbrl_facts: every readable numeric tag with a known context, placed on its page.

    Tags and contexts of a filing sit in the same row, so the lookup is a map access in that row and the
    filing text is read once. Pages count explicit breaks only.
    """
    def read_tag(tag: Column, page: Column, doc_pos: Column) -> Column:
        text = F.regexp_extract(tag, r"(?s)>([^<]*)<", 1)
        return F.struct(attribute(tag, "name").alias("concept"), fact_value(text, attribute(tag, "scale"), attribute(tag, "sign")).alias("value"),
                        page.alias("page"), doc_pos.alias("doc_pos"), F.try_element_at(F.col("contexts"), attribute(tag, "contextref")).alias("context"))

    def on_page(part: Column, i: Column) -> Column:
        return F.transform(F.regexp_extract_all(part, F.lit(FACT), 0), lambda tag, j: read_tag(tag, i + 1, i.cast("bigint") * 1000000 + j))

    # A tag leaves the row read, with its own context only and not with a copy of all of them.
    tags = F.flatten(F.transform(explicit_pages(F.col("body")), on_page))
    known = F.filter(tags, lambda t: t["context"].isNotNull() & (t["concept"] != "") & t["value"].isNotNull())
    return (
        filings.select("filing_id", body_of(F.col(html_col)).alias("body"))
        .select("filing_id", "body", context_map(contexts_of(F.col("body"))).alias("contexts"))
        .select("filing_id", F.inline(known))
        .select("filing_id", "concept", "value", "context.period_end", "context.period_start", "page",
                "context.member", "context.axis", "doc_pos")
    )


def fiscal_year(period_end: Column) -> Column:
    return F.regexp_extract(period_end, rx(YEAR), 1).try_cast("int")


def local_name(concept: Column) -> Column:
    return F.regexp_replace(concept, "^[^:]*:", "")


def to_facts(tagged: DataFrame) -> DataFrame:
    """facts with source 'xbrl': tags that name no known concept are dropped."""
    key = F.try_element_at(string_map(TAG_TO_CONCEPT), local_name(F.col("concept")))
    return (
        tagged.withColumn("concept_key", key)
        .where("concept_key IS NOT NULL")
        .select("filing_id", "concept_key", "value", fiscal_year(F.col("period_end")).alias("fiscal_year"), "page",
                F.lit("xbrl").alias("source"), (F.col("period_start") == "").alias("instant"), "member", "axis", "doc_pos")
    )


def concept_pages(tagged: DataFrame) -> DataFrame:
    """Pages on which each tag occurs, with the place of its first sighting."""
    return tagged.groupBy("filing_id", local_name(F.col("concept")).alias("tag"), "page").agg(F.min("doc_pos").alias("doc_pos"))
