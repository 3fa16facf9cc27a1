"""Sales tables read as company filings.

Each customer is a filer with one filing; each order year is a fiscal year. Amounts are summed in whole
cents, held as DOUBLE, so a sum is exact and does not depend on the order of rows or of partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.ontology import CONCEPTS
from ledgerlake.sources.tables import table

INCOME_PAGE, BALANCE_PAGE, CASH_PAGE, SUPPLEMENT_PAGE, SEGMENT_PAGE = 5, 6, 7, 8, 9
PAGE_OF = {"income": INCOME_PAGE, "balance_sheet": BALANCE_PAGE, "cash_flow": CASH_PAGE}

# Cents per concept, as SQL over the yearly sums. A concept whose sum is zero is not reported.
CONCEPT_CENTS = {
    "revenue": "rev",
    "cogs": "cogs",
    "gross_profit": "rev - cogs",
    "operating_income": "rev - cogs - sga - rnd",
    "pretax_income": "rev - cogs - sga - rnd - interest",
    "tax_expense": "tax",
    "net_income": "rev - cogs - sga - rnd - interest - tax",
    "interest_expense": "interest",
    "rnd": "rnd",
    "sga": "sga",
    "restructuring": "restructuring",
    "assets": "cash + receivables + inventory + ppe",
    "assets_current": "cash + receivables + inventory",
    "liabilities": "payables + tax + ltd",
    "liabilities_current": "payables + tax",
    "cash": "cash",
    "short_term_investments": "sti",
    "inventory": "inventory",
    "receivables": "receivables",
    "payables": "payables",
    "ppe_net": "ppe",
    "equity": "cash + receivables + inventory + ppe - payables - tax - ltd",
    "debt_long_term": "ltd",
    "debt_short_term": "std",
    "retained_earnings": "rev - cogs - sga - rnd - interest - tax - dividends",
    "capex": "-capex",
    "ocf": "rev - cogs - sga - rnd - interest - tax + dep",
    "depreciation_amortization": "dep",
    "dividends_paid": "-dividends",
    "icf": "-capex",
    "financing_cf": "-dividends - std",
}


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line in whole cents, with filer, fiscal year, part and supplier."""
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax_pct"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("filing_id"), F.year("o_orderdate").alias("fiscal_year")
    )
    part = table(spark, folder, "part").select(
        "p_partkey", F.initcap("p_type").alias("goods"), "p_size", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("retail")
    )
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .withColumn("rev", F.expr("(price * (100 - disc) + 50) div 100"))
        .withColumn("cost", F.expr("qty * retail"))
    )


def _sum_when(value: str, when: str | None = None) -> Column:
    v = F.expr(f"CAST({value} AS DOUBLE)")
    return F.sum(v if when is None else F.when(F.expr(when), v))


def yearly_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(filing_id, fiscal_year) with the summed cents every concept is built from."""
    by_line = lines(spark, folder).groupBy("filing_id", "fiscal_year").agg(
        _sum_when("rev").alias("rev"),
        _sum_when("cost").alias("cogs"),
        _sum_when("(rev * tax_pct) div 100").alias("tax"),
        _sum_when("(price * disc) div 100").alias("sga"),
        _sum_when("price div 20", "l_returnflag = 'R'").alias("rnd"),
        _sum_when("price div 50", "l_returnflag = 'A'").alias("interest"),
        _sum_when("price div 100", "l_returnflag = 'R' AND l_linestatus = 'F'").alias("restructuring"),
        _sum_when("cost", "l_linestatus = 'O'").alias("inventory"),
        _sum_when("cost", "p_size >= 26").alias("ppe"),
        _sum_when("cost div 2", "l_linestatus = 'F'").alias("ltd"),
        _sum_when("cost div 10", "l_linestatus = 'F' AND l_returnflag = 'A'").alias("std"),
        _sum_when("price div 10", "l_linestatus = 'O' AND l_returnflag = 'N'").alias("sti"),
        _sum_when("price div 10", "p_size >= 45").alias("capex"),
        _sum_when("cost div 10", "p_size >= 26").alias("dep"),
        _sum_when("rev div 40", "l_returnflag = 'N'").alias("dividends"),
    )
    cents = "CAST(round(o_totalprice * 100) AS DOUBLE)"
    by_order = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("filing_id"), F.year("o_orderdate").alias("fiscal_year"))
        .agg(
            F.sum(F.expr(f"CASE WHEN o_orderstatus = 'O' THEN {cents} END")).alias("receivables"),
            F.sum(F.expr(f"CASE WHEN o_orderstatus = 'F' THEN {cents} END")).alias("cash"),
            F.sum(F.expr(f"CASE WHEN o_orderstatus = 'P' THEN {cents} END")).alias("payables"),
        )
    )
    return by_line.join(by_order, ["filing_id", "fiscal_year"]).na.fill(0.0)


def _fact_columns(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.col("filing_id").cast("string").alias("filing_id"), "concept_key", "value", "fiscal_year", "page",
        "source", "instant", "member", "axis", "doc_pos",
    )


def consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged whole-company facts, one row per concept and year that is reported."""
    items = []
    for pos, (concept, cents) in enumerate(CONCEPT_CENTS.items()):
        statement = CONCEPTS[concept][0]
        items.append(
            F.struct(
                F.lit(concept).alias("concept_key"),
                (F.expr(cents) / 100).alias("value"),
                F.lit(PAGE_OF[statement]).alias("page"),
                F.lit(statement == "balance_sheet").alias("instant"),
                F.lit(pos).cast("bigint").alias("doc_pos"),
            )
        )
    exploded = yearly_sums(spark, folder).select("filing_id", "fiscal_year", F.inline(F.array(*items)))
    kept = exploded.where("value <> 0")
    return _fact_columns(
        kept.withColumn("source", F.lit("xbrl")).withColumn("member", F.lit("")).withColumn("axis", F.lit(""))
    )


def _facts_of_years() -> Column:
    """The reported facts of the column `years`, an array of yearly sums: array<struct> of the columns of consolidated() but for the filing."""
    printed = []
    for pos, (concept, cents) in enumerate(CONCEPT_CENTS.items()):
        statement = CONCEPTS[concept][0]
        own_cents = re.sub("[a-z]+", r"y.\g<0>", cents)
        printed.append(
            f"named_struct('concept_key', '{concept}', 'value', ({own_cents}) / 100, 'fiscal_year', y.fiscal_year, 'page', {PAGE_OF[statement]}, 'source', 'xbrl', "
            f"'instant', {str(statement == 'balance_sheet').lower()}, 'member', '', 'axis', '', 'doc_pos', {pos}L)")
    return F.filter(F.flatten(F.expr(f"transform(years, y -> array({', '.join(printed)}))")), lambda f: f["value"] != 0)


def filed(spark: SparkSession, folder: str) -> DataFrame:
    """consolidated() with a row per filing: (filing_id, facts), an array<struct> of the other columns.

    The yearly sums are gathered and made facts in the row: a filing has a row per year before, and 31 facts per year after.
    """
    sums = yearly_sums(spark, folder)
    gathered = sums.groupBy(F.col("filing_id").cast("string").alias("filing_id")).agg(
        F.collect_list(F.struct("fiscal_year", *[c for c in sums.columns if c not in ("filing_id", "fiscal_year")])).alias("years"))
    return gathered.select("filing_id", _facts_of_years().alias("facts"))


def member_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(filing_id, fiscal_year, axis, member, rev, cost): cents per product line and per supplier region."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.translate(F.initcap("r_name"), " ", "").alias("place"))
    base = lines(spark, folder)
    joined = (
        base.join(supplier, base.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    cells = joined.groupBy("filing_id", "fiscal_year", "goods", "place").agg(
        _sum_when("rev").alias("rev"), _sum_when("cost").alias("cost")
    )
    sides = F.array(
        F.struct(
            F.concat(F.lit("co:"), F.col("goods"), F.lit("GoodsSegmentMember")).alias("member"),
            F.lit("us-gaap:StatementBusinessSegmentsAxis").alias("axis"),
        ),
        F.struct(
            F.concat(F.lit("co:"), F.col("place"), F.lit("Member")).alias("member"),
            F.lit("us-gaap:StatementGeographicalAxis").alias("axis"),
        ),
    )
    return (
        cells.select("filing_id", "fiscal_year", "rev", "cost", F.inline(sides))
        .groupBy("filing_id", "fiscal_year", "axis", "member")
        .agg(F.sum("rev").alias("rev"), F.sum("cost").alias("cost"))
    )


def by_member(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged revenue and cost per product line and per supplier region."""
    values = F.array(
        F.struct(F.lit("revenue").alias("concept_key"), (F.col("rev") / 100).alias("value")),
        F.struct(F.lit("cogs").alias("concept_key"), (F.col("cost") / 100).alias("value")),
    )
    exploded = member_sums(spark, folder).select("filing_id", "fiscal_year", "axis", "member", F.inline(values))
    return _fact_columns(
        exploded.withColumn("page", F.lit(SEGMENT_PAGE))
        .withColumn("instant", F.lit(False))
        .withColumn("source", F.lit("xbrl"))
        .withColumn("doc_pos", F.pmod(F.xxhash64("member", "concept_key"), F.lit(1 << 30)) + (1 << 30))
    )


def figures_filed(spark: SparkSession, folder: str, tasks: int) -> DataFrame:
    """Figures of facts() with a row per filing: (filing_id, facts), array<struct<fiscal_year, member, concept_key, value, axis>> in no order.

    Dealt to `tasks` tasks as sums, a row per filing-year and one per member, and made figures in the row.
    """
    sums, members = yearly_sums(spark, folder), member_sums(spark, folder)
    key = F.col("filing_id").cast("string").alias("filing_id")
    rows = sums.select(key, F.struct(*[c for c in sums.columns if c != "filing_id"]).alias("year")).unionByName(
        members.select(key, F.struct(*[c for c in members.columns if c != "filing_id"]).alias("of_member")), allowMissingColumns=True)
    gathered = rows.repartition(tasks, "filing_id").groupBy("filing_id").agg(F.collect_list(F.struct("year", "of_member")).alias("sums"))

    def of(kind: str) -> Column:
        return F.filter(F.transform("sums", lambda s: s[kind]), lambda s: s.isNotNull())

    def figure(f: Column, concept: Column, value: Column) -> Column:
        return F.struct(f["fiscal_year"].alias("fiscal_year"), f["member"].alias("member"), concept.alias("concept_key"), value.alias("value"), f["axis"].alias("axis"))

    whole = F.transform(_facts_of_years(), lambda f: figure(f, f["concept_key"], f["value"]))
    members_of = lambda concept, cents: F.transform(of("of_member"), lambda m: figure(m, F.lit(concept), m[cents] / 100))
    return gathered.select("*", of("year").alias("years")).select("filing_id", F.concat(whole, members_of("revenue", "rev"), members_of("cogs", "cost")).alias("facts"))


def facts(spark: SparkSession, folder: str, members: bool = False) -> DataFrame:
    whole = consolidated(spark, folder)
    return whole.unionByName(by_member(spark, folder)) if members else whole
