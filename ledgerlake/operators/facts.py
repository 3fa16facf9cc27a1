"""Fact lookups: which of a filing's figures answers (concept, year)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerlake.functions.text import bind, rx

# Fixed value: the axis of a geographical breakdown.
GEOGRAPHY_AXIS = rx(r"(?:StatementGeographical|Geographic)", "i")


def source_rank(fact: Column | None = None) -> Column:
    """Of the row, or of a fact in an array."""
    return F.when((F.col("source") if fact is None else fact["source"]) == "xbrl", 0).otherwise(1)


def lookup_rank(fact: Column | None = None) -> Column:
    """Tagged before statement, then document order, in one long so aggregates stay on fixed-width buffers."""
    return source_rank(fact).cast("bigint") * F.lit(1 << 50) + (F.col("doc_pos") if fact is None else fact["doc_pos"])


def _latest_order(fact: Column | None = None) -> Column:
    """Newest year, then a statement row before a tag, then document order: the largest one counts."""
    year, pos = (F.col("fiscal_year"), F.col("doc_pos")) if fact is None else (fact["fiscal_year"], fact["doc_pos"])
    return F.coalesce(year, F.lit(0)).cast("bigint") * F.lit(1 << 42) + source_rank(fact).cast("bigint") * F.lit(1 << 41) - pos


def combine(tagged: DataFrame, statement: DataFrame) -> DataFrame:
    """Tagged facts, and statement facts for concepts without a consolidated tagged fact."""
    covered = tagged.where(F.col("member") == "").select("filing_id", "concept_key").distinct()
    return tagged.unionByName(statement.join(covered, ["filing_id", "concept_key"], "left_anti"))


def consolidated(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("member") == "")


def best_by_year(facts: DataFrame) -> DataFrame:
    """The figure used for each (filing, concept, year): an aggregate, so a hot filing is reduced map-side."""
    rank = lookup_rank()
    return (
        consolidated(facts)
        .where(F.col("fiscal_year").isNotNull())
        .groupBy("filing_id", "concept_key", "fiscal_year")
        .agg(
            F.min_by("value", rank).alias("value"),
            F.min_by("page", rank).alias("page"),
            F.min(rank).alias("rank"),
        )
    )


def latest(facts: DataFrame) -> DataFrame:
    """The figure when no year is asked: newest year, and on ties a statement row before a tag."""
    order = _latest_order()
    return (
        consolidated(facts)
        .groupBy("filing_id", "concept_key")
        .agg(
            F.max_by("value", order).alias("value"),
            F.max_by("fiscal_year", order).alias("fiscal_year"),
            F.max_by("page", order).alias("page"),
        )
    )


def locations(facts: DataFrame) -> DataFrame:
    """Every page that reports (concept, year), one row per page, tagged first."""
    rank = lookup_rank()
    return (
        consolidated(facts)
        .groupBy("filing_id", "concept_key", "fiscal_year", "page")
        .agg(F.min_by("value", rank).alias("value"), F.min(rank).alias("rank"))
    )


def prior_year(best: DataFrame) -> DataFrame:
    """Each figure beside the same concept one fiscal year earlier; a gap gives null."""
    before = Window.partitionBy("filing_id", "concept_key").orderBy("fiscal_year").rangeBetween(-1, -1)
    return best.withColumn("prior_value", F.max("value").over(before))


def _first_of_each(ordered: Column, *keys: str) -> Column:
    """The first of the facts with the same keys, of an array in the order of its fields."""
    differs = lambda f, g: reduce(Column.__or__, [~f[k].eqNullSafe(g[k]) for k in keys])
    return bind(ordered, lambda fs: F.filter(fs, lambda f, i: (i == 0) | differs(f, F.get(fs, i - 1))))


def _best_in_row(facts: Column) -> Column:
    own = F.filter(facts, lambda f: (f["member"] == "") & f["fiscal_year"].isNotNull())
    ranked = F.transform(own, lambda f: F.struct(
        f["concept_key"].alias("concept_key"), f["fiscal_year"].alias("fiscal_year"), lookup_rank(f).alias("rank"), f["value"].alias("value"), f["page"].alias("page")))
    return _first_of_each(F.sort_array(ranked), "concept_key", "fiscal_year")


def best_of_gathered(filed: DataFrame) -> DataFrame:
    """best_by_year of facts that lie with their filing: (filing_id, facts), one row per filing, which bounds the array.

    Chosen in the row: facts are neither shuffled nor kept in a hash table, which would hold all of a partition's, and the rows
    stay where their filing is, so that no later step by filing shuffles them either.
    """
    return filed.select("filing_id", F.inline(_best_in_row(F.col("facts"))))


def prior_of_gathered(filed: DataFrame) -> DataFrame:
    """prior_year of best_of_gathered(), found in the row: in order, the year before stands just before."""

    def beside(best: Column) -> Column:
        def prior(f: Column, i: Column) -> Column:
            g = F.get(best, i - 1)
            return F.when((g["concept_key"] == f["concept_key"]) & (g["fiscal_year"] == f["fiscal_year"] - 1), g["value"])

        return F.transform(best, lambda f, i: F.struct(*[f[c].alias(c) for c in ("concept_key", "fiscal_year", "rank", "value", "page")], prior(f, i).alias("prior_value")))

    return filed.select("filing_id", F.inline(bind(_best_in_row(F.col("facts")), beside)))


def latest_of_gathered(filed: DataFrame) -> DataFrame:
    """latest() of facts that lie with their filing, chosen in the row."""
    own = F.filter("facts", lambda f: f["member"] == "")
    ranked = F.transform(own, lambda f: F.struct(
        f["concept_key"].alias("concept_key"), (-_latest_order(f)).alias("order"), f["value"].alias("value"), f["fiscal_year"].alias("fiscal_year"), f["page"].alias("page")))
    return filed.select("filing_id", F.inline(_first_of_each(F.sort_array(ranked), "concept_key"))).drop("order")


def filing_summary(facts: DataFrame) -> DataFrame:
    """Fact count, concepts and years of each filing, newest year first."""
    return facts.groupBy("filing_id").agg(
        F.count("*").alias("n_facts"),
        F.sort_array(F.collect_set("fiscal_year"), asc=False).alias("years"),
        F.sort_array(F.collect_set(F.when(F.col("member") == "", F.col("concept_key")))).alias("concepts"),
    )


def segment_values(facts: DataFrame, geography: bool) -> DataFrame:
    """One figure per member and year from the asked kind of axis: the first sighting in document order."""
    return (
        facts.where((F.col("member") != "") & (F.col("axis").rlike(GEOGRAPHY_AXIS) == F.lit(geography)))
        .groupBy("filing_id", "concept_key", "fiscal_year", "member")
        .agg(F.min_by("value", F.col("doc_pos")).alias("value"), F.min_by("page", F.col("doc_pos")).alias("page"),
             F.min("doc_pos").alias("doc_pos"))
    )


def readable(member: Column) -> Column:
    """A member name as a person writes it."""
    local = F.when(F.instr(member, ":") > 0, F.regexp_replace(member, "^[^:]*:", "")).otherwise(member)
    bare = F.regexp_replace(local, "(?i)(?:Segment)?Member$", "")
    spaced = F.regexp_replace(bare, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def rank_members(values: DataFrame, lowest: bool = False) -> DataFrame:
    """Members of each (filing, concept, year) ranked by value, where at least two report it."""
    group = Window.partitionBy("filing_id", "concept_key", "fiscal_year")
    order = F.col("value").asc() if lowest else F.col("value").desc()
    return (
        values.withColumn("n_members", F.count("*").over(group))
        .where("n_members >= 2")
        .withColumn("place", F.row_number().over(group.orderBy(order, "doc_pos")))
        .withColumn("name", readable(F.col("member")))
    )
