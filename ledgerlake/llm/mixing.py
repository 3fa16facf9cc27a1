"""Mixing sources to target weights along a curriculum that changes with training time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import WORD, documents, no_nulls, parts, running_sum, stored

WEIGHTS = (3.0, 1.0, 2.0)  # of the sources in order, repeating
SLOPES = (-0.5, 0.0, 0.5)  # how a source's weight changes from the start of training to its end, repeating
SHARE = 1.5  # words of the mix per word of the corpus
PASSES = 2  # a document is taken this many times at most


def _cyclic(values: tuple[float, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Of (source_key, source, source_size), one row each: the words to take from each source.

    Every source gets `share` x all words in proportion to its weight, but no more than `passes` times its own words;
    what is above that goes to the others by weight. That ends at min(passes * size, level * weight) with one level for
    all, found from running sums over the sources in the order in which they fill up. The windows run over one row per
    source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn("_index", F.row_number().over(by_name) - 1)
        .withColumn("weight", _cyclic(weights, F.col("_index")))
        .withColumn("slope", _cyclic(slopes, F.col("_index")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(passes)))
        .withColumn("_full_at", F.col("_cap") / F.col("weight"))
        .withColumn("_wanted", F.sum("source_size").over(everything) * F.lit(share))
    )
    level = (F.col("_wanted") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The quotient rises while sources that fill up are passed and falls afterwards, so the level is its maximum.
    ranked = ranked.withColumn("_level", F.max(level).over(everything))
    return ranked.select(
        "source_key", "source_size", "slope",
        F.least(F.col("_cap"), F.col("_level") * F.col("weight")).alias("target"),
    )


def position(demand: Column, slope: Column) -> Column:
    """The time in [0, 1) at which a source has given the fraction `demand` of its target.

    Its weight is proportional to 1 + slope * (2t - 1), so up to time t it has given t + slope * (t*t - t).
    """
    root = F.sqrt((F.lit(1.0) - slope) * (F.lit(1.0) - slope) + F.lit(4.0) * slope * demand)
    return F.when(slope == 0.0, demand).otherwise((root - (F.lit(1.0) - slope)) / (F.lit(2.0) * slope) + F.lit(0.0))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, passes: int = PASSES, digits: int = 3) -> DataFrame:
    """The rows of `docs` with size, source_size, target, taken and first_position, second_position, ...

    Method: the documents of a source form a line, in the order of a digest of their id and text; passes over the line make up
    the source's target, the last one ending at the document whose middle the target reaches. A document's place on
    the line is cumulative demand, which the inverse of the source's integrated weight schedule turns into a training
    position. Positions of passes that are not taken are null.

    A null text has size 0; null is a source of its own, the last; rows of size 0 are taken 0 words and have no
    position; repeated rows and equal ids are placed one behind the other, in the same order however the rows are dealt
    (rows of one source, id and text are alike, so their order does not show); no rows give no rows. Input columns with
    the name of an added one are replaced. A source with most rows is spread by digest, see running_sum.
    """
    sized = (
        docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
        .withColumn("source_key", no_nulls("source"))
        .withColumn("_order", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))))
    )
    sized = sized.drop("source_size", "slope", "target")
    groups = stored(parts(sized, "source_key", "_order", "size", digits, "source"), "mix-parts")
    totals = groups.groupBy("source_key", "source").agg(F.sum("_sum").alias("source_size"))
    groups = groups.drop("source").join(targets(totals, weights, slopes, share, passes), "source_key")
    placed = running_sum(sized, groups, "source_key", "_order", "size", "_start", digits)
    whole = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    rest = F.col("target") - whole * F.col("source_size")
    last = (F.col("_start") + F.col("size") / F.lit(2.0) < rest).cast("long")
    placed = placed.withColumn("_times", F.when(F.col("size") > 0, whole + last).otherwise(0).cast("int"))
    placed = placed.withColumn("taken", F.col("_times") * F.col("size"))
    for n, name in enumerate(names(passes)):
        demand = (F.lit(float(n)) * F.col("source_size") + F.col("_start")) / F.col("target")
        placed = placed.withColumn(name, F.when(F.col("_times") > n, position(F.least(demand, F.lit(1.0)), F.col("slope"))))
    return placed.drop("source_key", "_order", "_start", "_times", "slope")


def names(passes: int) -> list[str]:
    first = ["first_position", "second_position", "third_position"]
    return [*first, *(f"position_{n + 1}" for n in range(3, passes))][:passes]


def curriculum(docs: DataFrame, passes: int = PASSES, **options) -> DataFrame:
    """The mix as a training stream: a row of `docs` for each time it is taken, range-sorted by training position."""
    kept = docs.columns
    taken = mix(docs, passes=passes, **options).select(*kept, F.explode(F.array_compact(F.array(*names(passes)))).alias("_position"))
    return taken.orderBy("_position").select(*kept)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix range-sorted by first position; documents that are not taken come first."""
    docs = documents(spark, folder).select("doc_id", "text", "source")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position", "second_position")
    return mixed.orderBy("first_position", "doc_id")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(i % 3) + 1] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(i % 3) + 1] AS slope
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM totals)),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at,
                (SELECT sum(source_size) FROM totals) * 1.5::DOUBLE AS wanted FROM ranked),
levels AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
one AS (SELECT max(levels.level) AS level FROM levels),
goal AS (
  SELECT source, source_size, slope, least(cap, one.level * weight) AS target
  FROM levels, one),
line AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.slope,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT *, CASE WHEN size > 0 THEN floor(target / source_size)
                 + CASE WHEN start + size / 2.0::DOUBLE < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END ELSE 0 END AS times
  FROM line),
demands AS (SELECT *, least(start / target, 1.0::DOUBLE) AS d1, least((source_size + start) / target, 1.0::DOUBLE) AS d2 FROM passes)
SELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken,
  CASE WHEN times > 0 THEN CASE WHEN slope = 0 THEN d1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * d1) - (1 - slope)) / (2 * slope) + 0.0::DOUBLE END END AS first_position,
  CASE WHEN times > 1 THEN CASE WHEN slope = 0 THEN d2 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * d2) - (1 - slope)) / (2 * slope) + 0.0::DOUBLE END END AS second_position
FROM demands
"""
