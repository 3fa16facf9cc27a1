"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.session import scratch_dir, shuffles_dropped

# A word: a run of anything but a blank and the five ASCII control blanks. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that stored() writes inside the block, for drop() once what was built on them is written; a block around it has them too."""
    paths: list[str] = []
    token = _recorded.set(paths)
    try:
        yield paths
    finally:
        _recorded.reset(token)
        if (around := _recorded.get()) is not None:
            around.extend(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here."""
    spark = rows.sparkSession
    path = scratch_dir(spark, purpose)
    if (paths := _recorded.get()) is not None:
        paths.append(path)
    with shuffles_dropped(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def no_nulls(column: str) -> Column:
    """A text that is null for no row and still differs for null and empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def parts(rows: DataFrame, by: str, order: str, value: str, digits: int = 3, *more: str) -> DataFrame:
    """(by, *more, _part, _sum): `value` summed over the rows of a `by` whose `order` starts with the same digits."""
    return rows.groupBy(by, *more, F.substring(order, 1, digits).alias("_part")).agg(F.sum(value).alias("_sum"))


def running_sum(rows: DataFrame, groups: DataFrame, by: str, order: str, value: str, name: str, digits: int = 3) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same `by` that come before, in the order of `order`.

    `by` holds no nulls; `order` is a hexadecimal text, such as a digest. Rows are dealt out by `by` and the first
    `digits` digits of `order`, so a `by` with most of the rows still spreads over 16**digits groups. What lies before a
    group comes from `groups`, which parts() made of the same rows; further columns of it are added too.
    """
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_part", F.substring(order, 1, digits))
        .join(groups, [by, "_part"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_base")
    )
