"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Nothing here depends on the size of the data: AQE sizes shuffles and splits skewed joins at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, app: str = "ledgerlake", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder the cluster names in spark.checkpoint.dir.

    Only a session of one machine, as in tests, may leave the setting out; on a cluster a local folder would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@lru_cache(maxsize=None)
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action that ends in a written table are of no use after it: Spark may drop them at once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table written to the shared folder: lineage and plan end here, and a lost executor costs nothing.

    Markup and vectors repeat themselves, so zstd leaves a fraction of what the default codec does.
    """
    return written(rows, scratch_dir(rows.sparkSession, purpose))


def written(rows: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """stored() in a folder of one's own, for several writes or for drop()."""
    spark = rows.sparkSession
    with shuffles_dropped(spark):
        rows.write.mode(mode).option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch_dir() that nothing will read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
