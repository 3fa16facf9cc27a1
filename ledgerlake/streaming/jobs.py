"""Incremental jobs: filing ingest, arrival dedup, status feed, stuck detection, usage rollups."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlake.operators.history import TERMINAL
from ledgerlake.plans import batches
from ledgerlake.session import scratch_dir
from ledgerlake.sources import html
from ledgerlake.sources.store import Store

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

FILINGS = "filing_id STRING, status STRING, error STRING, num_pages INT"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder as a stream; the zone-less time is cast because a watermark needs a timestamp."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def usage(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events, users, failures and value per window and type; rows later than the delay are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"),
             F.max("value").alias("max_value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "users", "value", "max_value")
    )


def sliding_usage(events: DataFrame, width: str = "1 day", slide: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n")
    )


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("session_window.start").alias("session_start"), "user_id", "n", "value")
    )


STATUS = "filing_id STRING, change STRUCT<ts: TIMESTAMP, status: STRING>"


def latest_status(changes: DataFrame) -> DataFrame:
    """Latest change per filing, for update mode; one state row per filing. Of changes at one time the greatest status counts."""
    return changes.groupBy(F.col("filing_id").cast("string").alias("filing_id")).agg(F.max(F.struct("ts", "status")).alias("change"))


def upsert_status(latest: DataFrame, batch_id: int, store: Store, stream: str = "status") -> None:
    """The rows of one update into the store's `status` table, by filing; the later change of a filing stays.

    So a batch that is replayed, or one that arrives behind a later one, leaves the same table. One row per filing is
    written, and only the buckets of the filings in the update.
    """
    change = store.change()
    if change.base.done.get(stream, -1) >= batch_id:
        return
    latest = latest.select("filing_id", "change")
    before = change.base.table("status", STATUS).join(latest.select("filing_id"), "filing_id", "left_semi")
    merged = before.unionByName(latest).groupBy("filing_id").agg(F.max("change").alias("change"))
    change.commit(change.put("status", merged), stream, batch_id)


def status_feed(changes: DataFrame, store: Store, progress: str):
    """A running feed of changes (filing_id, ts, status) into the store's `status` table; one version per micro-batch."""
    return (
        latest_status(changes).writeStream.outputMode("update").foreachBatch(lambda rows, batch: upsert_status(rows, batch, store))
        .option("checkpointLocation", progress).trigger(availableNow=True)
    )


ARRIVALS = "filing_id STRING, user_id STRING, content_hash STRING, deleted_at TIMESTAMP"


def first_arrivals(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """Uploads whose content has not arrived in the same workspace within the delay."""
    keyed = uploads.withColumn("owner", F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("guest")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash", "owner"]).drop("owner")


def accept_arrivals(uploads: DataFrame, batch_id: int, store: Store, stream: str = "arrivals") -> None:
    """One micro-batch of uploads (filing_id, user_id, content_hash) into the store's `arrivals` table.

    Against what earlier batches, or uploads before the stream, have committed: the join reads the newest version in each batch. Deleted
    uploads do not count. A replayed batch changes nothing.
    """
    change = store.change()
    if change.base.done.get(stream, -1) >= batch_id:
        return
    fresh = html.new_uploads(uploads.select("filing_id", "user_id", "content_hash"), change.base.table("arrivals", ARRIVALS))
    rows = fresh.select("filing_id", "user_id", "content_hash", F.lit(None).cast("timestamp").alias("deleted_at"))
    change.commit(change.put("arrivals", rows), stream, batch_id)


def arrival_feed(uploads: DataFrame, store: Store, progress: str, delay: str = "1 day"):
    """A running dedup of uploads (filing_id, user_id, content_hash, ts): repeats in flight are dropped by the stream's state within the
    delay, repeats of anything stored by the join, however old. The same content in another workspace is an upload of its own."""
    return (
        first_arrivals(uploads, delay).writeStream.foreachBatch(lambda rows, batch: accept_arrivals(rows, batch, store))
        .option("checkpointLocation", progress).trigger(availableNow=True)
    )


class EndOfInput:
    """The end of a finite stream: one row without content and far ahead in time, which closes every window and session before it.

    Windows close when the watermark passes them, so those of the last rows would stay open for ever. attach() joins the stream
    with an empty folder; arrive() puts the row there once everything else is read. Its own window stays open, so it is in no result.
    """

    AT = "3000-01-01 00:00:00"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_dir(spark, "end-of-input")

    def attach(self, rows: DataFrame) -> DataFrame:
        self.schema = rows.schema
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        return rows.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def arrive(self, column: str = "ts") -> None:
        end = [F.lit(self.AT if f.name == column else None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*end).write.mode("append").parquet(self.folder)


def finished(rows: DataFrame, spark: SparkSession, purpose: str, end: EndOfInput | None = None) -> DataFrame:
    """Runs a stream over everything available, in append mode, and returns what it wrote.

    Results and progress go to the shared folder, so a restarted run continues where the last one stopped. With `end`, attached to the
    stream's input, a second run from there takes in the end of input and closes what was open.
    """
    out = scratch_dir(spark, purpose)

    def run() -> None:
        (
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress")
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        )

    run()
    if end is not None:
        end.arrive()
        run()
    return spark.read.schema(rows.schema).parquet(out)


class _StuckDetector(StatefulProcessor):
    """Keeps the last status per filing; a timer fires when no terminal status came in time."""

    def __init__(self, limit_ms: int, terminal: tuple[str, ...]):
        self.limit_ms = limit_ms
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts")
        last = batch.iloc[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last["status"] in self.terminal:
            self.status.clear()
        else:
            self.status.update((last["status"],))
            self.handle.registerTimer(int(last["ts"].timestamp() * 1000) + self.limit_ms)
        yield pd.DataFrame({"filing_id": [], "status": [], "last_status": []}, dtype=str)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.status.get()
        self.status.clear()
        yield pd.DataFrame({"filing_id": [str(key[0])], "status": ["failed"], "last_status": [last[0] if last else ""]})

    def close(self) -> None:
        pass


def stuck_filings(changes: DataFrame, minutes: int = 30, delay: str = "1 minute") -> DataFrame:
    """(filing_id, status, last_status): filings with no terminal status within the limit of their last change.

    Needs the RocksDB state store provider.
    """
    return (
        changes.withWatermark("ts", delay).groupBy("filing_id")
        .transformWithStateInPandas(
            statefulProcessor=_StuckDetector(minutes * 60_000, TERMINAL),
            outputStructType="filing_id string, status string, last_status string",
            outputMode="append", timeMode="EventTime",
        )
    )


def ingest_batch(files: DataFrame, batch_id: int, store: Store, stream: str = "ingest") -> None:
    """One micro-batch of raw files into the index store, visible all at once; a replayed batch is known and changes nothing.

    Content that is already stored and readable is skipped. Files that cannot be read are kept in `rejected` by their path.
    """
    change = store.change()
    if change.base.done.get(stream, -1) >= batch_id:
        return
    accepted, rejected = html.admit(files)
    is_pdf = F.lower("original_name").endswith(".pdf")
    unread = accepted.where(is_pdf).select("path", F.lit("PDF is not read here: bring its pages as a table").alias("error"))
    refused = change.put("rejected", rejected.select("path", "error").unionByName(unread).select(F.col("path").alias("filing_id"), "path", "error"))
    decoded = accepted.where(~is_pdf).select(
        html.content_hash(F.col("content")).alias("filing_id"), "path", "original_name", html.decode_text(F.col("content")).alias("html"))
    # Of files with the same content the one with the first path counts, in every run.
    same = decoded.groupBy("filing_id").agg(F.min_by(F.struct("original_name", "html"), "path").alias("file")).select("filing_id", "file.*")
    known = change.base.table("filings", FILINGS).where("status = 'ready'")
    arrived = change.put("markup", same.join(known, "filing_id", "left_anti"))  # read, decoded and hashed once
    batches.read_into(change, arrived)
    change.commit(arrived.select("filing_id").union(refused.select("filing_id")), stream, batch_id)


def ingest_stream(spark: SparkSession, incoming: str, store: Store, progress: str):
    """A running ingest of a folder: every new file once, all files present first, then stop.

    Schema and suffix rules are those of the batch scan. Start it again for later arrivals, or set a
    processing-time trigger on the returned builder to keep it running.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(incoming)
    return (
        files.writeStream.foreachBatch(lambda rows, batch: ingest_batch(rows, batch, store))
        .option("checkpointLocation", progress).trigger(availableNow=True)
    )
