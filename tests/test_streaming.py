"""Incremental jobs give what a batch gives."""

import datetime as dt

from ledgerlake.operators import passages
from ledgerlake.session import scratch_dir
from ledgerlake.sources import html
from ledgerlake.sources.store import Store
from ledgerlake.streaming import jobs


def test_ingest_stream_matches_batch_and_skips_repeats(spark, tmp_path):
    incoming, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), 4)
    incoming.mkdir()
    (incoming / "a.htm").write_text("<p>one</p><hr><p>two words.</p>")
    (incoming / "b.exe").write_text("nope")
    (incoming / "d.pdf").write_text("%PDF")
    (incoming / "blank.htm").write_text("<p> </p>")
    jobs.ingest_stream(spark, str(incoming), store, str(tmp_path / "p")).start().awaitTermination()
    (incoming / "c.html").write_text("<p>three</p>")
    (incoming / "copy.htm").write_text("<p>one</p><hr><p>two words.</p>")
    jobs.ingest_stream(spark, str(incoming), store, str(tmp_path / "p")).start().awaitTermination()
    now = store.snapshot()
    files = html.scan(spark, str(incoming))[0]
    batch = files.where("original_name not like '%.pdf'").select(html.content_hash("content").alias("filing_id"), html.decode_text(files.content).alias("html")).dropDuplicates(["filing_id"])
    want = passages.passages(html.pages(batch))
    assert sorted(r.passage_id for r in now.table("passages").collect()) == sorted(r.passage_id for r in want.collect())
    assert sorted(r.status for r in now.table("filings").collect()) == ["failed", "ready", "ready"]
    assert sorted(r.path.rsplit("/")[-1] for r in now.table("rejected").collect()) == ["b.exe", "d.pdf"]
    jobs.ingest_batch(spark.read.format("binaryFile").load(str(incoming)), 0, store)
    assert store.snapshot().number == now.number  # a batch that is known changes nothing


def test_stuck_filings(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    src = str(tmp_path / "src")
    schema = "filing_id string, status string, ts timestamp"
    at = lambda m: start + dt.timedelta(minutes=m)
    spark.createDataFrame([("a", "parsing", at(0)), ("b", "parsing", at(0)), ("b", "ready", at(5)), ("c", "queued", at(100))], schema).coalesce(1).write.parquet(src)
    rows = jobs.stuck_filings(spark.readStream.schema(schema).parquet(src), minutes=30)
    got = jobs.finished(rows, spark, "stuck")
    assert [(r.filing_id, r.status, r.last_status) for r in got.collect()] == [("a", "failed", "parsing")]


def test_arrivals_are_deduplicated_per_workspace(spark, tmp_path):
    src = str(tmp_path / "up")
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "content_hash string, user_id long, ts timestamp"
    spark.createDataFrame([("h", None, t), ("h", None, t), ("h", 7, t), ("g", 7, t)], schema).write.parquet(src)
    rows = jobs.first_arrivals(spark.readStream.schema(schema).parquet(src))
    assert jobs.finished(rows, spark, "arrivals").count() == 3


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
    assert not root or first.startswith(root)


def test_arrival_feed_sees_what_is_stored(spark, tmp_path):
    store, src, progress = Store(spark, str(tmp_path / "store"), 4), str(tmp_path / "up"), str(tmp_path / "p")
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "filing_id string, user_id string, content_hash string, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        feed = jobs.arrival_feed(spark.readStream.schema(schema).parquet(src), store, progress, "1 hour")
        feed.start().awaitTermination()
        return sorted(r.filing_id for r in store.snapshot().table("arrivals").collect())

    assert arrive(("1", "a", "h", t), ("2", "b", "h", t), ("3", None, "h", t)) == ["1", "2", "3"]
    week = dt.timedelta(days=7)  # beyond the stream's memory
    assert arrive(("4", "a", "h", t + week), ("5", None, "h", t + week), ("6", "a", "g", t + week)) == ["1", "2", "3", "6"]
    jobs.accept_arrivals(spark.createDataFrame([("9", "z", "h", t)], schema), 0, store)
    assert store.snapshot().table("arrivals").count() == 4


def test_status_feed_is_the_batch_state(spark, tmp_path):
    store, src = Store(spark, str(tmp_path / "store"), 4), str(tmp_path / "changes")
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    schema = "filing_id string, ts timestamp, status string"
    late = [("a", at(9), "ready"), ("b", at(1), "queued"), ("b", at(1), "parsing")]
    for rows in (late, [("a", at(3), "parsing"), ("c", at(4), "failed")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.status_feed(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "p")).start().awaitTermination()
    want = {"a": "ready", "b": "queued", "c": "failed"}
    state = lambda: {r.filing_id: r.change.status for r in store.snapshot().table("status").collect()}
    assert state() == want
    jobs.upsert_status(jobs.latest_status(spark.createDataFrame([("a", at(3), "parsing")], schema)), 99, store)
    assert state() == want


def test_end_of_input_closes_windows(spark, tmp_path):
    src, t = str(tmp_path / "events"), dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    spark.createDataFrame([(1, t, "x", 2.0), (2, t + dt.timedelta(days=1), "x", 3.0)], "user_id long, ts timestamp, event_type string, value double").write.parquet(src)
    end = jobs.EndOfInput(spark)
    rows = end.attach(spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").parquet(src))
    assert sorted(r.value for r in jobs.finished(jobs.usage(rows), spark, "closed", end).collect()) == [2.0, 3.0]
