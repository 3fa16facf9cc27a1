"""The factorisation machine: the linear-time sum against all pairs, its gradient, held-out accuracy, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import factors


def test_pairs_in_linear_time():
    random = np.random.default_rng(0)
    size = factors.WORDS + len(factors.STATISTICS) * (factors.CUTS + 2)
    machine = factors.Machine(0.3, random.normal(0, 0.1, size), random.normal(0, 0.1, (size, 4)), [np.array([0.1, 1.0, 3.0])] * len(factors.STATISTICS))
    for text in ("", None, "one", "Some words, some WORDS again.\n\nand a line\nand a line", "x " * 3000):
        index, x = machine.features(*factors.read(text, ()))
        pairs = sum(machine.factors[a] @ machine.factors[b] * x[i] * x[j] for i, a in enumerate(index) for j, b in enumerate(index) if i < j)
        assert machine.score(text) == pytest.approx(1 / (1 + math.exp(-(machine.bias + machine.weights[index] @ x + pairs))))


def test_fit_learns_an_interaction():
    """Label 1 where exactly one of two words occurs: no linear score can tell."""
    texts = ["left", "right", "left right", "none"] * 40
    rows = [factors.read(f"{t} filler word{i % 7}", ()) for i, t in enumerate(texts)]
    rows = [(b, v, []) for b, v, _ in rows]
    label = np.array([t in ("left", "right") for t in texts], "float64")
    score = lambda rank: [m.score(f"{t} filler word1") for m in [factors.fit(rows, label, 0.5, rank=rank, steps=300)] for t in texts[:4]]
    with_pairs = score(8)
    assert min(with_pairs[:2]) > 0.8 and max(with_pairs[2:]) < 0.2
    assert factors.fit([], np.zeros(0), 0.0).score("any") == 0.5
    assert factors.fit(rows, np.ones(len(rows)), 1.0).score("left") > 0.9


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    rows = factors.op12_factors(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(bad) > 50 and np.mean(good) >= 0.99 and np.mean(bad) <= 0.03


def test_factors_odd_rows(spark, folder, odd, clashing, nothing):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = factors.train(docs, labels)
    long = spark.createDataFrame([(77, "a few words " * 1_000_000)], "doc_id long, text string")
    got = factors.scored(clashing, machine).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["text"] in ("", None)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (7, 8)}) == 1
    assert [c for c in factors.scored(clashing, machine).columns if c not in clashing.columns] == []
    assert factors.scored(long, machine).count() == 1
    assert factors.scored(nothing, machine).count() == 0
    assert factors.train(nothing, labels).score("x") == 0.5
    twice = factors.train(docs.union(docs).repartition(5), labels.union(labels))
    assert np.array_equal(twice.weights, machine.weights) and np.array_equal(twice.factors, machine.factors)
    meta = docs.withColumn("m", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("n_chars")))
    assert factors.scored(meta, factors.train(meta, labels, metadata=["m"]), metadata=["m"]).where("score is null").count() == 0


def test_sample_is_bounded(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("int(id % 10 = 0)").alias("quality"))
    drawn, share = factors.drawn(labels, "quality", 1000)
    counts = {r["quality"]: r["count"] for r in drawn.groupBy("quality").count().collect()}
    assert 300 < counts[0] <= 500 and 300 < counts[1] <= 500 and abs(share - 0.1) < 0.01
    assert drawn.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").count() == 0
