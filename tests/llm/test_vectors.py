"""Hard negatives: against brute force and SQL, on odd rows, and the coordinate ranges by themselves."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import negatives


def brute(rows, anchor, positives=5, negatives=10):
    """rows: (row, id or None, label, terms). The result, sorted."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for row, own, label, terms in rows:
        if not anchor(own):
            continue
        others = [(dot(terms, t), i, k) for r, i, k, t in rows if r != row]
        for p, pid, _ in sorted((o for o in others if o[2] == label), key=order)[:positives]:
            fit = sorted((o for o in others if o[2] != label and 30 * p <= 100 * o[0] <= 90 * p), key=order)[:negatives]
            out += [(own, pid, n, i, p, s) for n, (s, i, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return negatives.vectors(frame.repartition(3), "vec_id", "embedding", F.col("label"), 256)


def plain(stored):
    return [(r["row"], None if r["no_id"] else r["id"], r["label"], r["terms"]) for r in stored.collect()]


@pytest.mark.parametrize("sizes", [{}, {"bucket": 17, "block": 3, "seeds": 40}, {"seeds": 1}])
def test_negatives_against_brute_force(spark, sizes):
    random = np.random.default_rng(1)
    rows = []
    for i in range(150):
        vector = (random.normal(0, 1, 6) + 2 * (np.arange(6) == i % 3)) * 10.0 ** random.integers(-2, 2)
        rows.append((None if i % 3 == 1 else i, vector.tolist(), [0, 0, 0, 1, 2][i % 5]))
    rows += [(200, rows[0][1], 0), (200, rows[0][1], 0), (200, rows[1][1], 1), (None, rows[2][1], 0), (None, rows[3][1], 1)]  # repeated, tied, without id
    rows += [(300, [0.0] * 6, 0), (301, [0.0] * 6, 1), (302, [1.0], 1), (303, [], 0)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 1), (404, [1.0] * 6, None)]
    stored = table(spark, rows)
    own = plain(stored)
    assert len(own) == len(rows) - 5
    got = negatives.mine(stored, stored.where("not no_id and id % 10 = 0"), **sizes)
    want = brute(own, lambda i: i is not None and i % 10 == 0)
    assert any(w[3] is None for w in want)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_negatives_empty_and_clashing(spark, folder):
    none = table(spark, [])
    assert negatives.mine(none, none).count() == 0
    one = table(spark, [(0, [1.0, 2.0], 1)])
    assert negatives.mine(one, one).count() == 0
    extra = spark.createDataFrame([(i, [float(i % 3), 1.0 + i % 2], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int")
    extra = extra.select("*", *[F.lit("x").alias(n) for n in ("row", "terms", "length", "step", "cell", "block", "windows", "score", "part")])
    stored = negatives.vectors(extra, "vec_id", "embedding", F.col("label"), 256)
    assert sorted((tuple(r) for r in negatives.mine(stored, stored.where("id = 0")).collect()), key=str) == brute(plain(stored), lambda i: i == 0)


def test_negatives_query_against_sql(spark, folder):
    got = sorted(map(tuple, negatives.op11_negatives(spark, folder).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        assert got == sorted(db.execute(negatives.SQL).fetchall()) and got


def test_ranges_lose_nothing_and_prune():
    random = np.random.default_rng(2)
    read = kept = 0
    for trial in range(300):
        terms = np.rint(random.normal(0, 40, (200, 5)) + random.integers(-1, 2) * 80 * (np.arange(5) == trial % 5)).astype("int64")
        bucket, query = negatives.Bucket(terms), np.rint(random.normal(0, 40, 5)).astype("int64")
        score = terms @ query
        low, high = sorted(random.choice(score, 2).tolist())
        found = set(bucket.candidates(query, low, high).tolist())
        assert set(np.flatnonzero((score >= low) & (score <= high)).tolist()) <= found
        assert set(np.flatnonzero(score >= high).tolist()) <= set(best := bucket.candidates(query, np.sort(score)[-3], math.inf).tolist()) or high < np.sort(score)[-3]
        read, kept = read + len(score), kept + len(best)
    assert kept < 0.5 * read
