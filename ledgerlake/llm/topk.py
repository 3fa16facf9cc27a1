"""Exact top-k search by inner product: MaxScore inside shards, results merged across shards."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored

K = 20
SHARD = 8192  # rows of a shard, about
BLOCK = 2048  # queries of a block, about
_SEED_TERMS, _SEED_ROWS = 8, 64


def usable(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, terms, row): floor(scale * x) of each component; rows with a null vector or a null or non-finite component are left out.

    Every other row takes part, also one of several with one id or without any; `row` tells them apart.
    """
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    terms = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    found = rows.where(F.col(vector).isNotNull()).where(finite)
    return found.select(F.col(key).alias("id"), terms.alias("terms"), F.monotonically_increasing_id().alias("row"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """One row per vector, padded with zeros."""
    out = np.zeros((len(vectors), width), "int64")
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def maxscore(lists: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (position, score) of a shard for one query, ties to the smaller id.

    lists: the posting list of each term over the shard's rows (ascending ids). A term's bound is the most that it can add
    to any score. From a first exact threshold, the terms with the smallest bounds that cannot reach it together are
    non-essential: essential lists are traversed for all rows, the others are probed, largest bound first, only for rows
    whose score can still reach the threshold. Rows that tie with the threshold stay until the end.
    """
    bound = np.maximum(np.maximum(query * lists.max(axis=1), query * lists.min(axis=1)), 0)
    order = np.argsort(-bound, kind="stable")
    n = lists.shape[1]
    least = -math.inf
    if n > k + 1 + _SEED_ROWS:
        start = order[:_SEED_TERMS]
        part = query[start] @ lists[start]
        seeds = np.argpartition(-part, k + _SEED_ROWS)[: k + _SEED_ROWS]
        seeds = seeds[ids[seeds] != own]
        least = np.partition(query @ lists[:, seeds], -k)[-k]
    rest = np.r_[np.cumsum(bound[order][::-1])[::-1][1:], 0]  # what the terms behind each one can add
    essential = int(np.argmax(rest < least)) + 1 if (rest < least).any() else len(order)
    score = np.zeros(n, lists.dtype)
    for term in order[:essential]:
        if query[term]:
            score += query[term] * lists[term]
    rows = np.flatnonzero((score + rest[essential - 1] >= least) & (ids != own)) if len(order) else np.flatnonzero(ids != own)
    score = score[rows]
    for at in range(essential, len(order)):
        term = order[at]
        score = score + query[term] * lists[term, rows]
        near = score + rest[at] >= least
        if not near.all():
            rows, score = rows[near], score[near]
    best = np.lexsort((ids[rows], -score))[:k]
    return rows[best], score[best]


def _cell(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query": [], "query_id": [], "none": [], "vec_id": [], "score": []}, dtype="int64").astype({"none": "bool"})
    width = max(rows["terms"].map(len).max(), queries["query_terms"].map(len).max())
    rows = rows.sort_values(["none", "id", "row"])  # a place in this order stands for a row, so that ties go by it
    ids, none, places = rows["id"].to_numpy(), rows["none"].to_numpy(), np.arange(len(rows))
    place_of = dict(zip(rows["row"], places))
    lists, asked = np.ascontiguousarray(_matrix(rows["terms"], width).T), _matrix(queries["query_terms"], width)
    if width and float(np.abs(lists).max()) * float(np.abs(asked).max()) * width < 2**52:
        lists, asked = lists.astype("float64"), asked.astype("float64")  # integers below 2**53 are exact
    out = []
    for row, query_id, query in zip(queries["query"], queries["query_id"], asked):
        at, score = maxscore(lists, places, query, place_of.get(row, -1), k)
        out.append(pd.DataFrame({"query": row, "query_id": query_id, "none": none[at], "vec_id": ids[at], "score": score.astype("int64")}))
    return pd.concat(out, ignore_index=True)


def search(rows: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k rows with the highest inner product, its own row left out.

    rows and queries are of usable(); queries have ids. Of rows with equal scores the smaller id comes first, rows without
    an id last; each of several queries with one id has its own k. Rows are dealt to shards and queries to blocks of a bounded size
    by digest; a task takes one block and one shard. A shard gives k rows for a query at most, and the merge keeps
    the first k of each query before and after its shuffle. Shorter vectors count as padded with zeros; fewer than k
    rows give all; no rows or no queries give no rows.
    """
    n, asked = rows.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(asked / block))
    span = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "terms", "row")
    # Own names: a cogroup loses columns of the second side that are the first side's as well.
    queries = queries.select(F.col("id").alias("query_id"), F.col("terms").alias("query_terms"), F.col("row").alias("query"))
    left = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).select("*", span(blocks).alias("block"))
    right = queries.select("*", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(blocks)).cast("int").alias("block")).select("*", span(shards).alias("shard"))
    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    best = cells.applyInPandas(lambda a, b: _cell(a, b, k), "query long, query_id long, none boolean, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "none", "vec_id"))
    return best.select("query_id", place.cast("int").alias("rank"), F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score").where(F.col("rank") <= k)


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(usable(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", 64), "vectors")
    return search(rows, rows.where("id % 20 = 0"))


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
