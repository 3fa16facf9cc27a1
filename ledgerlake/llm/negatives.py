"""Hard-negative mining: exact search by inner product with coordinate pruning inside buckets of like lengths."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score lies between these percentages of the positive's
RATIO = 0.9  # a bucket's vectors have at least this share of its greatest length
BUCKET = 4096  # rows of a bucket, about
BLOCK = 2048  # anchors of a block, about
SEEDS = 2048  # rows that first thresholds come from, at most
FOCUS = 4  # coordinates whose feasible ranges are intersected

_FOUND = "anchor long, part int, no_id boolean, id long, score long"


def vectors(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(row, id, no_id, label, terms, length, step), written: `terms` are floor(scale * x), `step` is the length's bucket.

    Rows with a null label, a null vector, or a null or non-finite component are left out. Every other row counts, also one
    of several with one key or with none (no_id): `row` tells them apart. Lengths of one step differ by less than
    RATIO; doubles have fewer than 14 000 steps, and 64-bit components of a vector some 450.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    terms = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    length = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    step = F.when(F.col("length") > 0, F.floor(-F.log("length") / math.log(RATIO))).otherwise(-1).cast("int")
    found = rows.where(label.isNotNull() & F.col(vector).isNotNull()).where(~bad)
    found = found.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("id"),
        F.col(key).isNull().alias("no_id"), label.alias("label"), terms.alias("terms"),
    )
    return stored(found.withColumn("length", length).withColumn("step", step), "vectors")


def _matrix(terms: pd.Series, width: int) -> np.ndarray:
    """One row per vector, padded with zeros."""
    out = np.zeros((len(terms), width), "int64")
    for row, t in zip(out, terms):
        row[: len(t)] = t
    return out


class Bucket:
    """Vectors of like lengths with the sorted list of each coordinate of their directions, made when first asked for."""

    def __init__(self, terms: np.ndarray):
        self.length = np.sqrt((terms.astype("float64") ** 2).sum(axis=1))
        self.unit = terms / np.where(self.length > 0, self.length, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            place = np.empty(len(order), "int64")
            place[order] = np.arange(len(order))
            self.lists[f] = order, self.unit[order, f], place
        return self.lists[f]

    def candidates(self, query: np.ndarray, low: float, high: float, focus: int = FOCUS) -> np.ndarray:
        """Positions that hold every vector whose product with `query` lies in [low, high].

        The product bounds the cosine, and so the angle between the two, to a range; with a the angle between the query and an axis, a
        vector's coordinate on it is the cosine of an angle between |a - angle| and a + angle. These feasible ranges are found in the sorted
        lists of the query's largest coordinates, and the shortest one is thinned by the others.
        """
        own = math.sqrt(float((query.astype("float64") ** 2).sum()))
        every = np.arange(len(self.length))
        if low > high or not len(every):
            return every[:0]
        if not own or not self.length.max():
            return every if low <= 0 <= high else every[:0]
        least, most = own * self.length.min() or 1e-300, own * self.length.max()
        lowest = low / (most if low >= 0 else least) - 1e-9
        highest = high / (least if high >= 0 else most) + 1e-9
        if lowest > 1 or highest < -1:
            return every[:0]
        near, far = math.acos(min(highest, 1.0)), math.acos(max(lowest, -1.0))
        ranges = []
        for f in np.argsort(-np.abs(query), kind="stable")[:focus]:
            axis = math.acos(max(-1.0, min(1.0, float(query[f]) / own)))
            top = 1.0 if near <= axis <= far else math.cos(near - axis if axis < near else axis - far)
            bottom = -1.0 if axis + near <= math.pi <= axis + far else math.cos(axis + far if axis + far < math.pi else axis + near)
            order, values, place = self._list(int(f))
            ranges.append((np.searchsorted(values, bottom - 1e-7, "left"), np.searchsorted(values, top + 1e-7, "right"), order, place))
        ranges.sort(key=lambda r: r[1] - r[0])
        if not ranges:
            return every
        begin, end, order, _ = ranges[0]
        return reduce(lambda at, r: at[(r[3][at] >= r[0]) & (r[3][at] < r[1])], ranges[1:], order[begin:end])


def _cell(rows: pd.DataFrame, asked: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best rows of one bucket for each window of each anchor of one block, verified by exact products."""
    empty = pd.DataFrame({"anchor": [], "part": [], "no_id": [], "id": [], "score": []})
    if not len(rows) or not len(asked):
        return empty.astype({"anchor": "int64", "part": "int32", "no_id": "bool", "id": "int64", "score": "int64"})
    width = max(rows["terms"].map(len).max(), asked["terms"].map(len).max())
    terms, queries = _matrix(rows["terms"], width), _matrix(asked["terms"], width)
    bucket, exact = Bucket(terms), terms
    if width and float(np.abs(terms).max()) * float(np.abs(queries).max()) * width < 2**52:
        exact, queries = terms.astype("float64"), queries.astype("float64")  # integers below 2**53 are exact
    own, label, ids, no_id = (rows[c].to_numpy() for c in ("row", "label", "id", "no_id"))
    out = []
    for anchor, kind, query, windows in zip(asked["row"], asked["label"], queries, asked["windows"]):
        at = bucket.candidates(query, min(w["low"] for w in windows), max(w["high"] for w in windows))
        at = at[((label[at] == kind) == same) & (own[at] != anchor)]
        score = (exact[at] @ query).astype("int64")
        for w in windows:
            inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
            if len(inside) > k:
                inside = inside[score[inside] >= np.partition(score[inside], -k)[-k]]
            inside = inside[np.lexsort((ids[at[inside]], no_id[at[inside]], -score[inside]))[:k]]
            out.append(pd.DataFrame({"anchor": anchor, "part": w["part"], "no_id": no_id[at[inside]], "id": ids[at[inside]], "score": score[inside]}))
    return pd.concat(out, ignore_index=True)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "no_id", "id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def _pass(rows: DataFrame, asked: DataFrame, k: int, same: bool, bucket: int, block: int) -> DataFrame:
    """One look at `rows`. The steps' table that reaches the driver has one entry per length step (see vectors())."""
    steps = rows.groupBy("step").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()
    blocks = max(1, math.ceil(asked.count() / block))
    if not steps:
        return _ranked(rows.sparkSession.createDataFrame([], _FOUND), k)
    parts = {s["step"]: math.ceil(s["n"] / bucket) for s in steps}
    of_step = F.create_map(*(F.lit(x) for s in parts.items() for x in s))
    left = rows.select("*", F.pmod(F.xxhash64("row"), of_step[F.col("step")]).cast("int").alias("cell"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # A bucket is looked at by the anchors whose weakest demand its longest vector can meet.
    buckets = F.array(*(F.struct(F.lit(s["step"]).alias("step"), F.lit(parts[s["step"]]).alias("parts"), F.lit(s["longest"]).alias("longest")) for s in steps))
    reach = lambda b: F.col("length") * b["longest"] * 1.000001 + 1
    meets = lambda b: F.exists("windows", lambda w: (w["low"] <= reach(b)) & (w["high"] >= -reach(b)))
    right = asked.select("row", "label", "terms", "length", "windows", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    right = right.withColumn("b", F.explode(F.filter(buckets, meets))).select("*", F.col("b.step").alias("step"), F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)).alias("cell")).drop("b")
    keys = ("step", "cell", "block")
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _cell(a, b, k, same), _FOUND)
    return _ranked(cells, k)


def search(rows: DataFrame, asked: DataFrame, k: int, same: bool, bucket: int = BUCKET, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """(anchor, part, rank, no_id, id, score): for each window of an anchor its k best rows of the same label, or of other labels.

    rows as vectors() gives them; asked: some of these rows with windows array<struct<part int, low long, high long>>, bounds included. Higher
    scores come first, ties by smaller id, rows without an id last. First a sample of at most `seeds` rows is searched: where it holds k rows for a window, the
    k-th score is a lower bound that all buckets share. Then length buckets, split at `bucket` rows, meet blocks of anchors; a bucket
    gives k rows for a window at most, and the merge keeps the first k before and after its shuffle. Thresholds prune only what cannot be among
    the first k: results do not depend on sizes. A label or length with most of the rows is split like any other. Shorter vectors count as padded
    with zeros; scores beyond 64 bits are not supported; no rows or anchors give no rows.
    """
    height, steps = rows.count(), 1 << 30
    cut = steps if height <= seeds else int(steps * max(0.0, seeds - 4 * math.sqrt(seeds)) / height)
    sample = stored(rows.where(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(steps)) < cut).limit(seeds), "seeds")
    first = _pass(sample, asked, k, same, seeds, block).groupBy("anchor", "part").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    first = first.where(F.col("n") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("part", "least"))).alias("least"))
    raised = lambda w: F.struct(w["part"].alias("part"), F.greatest(w["low"], F.col("least")[w["part"]]).alias("low"), w["high"].alias("high"))
    asked = asked.join(first, F.col("row") == F.col("anchor"), "left").withColumn("windows", F.transform("windows", raised))
    return _pass(rows, stored(asked.drop("anchor", "least"), "asked"), k, same, bucket, block)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best `positives` other rows of its label; for each of them, the best `negatives` rows of other
    labels whose score lies between `low` and `high` percent of the positive's. A negative positive score leaves no room for
    any. Equal and repeated rows count one by one; an anchor with a null id has a null anchor_id.
    """
    least, most = -(1 << 63), (1 << 63) - 1
    window = lambda part, a, b: F.struct(part.cast("int").alias("part"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    asked = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(least), F.lit(most))))
    best = stored(search(rows, asked, positives, True, **sizes), "positives")
    under = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")  # noqa: E731  the quotient rounded down, exactly
    bounds = best.select("anchor", window(F.col("rank"), -under(f"(-{low}L * score)"), under(f"({high}L * score)")).alias("w")).where("w.low <= w.high")
    bounds = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # `positives` at most
    asked = stored(anchors.join(bounds, F.col("row") == F.col("anchor")).drop("anchor"), "windows")
    found = search(rows, asked, negatives, False, **sizes)
    name = lambda side: F.when(~F.col(f"{side}no_id"), F.col(f"{side}id"))
    pairs = best.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("a_id"), F.col("no_id").alias("a_no_id")), "anchor")
    pairs = pairs.select("anchor", F.col("rank").alias("part"), name("a_").alias("anchor_id"), name("").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(found, ["anchor", "part"]).select("anchor_id", "positive_id", "rank", name("").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", label, 256)
    return mine(rows, rows.where("not no_id and id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS n FROM scored WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
