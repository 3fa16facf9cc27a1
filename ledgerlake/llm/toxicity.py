"""A toxicity classifier whose scores are held still when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import documents, stored

SAMPLE = 16_384  # labelled rows that the classifier is fitted on, at most
VOCABULARY = 8_192  # features, at most
LEAST_ROWS = 5  # labelled rows that a feature has to occur in
FOLDS = 5  # documents of fold 0 are held out
PENALTY = 1.0  # weight of the squared score change under a swap
DECAY = 3e-5

# Terms of groups of people that a neutral text may name; each is swapped for another one of its row.
IDENTITY = (
    ("woman", "man", "girl", "boy", "women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "foreigner", "citizen", "immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "old", "young"),
    ("femme", "homme", "femmes", "hommes", "musulman", "chrétien", "juif", "immigré", "étranger"),
    ("mujer", "hombre", "mujeres", "hombres", "musulmán", "cristiano", "judío", "inmigrante", "extranjero"),
    ("frau", "mann", "frauen", "männer", "moslem", "christ", "jude", "einwanderer", "ausländer"),
)
_OTHER = {term: row[(i + 1) % len(row)] for row in IDENTITY for i, term in enumerate(row)}
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@lru_cache(maxsize=1 << 17)
def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which stand for its inflected forms."""
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n))


def _features(found: set[str]) -> set[str]:
    return {f for w in found for f in features(w)}


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        known = {f for w in words(text) for f in _known(w, self)}
        z = self.bias + sum(map(get, sorted(known)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __hash__(self) -> int:
        return id(self)


@lru_cache(maxsize=1 << 18)
def _known(word: str, model: Classifier) -> tuple[str, ...]:
    return tuple(f for f in features(word) if f in model.weights)


def fit(rows: list[list[int]], swapped: list[list[int]], label: np.ndarray, size: int, toxic_share: float, penalty: float = PENALTY, decay: float = DECAY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, minimising log loss + penalty * mean (change of the score under the swap)**2.

    swapped[i] holds the features of row i after the swap, which are rows[i] where nothing was swapped. toxic_share is
    the share of toxic rows among all labelled ones, whatever their share among these. Plain gradient
    descent with momentum scaled per weight, from zero: the same input gives the same weights.
    """
    weight, bias = np.zeros(size), 0.0
    if not len(rows) or label.min() == label.max():
        return weight, 0.0 if not len(rows) else (4.0 if label.max() else -4.0)
    col = np.concatenate([np.asarray(r, "int64") for r in rows] or [np.zeros(0, "int64")])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    moved = [i for i, (a, b) in enumerate(zip(rows, swapped)) if a != b]
    # The change of row i's sum: +1 for features that the swap brings, -1 for those that it takes.
    d_row = np.concatenate([np.full(len(rows[i]) + len(swapped[i]), k) for k, i in enumerate(moved)] or [np.zeros(0)]).astype("int64")
    d_col = np.concatenate([np.asarray([*swapped[i], *rows[i]]) for i in moved] or [np.zeros(0)]).astype("int64")
    d_sign = np.concatenate([np.r_[np.ones(len(swapped[i])), -np.ones(len(rows[i]))] for i in moved] or [np.zeros(0)])
    share = np.where(label == 1, toxic_share / (label == 1).sum(), (1 - toxic_share) / (label == 0).sum())
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[col], len(rows)), -30, 30)))
        g = share * (p - label)
        grad = np.bincount(col, g[row], size) + 2 * decay * weight
        if moved:
            change = np.bincount(d_row, d_sign * weight[d_col], len(moved))
            grad += np.bincount(d_col, 2 * penalty / len(moved) * change[d_row] * d_sign, size)
        grad = np.r_[grad, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, penalty: float = PENALTY) -> Classifier:
    """A classifier from at most `sample` labelled rows outside fold 0, up to half of them toxic.

    The rows are those with the smallest digests of their id. Their ids, at most `sample`, are broadcast to find the
    texts; features are counted by Spark, and the `vocabulary` most telling ones (by the standardised difference of their
    shares among toxic and other rows), with the identity terms, are fitted.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(_fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known, "toxic-labels")
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.where(F.col("toxic") == t).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample // 2) for t in (0, 1)]
    drawn = stored(drawn[0].union(drawn[1]), "toxic-sample")

    @F.pandas_udf(T.StructType([T.StructField("own", T.ArrayType(T.StringType())), T.StructField("swap", T.ArrayType(T.StringType()))]))
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = words(text)
            swap = {_OTHER.get(w, w) for w in found}
            out.append((sorted(_features(found)), sorted(_features(swap)) if swap != found else None))
        return pd.DataFrame(out, columns=["own", "swap"])

    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", read("text").alias("f"))
    picked = stored(picked.select("toxic", "f.own", "f.swap"), "toxic-features")
    size = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    bad, good = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    share = F.col("n") / F.lit(bad + good)
    telling = F.abs(F.col("n1") / F.lit(bad) - (F.col("n") - F.col("n1")) / F.lit(good)) / F.sqrt(share * (1.0001 - share) * F.lit(1 / bad + 1 / good))
    counted = picked.select("toxic", F.explode("own").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
    names = [r["feature"] for r in counted.where(F.col("n") >= LEAST_ROWS).where(telling >= 4).orderBy(F.desc(telling), "feature").limit(vocabulary).collect()]
    names = sorted({*names, *(f for term in _OTHER for f in features(term))})
    index = {name: i for i, name in enumerate(names)}

    @F.pandas_udf(T.StructType([T.StructField("own", T.ArrayType(T.IntegerType())), T.StructField("swap", T.ArrayType(T.IntegerType()))]))
    def numbered(own: pd.Series, swap: pd.Series) -> pd.DataFrame:
        pick = lambda found: None if found is None else sorted(index[f] for f in found if f in index)
        return pd.DataFrame({"own": own.map(pick), "swap": [pick(x) for x in swap]})

    small = picked.select("toxic", numbered("own", "swap").alias("f")).select("toxic", "f.own", "f.swap").toPandas()
    rows = [list(map(int, r)) for r in small["own"]]
    swapped = [a if r is None else list(map(int, r)) for a, r in zip(rows, small["swap"])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i], swapped[i], small["toxic"][i]))
    rows, swapped, small = [rows[i] for i in order], [swapped[i] for i in order], small.iloc[order]
    weight, bias = fit(rows, swapped, small["toxic"].to_numpy("float64"), len(names), shares.get(1, 0) / max(sum(shares.values()), 1), penalty)
    return Classifier({n: float(w) for n, w in zip(names, weight) if w}, bias)


def _fold(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of `docs` with held_out, score and predicted.

    The score depends on the text alone. A null or empty text gets the score of no word; a null doc_id belongs to no
    training row and is put in the fold of the empty text; repeated rows are each scored; added columns replace input
    columns of the same name; no rows give no rows. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier(*shared.value)
        for batch in batches:
            yield pd.Series([own.score(x) for x in batch], dtype="float64")

    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    found = docs.select(*kept, (_fold("doc_id") == 0).alias("held_out"), score("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return scored(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).drop("text")
