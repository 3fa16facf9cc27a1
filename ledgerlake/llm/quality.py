"""Quality rules and an isolation forest on the rules' statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import documents, stored

LEAST_WORDS = 50
REPEATED_PERCENT = 50
TREES = 200
SAMPLE = 256  # rows of a tree
KEPT_SHARE = 0.99  # of the labelled good documents that the threshold has to keep
BINS = 10_000

_BLANKS, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: list[bytes]) -> int:
    """Words inside a window of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "int64", n)
    pair = code[:-1] * len(seen) + code[1:]
    if len(seen) > 2_000_000:  # the product of three codes would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(seen) + code[2:], return_inverse=True, return_counts=True)
    twice, inside = times[which] > 1, np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a whole text; a null text has none of anything."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - without(_BLANKS), without(_SYMBOLS), len(lines) - len(set(lines)), _repeated(words)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in COUNTS]))
def count_rules(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts(x) for x in text], columns=list(COUNTS), dtype="int64")


def features(rows: pd.DataFrame) -> np.ndarray:
    """Statistics of the rules that do not grow with the length of a text. Few and telling ones: a split is drawn among all."""
    c = {x: rows[x].to_numpy("float64") for x in COUNTS}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        c["word_chars"] / words, np.sqrt(c["n_symbols"] / chars), np.log1p(c["n_symbols"] / words), c["n_repeat_words"] / words,
    ])


@dataclass
class Forest:
    """Trees as arrays: a node splits on `feature` at `cut`; a leaf has feature -1 and its path length in `cut`."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    usual: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / usual path length): near 1 for rows that random splits cut off early."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, child in self.trees:
            node = np.zeros(len(x), "int64")
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = child[at] + (x[rows[inner], feature[at]] >= cut[at])
            total += cut[node]
        return np.exp2(-total / max(len(self.trees), 1) / self.usual) if self.trees else np.zeros(len(x))


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """An isolation forest; no rows give a forest without trees, which scores every row 0."""
    random, out = np.random.default_rng(seed), []
    size = min(sample, len(x))
    limit = math.ceil(math.log2(max(size, 2)))
    for _ in range(trees if size > 1 else 0):
        feature, cut, child = [0], [0.0], [0]
        todo = [(0, x[random.choice(len(x), size, replace=False)], 0)]
        while todo:
            node, rows, depth = todo.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if depth >= limit or not len(spread):
                feature[node], cut[node] = -1, depth + _mean_path(len(rows))
                continue
            f = random.choice(spread)
            value = random.uniform(rows[:, f].min(), rows[:, f].max())
            right = rows[:, f] >= value
            feature[node], cut[node], child[node] = f, value, len(feature)
            for k, part in enumerate((rows[~right], rows[right])):
                todo.append((len(feature), part, depth + 1))
                feature.append(0), cut.append(0.0), child.append(0)
        out.append((np.array(feature), np.array(cut), np.array(child)))
    return Forest(out, _mean_path(size) or 1.0)


def threshold(good: np.ndarray, bad: np.ndarray, kept_share: float = KEPT_SHARE) -> int:
    """The score bin from which a document is rejected, from counts of labelled documents by bin.

    Among the bins that keep `kept_share` of the good documents, the one with the largest difference between the rejected
    shares of bad and of good documents; beyond the last bin, so that all are kept, if rejecting gains nothing.
    """
    above = lambda n: np.r_[n[::-1].cumsum()[::-1], 0] / max(n.sum(), 1)
    lost, caught = above(good), above(bad)
    gain = np.where(lost <= 1 - kept_share, caught - lost, -1)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return best if gain[best] > 0 else len(good)


def judged(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, trees: int = TREES, sample: int = SAMPLE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """The rows of `docs` (or these `columns` of them) with COUNTS, base_failed, anomaly and kept.

    base_failed: fewer than 50 words, or more than half of the words inside repeated three-word windows. The forest is
    grown on `trees` x `sample` labelled documents, those with the smallest digests of their id: a bounded sample,
    51 200 by default. Scores cover all documents, and the threshold is set from all labelled ones
    that pass the base rules, counted by score bin. kept is false if base_failed or the score reaches the threshold.

    A null text counts as empty and fails; a document without a label is judged like any other; labels that are null
    or without a document are left aside; with no labels only the base rules reject. Repeated rows are each judged.
    Added columns replace input columns of the same name; no rows give no rows.
    """
    added = {*COUNTS, "base_failed", "anomaly", "kept", "_rules"}
    kept = [c for c in (columns or docs.columns) if c not in added]
    rows = docs.select(*kept, count_rules("text").alias("_rules"))
    failed = (F.col("_rules.n_words") < LEAST_WORDS) | (100 * F.col("_rules.n_repeat_words") > REPEATED_PERCENT * F.col("_rules.n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "rules")
    labelled = labels.select(F.col("doc_id").alias("_id"), "quality").where("quality in (0, 1)").distinct()
    passing = rows.where("not base_failed").select("doc_id", "_rules.*").join(labelled, F.col("doc_id") == F.col("_id"))
    drawn = passing.orderBy(F.md5(F.col("doc_id").cast("string")), *COUNTS).limit(trees * sample)
    grown = grow(features(drawn.select(*COUNTS).toPandas()), trees, sample)
    forest = rows.sparkSession.sparkContext.broadcast(grown)

    @F.pandas_udf("double")
    def anomaly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(forest.value.scores(features(batch)))

    bin_of = F.floor(anomaly(F.struct(*COUNTS)) * BINS).cast("int")
    tally = np.zeros((2, BINS + 1), "int64")
    for r in passing.select("quality", bin_of.alias("bin")).groupBy("quality", "bin").count().collect():  # 2 x BINS rows at most
        tally[r["quality"], r["bin"]] += r["count"]
    limit = threshold(tally[1], tally[0], kept_share) / BINS
    scored = rows.select(*kept, "_rules.*", "base_failed").withColumn("anomaly", anomaly(F.struct(*COUNTS)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) < F.round(F.lit(limit * BINS))))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    marked = docs.select(*[F.col(c).alias(f"_doc_{c}") for c in docs.columns], "doc_id", "text")
    own = [f"_doc_{c}" for c in docs.columns] + ["doc_id"]
    found = judged(marked, labels, columns=own, **options).where("kept")
    return found.select(*[F.col(f"_doc_{c}").alias(c) for c in docs.columns])


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = judged(documents(spark, folder).select("doc_id", "text"), labels, columns=["doc_id"])
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly")
