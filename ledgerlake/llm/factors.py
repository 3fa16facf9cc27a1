"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents, stored

SAMPLE = 4_096  # labelled rows that the machine is fitted on, at most
WORDS = 4_096  # buckets of hashed words
CUTS = 15  # cut points of a statistic, at most; it becomes one of CUTS + 2 features
RANK = 8  # length of the factor vectors
FOLDS = 5  # documents of fold 0 are held out
THRESHOLD = 0.3
DECAY, STEPS = 2e-4, 60

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _SYMBOLS, _ENDS, _MARKS = b"0123456789", b"#*$%&|<>", b".!?", b"!?,;:"
_HIGH = bytes(range(128, 256))
STATISTICS = (
    "words", "bytes per word", "words equal to the one before", "distinct words", "commonest word", "symbols", "capitals",
    "digits", "sentence ends", "marks", "bytes beyond ASCII", "words per line", "repeated lines", "longest word",
)


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The values of STATISTICS, as ratios and logarithms; all 0 without a word."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda what: (len(raw) - len(raw.translate(None, what))) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = share(_UPPER) + share(_LOWER)
    return [
        math.log2(n), sum(map(len, words)) / n, sum(map(bytes.__eq__, words[1:], words)) / n, len(counts) / n,
        max(counts.values()) / n, share(_SYMBOLS), share(_UPPER) / letters if letters else 0.0, share(_DIGITS),
        share(_ENDS) * len(raw) / n, share(_MARKS) * len(raw) / n, share(_HIGH), math.log2(n / len(lines)),
        1 - len(set(lines)) / len(lines), math.log2(max(map(len, words))),
    ]


def read(text: str | None, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values (root of the count, scaled to unit length), and the statistics with the metadata behind them.

    A missing metadatum is NaN. The whole text is read; memory follows its length.
    """
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # cuts at the six blanks of [^\x20\x09-\x0D]+
    counts = Counter(words)
    folded: Counter = Counter()
    for word, count in counts.items():
        folded[zlib.crc32(word.lower()) % WORDS] += count
    buckets = np.fromiter(sorted(folded), "int64", len(folded))
    values = np.sqrt(np.fromiter((folded[b] for b in buckets.tolist()), "float64", len(buckets)))
    more = [math.nan if m is None or m != m else math.copysign(math.log2(1 + abs(m)), m) for m in metadata]
    return buckets, values / (np.sqrt(values @ values) or 1), statistics(raw, words, counts) + more


@dataclass
class Machine:
    """w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, as a probability.

    The pairs are summed in time linear in the features of a text: half of (sum v_i x_i)**2 - sum (v_i x_i)**2, per factor.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    cuts: list[np.ndarray]

    def features(self, buckets: np.ndarray, values: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Word features, then for each statistic the one of its range (the last one of its CUTS + 2 if it is missing)."""
        at = [CUTS + 1 if s != s else int(np.searchsorted(c, s, "right")) for c, s in zip(self.cuts, stats)]
        own = WORDS + np.arange(len(at)) * (CUTS + 2) + np.asarray(at, "int64")
        return np.concatenate([buckets, own]), np.concatenate([values, np.ones(len(at))])

    def score(self, text: str | None, metadata: Sequence[float | None] = ()) -> float:
        index, x = self.features(*read(text, metadata))
        v = self.factors[index] * x[:, None]
        pairs = 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[index] @ x + pairs, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], label: np.ndarray, share: float, rank: int = RANK, decay: float = DECAY, steps: int = STEPS) -> Machine:
    """The machine with the least log loss and squared weights over `rows` (as read() gives them), by full gradient steps.

    share: the share of label 1 among all labelled rows, whatever it is among these. Factors start from fixed random numbers,
    so the same rows in the same order give the same machine. Labels of one kind give that kind's certainty, no rows a half.
    """
    fields = len(rows[0][2]) if rows else 0
    size = WORDS + fields * (CUTS + 2)
    stats = np.array([r[2] for r in rows]).reshape(len(rows), fields)
    spread = np.linspace(0, 1, CUTS + 2)[1:-1]
    cuts = [np.unique(np.quantile(c[np.isfinite(c)], spread)) if np.isfinite(c).any() else np.zeros(0) for c in stats.T]
    machine = Machine(0.0, np.zeros(size), np.zeros((size, rank)), cuts)
    if not len(rows) or label.min() == label.max():
        machine.bias = 0.0 if not len(rows) else math.log(99) * (1 if label.max() else -1)
        return machine
    found = [machine.features(*r) for r in rows]
    length = np.array([len(i) for i, _ in found])
    begin = np.r_[0, np.cumsum(length)[:-1]]
    col, x = np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]).astype("float32")[:, None]
    row = np.repeat(np.arange(len(found)), length)
    by_col = np.argsort(col, kind="stable")
    present, first = np.unique(col[by_col], return_index=True)
    weight = np.where(label == 1, share / (label == 1).sum(), (1 - share) / (label == 0).sum())
    theta = np.zeros((len(present), 1 + rank), "float32")  # weight and factors of each feature that occurs
    theta[:, 1:] = np.random.default_rng(0).normal(0, 0.05, (len(present), rank))
    place = np.searchsorted(present, col)
    bias, m, v, mb, vb = math.log(max(share, 1e-3) / max(1 - share, 1e-3)), np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for step in range(1, steps + 1):
        part = theta[place] * x
        total = np.add.reduceat(part, begin)
        pairs = 0.5 * (total[:, 1:] ** 2 - np.add.reduceat(part[:, 1:] ** 2, begin)).sum(axis=1)
        g = (weight * (1 / (1 + np.exp(-np.clip(bias + total[:, 0] + pairs, -30, 30))) - label)).astype("float32")
        part[:, 0] = 1
        part[:, 1:] = total[row, 1:] - part[:, 1:]
        part *= g[row, None] * x
        grad = np.add.reduceat(part[by_col], first) + 2 * decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    machine.bias, machine.weights[present], machine.factors[present] = bias, theta[:, 0], theta[:, 1:]
    return machine


def _fold(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def drawn(labels: DataFrame, label: str, sample: int) -> tuple[DataFrame, float]:
    """(doc_id, label) of at most `sample` rows outside fold 0, half of either label if there are so many; and the share of label 1.

    Rows are cut by a digest of their id at a height that follows from a count first, so what meets behind the cut is `sample`
    rows however many partitions there are. Of several labels of one document the largest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(_fold("doc_id") != 0)
    known = stored(known.groupBy("doc_id").agg(F.max(label).cast("int").alias(label)), "labels")
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    most, steps = sample // 2, 1 << 30
    height = F.pmod(F.xxhash64("doc_id"), F.lit(steps))
    parts = []
    for value in (0, 1):
        n = counts.get(value, 0)
        cut = steps if n <= most else int(steps * max(0.0, most - 4 * math.sqrt(most)) / n)
        parts.append(known.where((F.col(label) == value) & (height < cut)).limit(most))
    return stored(parts[0].union(parts[1]), "sample"), counts.get(1, 0) / max(sum(counts.values()), 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: Sequence[str] = (), sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` labelled rows outside fold 0; one text for each of them, the smallest of its doc_id's.

    The ids of the sample, at most `sample`, are broadcast to find its texts; executors turn these into features.
    """
    ids, share = drawn(labels, label, sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array(*(F.col(c).cast("double") for c in metadata)).alias("meta"))
    texts = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", label).agg(F.min(F.struct("text", "meta")).alias("d"))

    @F.pandas_udf("struct<buckets: array<long>, parts: array<double>, stats: array<double>>")
    def seen(texts: pd.Series, meta: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t, m) for t, m in zip(texts, meta)], columns=["buckets", "parts", "stats"])

    small = texts.select("doc_id", label, seen("d.text", "d.meta").alias("f")).select("doc_id", label, "f.*").toPandas().sort_values("doc_id")
    rows = [(np.asarray(b, "int64"), np.asarray(p, "float64"), [math.nan if x is None else float(x) for x in s]) for b, p, s in zip(small["buckets"], small["parts"], small["stats"])]
    return fit(rows, small[label].to_numpy("float64"), share)


def scored(docs: DataFrame, machine: Machine, metadata: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with held_out, score and predicted; no shuffle.

    A score follows from text and metadata alone. A null text counts as empty and has all statistics 0; a null metadatum has a
    feature of its own; a null doc_id is no training row and lies in the fold of the empty text; repeated rows are each scored; very long
    texts are read whole; added columns replace those of the same name; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = shared.value
        for texts, meta in batches:
            yield pd.Series([own.score(t, m) for t, m in zip(texts, meta)], dtype="float64")

    kept = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    meta = F.array(*(F.col(c).cast("double") for c in metadata))
    found = docs.select(*kept, (_fold("doc_id") == 0).alias("held_out"), score("text", meta).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata is n_chars, the table's count of characters; lang, source and doc_id are no inputs."""
    docs = documents(spark, folder).select("doc_id", "text", "n_chars")
    machine = train(docs, spark.read.parquet(f"{folder}/labels.parquet"), metadata=["n_chars"])
    return scored(docs, machine, metadata=["n_chars"]).drop("text", "n_chars")
