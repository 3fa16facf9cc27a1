"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents

KINDS = ("assign", "access", "hex", "markov")
LEAST_TOKEN = 16  # characters of a token that the models judge
MARGIN = 100.0  # times that a token has to be likelier random than ordinary, beyond how rare secrets are

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(_ALPHABET) + 1  # 0 stands for every other byte
_CODE = np.zeros(256, "int64")
_CODE[np.frombuffer(_ALPHABET, "u1")] = np.arange(1, _SIZE)
_IS_HEX = bytes(0x31 if chr(b) in "0123456789abcdef" else 0x30 for b in range(256))

Span = tuple[int, int, int]  # start, index of the kind, end


def base_spans(text: str, raw: bytes) -> list[Span]:
    """Matches of the fixed patterns, by start. A cheap look at the bytes decides whether a pattern has to be run."""
    found, lower = [], raw.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"1" * 16 in raw.translate(_IS_HEX):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def _pairs(raw: bytes) -> np.ndarray:
    code = _CODE[np.frombuffer(raw, "u1")]
    return np.bincount(code[:-1] * _SIZE + code[1:], minlength=_SIZE * _SIZE) if len(code) > 1 else np.zeros(_SIZE * _SIZE, "int64")


def _value(text: str, span: Span) -> bytes:
    """The secret of a base match: what follows the name and the sign in an assignment, else the whole match."""
    found = text[span[0] : span[2]]
    return (_ASSIGN.match(found)[2] if span[1] == 0 else found).encode()


@dataclass
class Models:
    """Log-likelihood ratio of each character pair, and the ratio from which a token counts as a secret."""

    ratio: np.ndarray
    limit: float

    def score(self, token: bytes) -> float:
        code = _CODE[np.frombuffer(token, "u1")]
        return float(self.ratio[code[:-1], code[1:]].sum())


def train(docs: DataFrame, margin: float = MARGIN) -> Models:
    """Transition counts over all documents, labelled by the base patterns: values of matches are samples of random
    strings, all other text holds the ordinary identifiers.

    A task counts its own rows, and 2 x 67 x 67 sums reach the driver for any corpus. Each pair gets one more count in
    both models, so that a character neither has seen speaks for neither.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, tokens = np.zeros((2, _SIZE * _SIZE), "int64"), [0, 0]
        for batch in batches:
            for text in batch["text"]:
                if text:
                    raw = text.encode()
                    values = [_value(text, s) for s in base_spans(text, raw)]
                    both[0] += _pairs(raw)
                    tokens[0] += raw.count(b" ") + raw.count(b"\n") + 1
                    for v in values:
                        n = _pairs(v)
                        both[0] -= n
                        both[1] += n
                    tokens[1] += len(values)
        kind, cell = np.nonzero(both)
        yield pd.DataFrame({"kind": [*kind, 0, 1], "cell": [*cell, -1, -1], "n": [*both[kind, cell], *tokens]})

    sums = docs.select("text").mapInPandas(counted, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    counts, tokens = np.zeros((2, _SIZE * _SIZE)), [1.0, 1.0]
    for r in sums.collect():
        if r["cell"] < 0:
            tokens[r["kind"]] += r["n"]
        else:
            counts[r["kind"], r["cell"]] += max(r["n"], 0)
    ordinary, random = (counts.reshape(2, _SIZE, _SIZE)[:, 1:, 1:] + 1.0)
    chance = lambda n: np.log(n / n.sum(axis=1, keepdims=True))
    ratio = np.zeros((_SIZE, _SIZE))
    ratio[1:, 1:] = chance(random) - chance(ordinary)
    return Models(ratio, float(np.log(tokens[0] / tokens[1]) + np.log(margin)))


def added_spans(text: str, base: list[Span], models: Models) -> list[Span]:
    """Tokens that the models take for random strings and no base span touches."""
    found, i = [], 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if b - a < LEAST_TOKEN:
            continue
        while i < len(base) and base[i][0] < a and base[i][2] <= a:
            i += 1
        if any(s < b and e > a for s, _, e in base[i:]):
            continue
        if models.score(m[0].encode()) >= models.limit:
            found.append((a, 3, b))
    return found


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """The rows of `docs` with n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_markov.

    Positions count code points and ends are exclusive; order is by start, then kind. A null text counts as empty, so
    its spans are the empty text; repeated rows are each scanned; added columns replace input columns of the same
    name; no rows give no rows. Two passes over the texts, no shuffle of rows.
    """
    models = models or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                text = text or ""
                base = base_spans(text, text.encode())
                more = added_spans(text, base, shared.value)
                n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                out.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted(base + more)), len(more)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]
    kept = [c for c in docs.columns if c not in (*names, "_scan")]
    return docs.select(*kept, scanned("text").alias("_scan")).select(*kept, "_scan.*")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan(documents(spark, folder).select("doc_id", "text")).drop("text")
