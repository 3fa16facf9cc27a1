"""SimHash near-duplicates: links by a hierarchical index in Gray order, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import documents, stored
from ledgerlake.llm.graph import components

DISTANCE = 3
CELL = 1024  # fingerprints that one index takes; a larger cell is divided, none is left out
FANOUT = 8
_FRONTIER = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit i is set if more than half of the shingles' hashes have it; 0 for a text without a word."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII blanks cut
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1)
    starts, stops = (ends - np.fromiter(map(len, words), "int64", len(words)) - 1).tolist(), (ends[k - 1 :] - 1).tolist()
    votes, n = np.zeros(64, "int64"), len(stops)
    for at in range(0, n, 1 << 15):  # a very long text is counted in blocks
        part = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x or "") for x in text], dtype="int64")


def _gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def cells(codes: DataFrame, most: int = CELL) -> DataFrame:
    """(cell, i, j, rank, code): any two codes at most 3 bits apart share a cell, and a cell has about `most` codes or fewer.

    A code is turned so that each of its four 16-bit blocks leads once; one block of a close pair is equal (pigeonhole).
    Cells with more codes than `most` are divided by the four 12-bit blocks of the rest in the same way, and what is still
    larger by a grid: its codes go to k parts by digest, and every pair of parts is a cell. Of the first kind there are
    4 * 65536 cells for any input, so the list of the large ones (2 MB at most) is broadcast; the second list is joined.
    """
    turned = codes.select("code", F.posexplode(F.array(*[
        F.col("code") if t == 0 else F.shiftleft("code", 16 * t).bitwiseOR(F.shiftrightunsigned("code", 64 - 16 * t)) for t in range(4)
    ])).alias("turn", "word"))
    first = turned.select("code", "word", (F.col("turn") * 65536 + F.shiftrightunsigned("word", 48)).alias("cell"))
    large = F.broadcast(first.groupBy("cell").count().where(F.col("count") > most).select("cell"))
    second = first.join(large, "cell", "left_semi").select("code", "word", "cell", F.explode(F.array(*map(F.lit, range(4)))).alias("turn"))
    second = second.select("code", "word", (
        F.col("cell") * 16384 + F.col("turn") * 4096 + F.expr("shiftrightunsigned(word, 12 * turn) & 4095") + F.lit(1 << 40)
    ).alias("cell"))
    sized = second.join(second.groupBy("cell").count(), "cell")
    k = F.ceil(F.col("count") / most).cast("int")
    grid = sized.where(F.col("count") > most).withColumn("k", k).withColumn("s", F.pmod(F.xxhash64("code"), k).cast("int"))
    grid = grid.select("code", "word", "cell", "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    whole = [F.lit(-1).alias("i"), F.lit(-1).alias("j")]
    parts = (
        first.join(large, "cell", "left_anti").select("code", "word", "cell", *whole)
        .union(sized.where(F.col("count") <= most).select("code", "word", "cell", *whole))
        .union(grid.select("code", "word", "cell", F.least("s", "other").alias("i"), F.greatest("s", "other").alias("j")))
    )
    return parts.select("cell", "i", "j", _gray_rank(F.col("word")).alias("rank"), "code")


class _Index:
    """Hierarchy over codes in Gray order: a node stands for FANOUT nodes below it and knows the bits they share."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.levels = [(codes, np.full(len(codes), _ALL), None)]
        low = high = codes
        while len(np.unique(group)) < len(group):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            inside = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            starts = np.flatnonzero(inside % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, ~(low ^ high), np.r_[starts, len(group)]))
            group = group[starts]
        self.roots = len(group)

    def close(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions whose codes differ in `distance` bits or fewer.

        Pairs of nodes are followed from the roots down. A pair carries the differences among the bits that both nodes
        know and those bits; one level down only newly known bits are compared, and beyond `distance` the pair falls.
        """
        root = np.arange(self.roots)
        stack = [(len(self.levels) - 1, root, root, np.zeros(self.roots, "int64"), np.zeros(self.roots, "uint64"))]
        while stack:
            level, a, b, differ, known = stack.pop()
            if len(a) > _FRONTIER:
                half = len(a) // 2
                stack += [(level, a[s], b[s], differ[s], known[s]) for s in (slice(half), slice(half, None))]
                continue
            pattern, mask, starts = self.levels[level]
            both = mask[a] & mask[b]
            differ = differ + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~known)
            near = np.flatnonzero(differ <= distance)
            a, b, differ, known = a[near], b[near], differ[near], both[near]
            if level == 0:
                apart = a != b
                yield a[apart], b[apart]
            elif len(a):
                # Children of node x are starts[x] .. starts[x + 1] - 1; a pair gives the product, a node with itself the upper half.
                na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
                step = max(1, _FRONTIER // FANOUT**2 * 8)
                for at in range(0, len(a), step):
                    s = slice(at, at + step)
                    n = na[s] * nb[s]
                    pair = np.repeat(np.arange(len(n)) + at, n)
                    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                    x, y = starts[a[pair]] + k // nb[pair], starts[b[pair]] + k % nb[pair]
                    ok = x <= y
                    stack.append((level - 1, x[ok], y[ok], differ[pair[ok]], known[pair[ok]]))


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each class after joining a with b."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def _links(group: np.ndarray, codes: np.ndarray, distance: int) -> pd.DataFrame:
    """One link from each code to the first of its class inside its cell: as many rows as codes at most."""
    parent = np.arange(len(codes))
    for a, b in _Index(group, codes.view("uint64")).close(distance):
        parent = _joined(parent, a, b)
    found = np.flatnonzero(parent != np.arange(len(codes)))
    x, y = codes[found], codes[parent[found]]
    return pd.DataFrame({"high": np.maximum(x, y), "low": np.minimum(x, y)})


def links(codes: DataFrame, distance: int = DISTANCE, most: int = CELL) -> DataFrame:
    """(high, low) pairs of different codes that connect exactly what links of `distance` bits or fewer (3 at most) connect."""
    if distance > 3:
        raise ValueError("four blocks find pairs of 3 bits or fewer")

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = rows[["cell", "i", "j"]].to_numpy()
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            last = np.flatnonzero(new)[-1] if len(rows) else 0  # the last cell may go on in the next batch
            if last:
                yield _links(np.cumsum(new[:last]), rows["code"].to_numpy()[:last], distance)
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield _links(np.cumsum(np.r_[True, (held[["cell", "i", "j"]].to_numpy()[1:] != held[["cell", "i", "j"]].to_numpy()[:-1]).any(axis=1)]), held["code"].to_numpy(), distance)

    dealt = cells(codes, most).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rank")
    return dealt.select("cell", "i", "j", "code").mapInPandas(indexed, "high long, low long")


def near_copies(docs: DataFrame, columns: list[str] | None = None, distance: int = DISTANCE, most: int = CELL) -> DataFrame:
    """The rows of `docs` (or these `columns` of them) with code (the fingerprint), component (its smallest code) and component_id.

    Method: SimHash of the whole text's word shingles; equal fingerprints are one entry; entries are dealt to cells, each
    cell sorted by Gray rank and indexed, and the index joined with itself; the links are closed by graph.components.
    Only fingerprints are shuffled for that, each task holds whole cells of bounded size, and a cell gives one link for
    a member at most, never all pairs of a group.

    A null text counts as empty, and texts without a word have fingerprint 0. component_id is the smallest doc_id of
    the component, null if it has none. Repeated rows stay, in one component. Added columns replace input columns of
    the same name; no rows give no rows.
    """
    kept = [c for c in (columns or docs.columns) if c not in ("code", "component", "component_id")]
    marked = stored(docs.select(*kept, fingerprints("text").alias("code")), "fingerprints")
    codes = stored(marked.groupBy("code").agg(F.min("doc_id").alias("_id")), "codes")
    linked = components(links(codes.select("code"), distance, most)).withColumnRenamed("node", "code")
    least = linked.join(codes, "code").groupBy("component").agg(F.min("_id").alias("component_id"))
    classes = codes.join(linked.join(least, "component"), "code", "left").select(
        "code", F.coalesce("component", "code").alias("component"),
        F.when(F.col("component").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
    return marked.join(classes, "code")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: the one with its smallest doc_id (of components without an id, any one)."""
    rows = near_copies(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.dropDuplicates(["component"]).select(*docs.columns)


def op7_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies(documents(spark, folder).select("doc_id", "text"), columns=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
