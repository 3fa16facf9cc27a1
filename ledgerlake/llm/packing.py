"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents, parts, running_sum, stored
from ledgerlake.llm.tokens import encoder

LENGTH = 2048
END = 0  # the id behind every document

Slot = tuple[int, int, int, int, int]  # length, first rank, documents per sequence, first sequence, offset


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of each document, whole texts only.

    A document of more than `length` tokens is cut into pieces of `length`, of which the first is what remains. A null
    text counts as empty and has the end token only.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    end = np.asarray([END], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(*vocabulary).ids
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % length or length, n, length)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    part = ids[4 * a : 4 * b]
                    row = (doc, k, a, b - a, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, dtype="<u4").astype("i4")) if with_ids else row)
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    # An id column with nulls would reach pandas as floating point.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    text_ids = rows.mapInPandas(cut, schema.replace("doc_id long", "doc_id string"))
    return text_ids.withColumn("doc_id", F.col("doc_id").cast("long"))


def _tighter_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], room: int, above: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (above, room]."""
    free = [x for x in lengths if left[x] > used.get(x, 0)]
    best, found = above, None
    low, high = 0, len(free) - 1
    while low <= high:
        a, b = free[low], free[high]
        if a + b > room or (low == high and left[a] - used.get(a, 0) < 2):
            high -= 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
        low += 1
    return found


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """(lengths in a sequence with their number, how many such sequences) for documents counted by length.

    Best-two-fit: a sequence is filled greedily with the longest document that fits; then its shortest document gives
    way to two unpacked ones that fill the widened gap more tightly, as long as that improves it. As equal lengths are
    alike, a filled sequence is repeated as often as the counts allow, so the work depends on the number of different
    lengths (at most `length`) and not on the number of documents.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    lengths, out = sorted(left), []
    while lengths:
        used, room = {}, length
        while room and (i := bisect_right(lengths, room)):
            size = next((x for x in reversed(lengths[:i]) if left[x] > used.get(x, 0)), None)
            if size is None:
                break
            n = min(room // size, left[size] - used.get(size, 0))
            used[size] = used.get(size, 0) + n
            room -= n * size
        while room:
            least = min(used)
            pair = _tighter_pair(lengths, left, used, room + least, least)
            if pair is None:
                break
            used[least] -= 1
            if not used[least]:
                del used[least]
            for size in pair:
                used[size] = used.get(size, 0) + 1
            room += least - sum(pair)
        times = min(left[size] // n for size, n in used.items())
        out.append((used, times))
        for size, n in used.items():
            left[size] -= n * times
        lengths = [x for x in lengths if left[x]]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length its rows (first rank, documents per sequence, first sequence, offset), by rank."""
    found, taken, sequence = {}, {}, 0
    for used, times in patterns:
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            found.setdefault(size, []).append((taken.get(size, 0), n, sequence, offset))
            taken[size] = taken.get(size, 0) + n * times
            offset += n * size
        sequence += times
    return {size: np.asarray(rows, dtype="int64") for size, rows in found.items()}


def pack(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, length: int = LENGTH, with_ids: bool = False, digits: int = 3) -> DataFrame:
    """The pieces of `docs` with sequence_id and offset, in as few sequences as best-two-fit needs.

    The driver sees one count per length, at most `length` of them for any corpus; documents find their place by their
    rank among those of equal length, numbered in groups by running_sum, so the commonest length is spread too.
    Null texts are empty documents, repeated rows are packed as often as they occur, a null doc_id stays null, no rows
    give no rows, and further columns of `docs` are left out.
    """
    cut = stored(pieces(docs, vocabulary, length, with_ids).withColumn(
        "_order", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece"))), "pieces")
    one = cut.withColumn("_one", F.lit(1).cast("long"))
    groups = stored(parts(one, "length", "_order", "_one", digits), "piece-parts")
    counted = groups.groupBy("length").agg(F.sum("_sum").alias("n")).collect()  # one row per length
    places = cut.sparkSession.sparkContext.broadcast(slots(plan({r["length"]: r["n"] for r in counted}, length)))
    ranked = running_sum(one, groups, "length", "_order", "_one", "_rank", digits).drop("_one", "_order")

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(size), "int64"), np.zeros(len(size), "int64")
        for value, at in size.groupby(size).indices.items():
            rows, r = places.value[value], rank.to_numpy()[at]
            first, n, base, place = rows[np.searchsorted(rows[:, 0], r, "right") - 1].T
            sequence[at], offset[at] = base + (r - first) // n, place + (r - first) % n * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_place", place("length", "_rank")).select(*[c for c in cut.columns if c != "_order"], "_place.*")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))
