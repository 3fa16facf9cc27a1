"""Operators over groups of documents, lines or vectors: against brute force, and on odd rows."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import linededup, mixing, nearcopies, quality, sharding, topk
from ledgerlake.llm.common import stored
from ledgerlake.llm.graph import components


class Classes(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def close_classes(codes, distance=3):
    found, array = Classes(), np.array(codes, dtype="int64").view("uint64")
    for i, code in enumerate(array):
        for j in np.flatnonzero(np.bitwise_count(code ^ array) <= distance):
            found.join(codes[i], codes[int(j)])
    return found


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def simhash(words):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    code = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return code - (1 << 64) if code >> 63 else code


def test_components(spark):
    random = np.random.default_rng(0)
    pairs = [(int(max(a, b)), int(min(a, b))) for a, b in random.integers(0, 300, (220, 2)) if a != b] + [(i, i - 1) for i in range(401, 440)] + [(i, 1000) for i in range(1001, 1100)]
    want = Classes()
    for a, b in pairs:
        want.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "high long, low long")).collect()}
    assert got == {x: want.find(x) for p in pairs for x in p}
    assert components(spark.createDataFrame([], "high long, low long")).count() == 0


# -- near copies


def test_near_copies_against_brute_force(spark, folder):
    rows = nearcopies.op7_near_copies(spark, folder).collect()
    text = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    code = {}
    for r in rows:
        words = text[r["doc_id"]].encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]).decode() for i in range(max(1, len(words) - 2))] if words else []
        code[r["doc_id"]] = simhash(shingles) if shingles else 0
        assert int(r["fingerprint"], 16) == code[r["doc_id"]] % (1 << 64)
    want = close_classes(sorted(set(code.values())))
    least = {}
    for doc, c in code.items():
        least[want.find(c)] = min(doc, least.get(want.find(c), doc))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {doc: least[want.find(c)] for doc, c in code.items()}


@pytest.mark.parametrize("most", [1024, 3])
def test_links_in_divided_cells(spark, most):
    random = np.random.default_rng(5)
    codes = set()
    for base in random.integers(-(2**63), 2**63 - 1, 12):
        for _ in range(40):
            flips = sum(1 << int(b) for b in set(random.integers(0, 64, random.integers(0, 5))))
            codes.add(int(np.uint64(int(base) % (1 << 64) ^ flips).view("int64")))
    codes = sorted(codes)
    want = close_classes(codes)
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    got = {r["node"]: r["component"] for r in components(nearcopies.links(frame, 3, most)).collect()}
    assert all(got.get(c, c) == want.find(c) for c in codes)


def test_near_copies_odd_rows(odd, clashing, nothing):
    rows = nearcopies.near_copies(clashing).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if not (r["text"] or "").strip()} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    one = nearcopies.one_of_each(clashing)
    assert one.columns == clashing.columns
    assert Counter(r["doc_id"] for r in one.collect()) == Counter([1, 2, 3, None, 7, 9]) or Counter(r["doc_id"] for r in one.collect()) == Counter([1, 3, None, 7, 9])
    assert nearcopies.near_copies(nothing).count() == 0


# -- lines


def near_pairs(rows):
    """All pairs of different normalised lines that need no more edits than a fifth of the longer one: (line, other)."""
    texts = stored(rows.select("line", "norm").distinct(), "texts")
    longer = F.greatest(F.length("norm"), F.length("text"))
    pairs = texts.join(texts.toDF("other", "text"), (F.col("line") > F.col("other")) & (F.abs(F.length("norm") - F.length("text")) <= 0.2 * longer + 1e-9))
    pairs = pairs.repartition(16).withColumn("most", F.floor(0.2 * longer + 1e-9).cast("int"))
    return pairs.where("levenshtein(norm, text, most) >= 0").select("line", "other").collect()


def test_line_dedup_against_brute_force(spark, folder):
    near = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    extra = [(10_000 + i, f"{near.replace('wordc', 'other' + chr(97 + i) + 'c', 1)}\nA line of its own {chr(97 + i)}\n---\n---\nshared LINE, here!\nshared line 7 here") for i in range(6)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    frame = stored(linededup.lines(docs), "lines")
    rows, groups, first = frame.collect(), Classes(), {}
    for r in near_pairs(frame):
        groups.join(r["line"], r["other"])
    assert any(groups.find(a) != a for a in list(groups))
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["row"], r["pos"])):
        first.setdefault(groups.find(r["line"]), (r["doc_id"], r["pos"]))
    gone = defaultdict(set)
    for r in rows:
        if first[groups.find(r["line"])] != (r["doc_id"], r["pos"]):
            gone[r["doc_id"]].add(r["pos"])
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    for doc, text in docs.collect():
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone[doc]]
        assert got[doc]["text"] == "\n".join(kept)
        assert (got[doc]["n_lines"], got[doc]["n_removed"]) == (text.count("\n") + 1, len(gone[doc]))


def test_codes_of_short_and_long_lines(spark):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    sizes = (1, 2, 3, 62, 63, 64, 65, 1000, 16_383, 16_384, 40_000)  # on both sides of where counts get wider
    texts = [" ".join(letters(i * 7 + n) for i in range(n)) for n in sizes] + ["x" * 50_000, " ".join(["same"] * 200), " ".join(["same"] * 20_000)]
    rows = linededup.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts) and all(r["code"] == simhash(r["norm"].split(" ")) for r in rows)


def test_common_ends_change_no_edits(spark):
    random = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        a = "".join(random.choice(list("abé\u4e2d"), random.integers(0, 40)))
        b = list(a)
        for _ in range(random.integers(0, 4)):
            b.insert(random.integers(0, len(b) + 1), str(random.choice(list("xyü"))))
        rows.append((a, "".join(b[: random.integers(0, len(b) + 1)] if random.random() < 0.3 else b)))
    cut = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup._unlike(F.col("a"), F.col("b")).alias("u"))
    assert cut.where("levenshtein(a, b) <> levenshtein(u.a, u.b)").count() == 0
    assert cut.where("u.a <> '' and u.b <> '' and (left(u.a, 1) = left(u.b, 1) or right(u.a, 1) = right(u.b, 1))").count() == 0


def test_lines_of_figures_repeat(spark):
    docs = spark.createDataFrame([(1, "12.5 | 2020 | -7\n---"), (2, "12.5 | 2020 | -7\n---"), (3, "3.25 | 1999 | -81")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == {1: "12.5 | 2020 | -7\n---", 2: "---", 3: ""}


def test_figures_and_typos_are_near(spark):
    ten = "several people walked slowly through another narrow street towards evening"
    same = [
        ("12.5 | 2020 | -7", "12.5 | 2020 | -7"), ("Total revennue", "Total revenue"), ("note 7", "note 31"),
        (ten, ten.replace("people", "peaple").replace("narrow", "narow").replace("towards", "tovards")),
        ("the board met on monday to approve the annual accounts", "the board met on friday to approve the annual accounts"),
    ]
    other = [("ordinary shares", "preference shares"), ("red green blue", "one two three four")]
    docs = spark.createDataFrame([(2 * i + k, line) for i, pair in enumerate(same + other) for k, line in enumerate(pair)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert [got[2 * i + 1] == "" for i in range(len(same + other))] == [True] * len(same) + [False] * len(other)
    assert all(got[2 * i] == a for i, (a, _) in enumerate(same + other))


def test_recall_of_near_lines(spark):
    """Against all pairs by edit similarity alone, with lines that had one word or a twentieth of their characters changed."""
    random = np.random.default_rng(11)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    norm = sorted({r["norm"] for r in linededup.lines(docs).collect() if 8 <= len(r["norm"]) <= 400})
    lines = [norm[i] for i in random.choice(len(norm), 700, replace=False)]
    for line in lines[:200]:
        words, signs = line.split(" "), list(line)
        words[random.integers(len(words))] = "exchanged"
        for at in random.choice(len(signs), max(1, len(signs) // 20), replace=False):
            signs[at] = chr(97 + random.integers(26))
        lines += [" ".join(words), "".join(signs)]
    rows = linededup.lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    near = near_pairs(rows)
    classes = {r["node"]: r["component"] for r in linededup.line_classes(rows).collect()}
    found = sum(a in classes and classes[a] == classes.get(b) for a, b in near)
    print("recall of near lines", found, len(near))
    assert len(near) > 300 and found >= 0.95 * len(near)


def test_line_dedup_odd_rows(odd, clashing, nothing):
    rows = linededup.dedup_lines(clashing).collect()
    text = defaultdict(list)
    for r in rows:
        text[r["doc_id"]].append(r["text"])
    assert len(rows) == odd.count()
    assert text[4] == [None] and text[3] == [""] and text[6] == [" \n\t "] and text[8] == [""]
    assert text[7] == ["same text twice in the table"] * 2 and text[2] == ["another line of some other document"]
    assert text[10] == [""] and len(text[9][0]) > 1000
    assert linededup.dedup_lines(nothing).count() == 0


# -- mixing


def test_mixing_against_sql_and_targets(spark, odd, clashing, nothing):
    rows = mixing.mix(odd).collect()
    size = {"a": 0, "b": 0, "c": 0, None: 0}
    for r in odd.collect():
        size[r["source"]] += len((r["text"] or "").encode().split())
    assert {r["source"]: r["source_size"] for r in rows} == size
    total = sum({r["source"]: r["target"] for r in rows}.values())
    assert total == pytest.approx(min(1.5 * sum(size.values()), 2 * sum(size.values())), rel=1e-9) or all(r["target"] <= 2 * r["source_size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    largest = max(r["size"] for r in rows)
    for r in rows:
        assert r["target"] <= 2 * r["source_size"] and abs(taken[r["source"]] - r["target"]) <= largest
    assert mixing.mix(clashing).count() == odd.count() and mixing.mix(nothing).count() == 0
    stream = mixing.curriculum(clashing)
    assert stream.columns == clashing.columns
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert Counter(r["doc_id"] for r in stream.collect()) == +want


def test_schedule_is_the_inverse_of_its_integral(spark):
    rows = spark.range(11).select((F.col("id") / 10).alias("u"), F.explode(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5))).alias("a"))
    for r in rows.withColumn("t", mixing.position(F.col("u"), F.col("a"))).collect():
        assert r["t"] + r["a"] * (r["t"] ** 2 - r["t"]) == pytest.approx(r["u"], abs=1e-12)


@pytest.mark.parametrize("name, query, sql, table", [("mixing", mixing.op9_mixing, mixing.SQL, "documents"), ("topk", topk.op5_topk, topk.SQL, "embeddings")])
def test_queries_with_sql(spark, folder, name, query, sql, table):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.execute(sql).fetchall()
    names = [d[0] for d in db.description]
    got = query(spark, folder).select(*names).collect()
    key = lambda row: tuple(-1 if x is None else x for x in row)
    got, want = sorted(map(key, got)), sorted(map(key, want))
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want))


# -- search


def test_topk_ties_and_odd_vectors(spark):
    random = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in random.integers(-3, 4, 8) / 8]) for i in range(400)]
    vectors += [(400 + i, [0.5] * 8) for i in range(150)]  # a very common vector
    vectors += [(600, None), (601, [None] * 8), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (None, [2.0] * 8), (604, []), (605, [0.5, -0.5]), (0, [9.0] * 8)]
    found = topk.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), "vec_id", "embedding", 64)
    rows = [(r["id"], np.array(list(r["terms"]) + [0] * (8 - len(r["terms"])))) for r in found.collect()]
    assert Counter(x for x, _ in rows) == Counter([*range(550), 604, 605, None, 0])  # each of two rows with id 0 takes part, and one without id
    got = topk.search(found, found.where("id % 20 = 0"), 20, shard=100, block=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = defaultdict(list)
    for at, (q, query) in enumerate(rows):
        if q is not None and q % 20 == 0:
            best = sorted(((x, int(v @ query)) for i, (x, v) in enumerate(rows) if i != at), key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:20]
            want[q] += [(rank + 1, *p) for rank, p in enumerate(best)]
    order = lambda found: sorted(found, key=lambda p: (p[0], p[2], p[1] is None, p[1] or 0))
    assert by.keys() == want.keys() and all(order(by[q]) == order(want[q]) for q in want)
    assert len(by[0]) == 40 and any(x is None for q in by.values() for _, x, _ in q)
    few = found.where("id < 5")
    assert topk.search(few, few.where("id = 4")).count() == 5
    assert topk.search(few.where("id < 0"), few.where("id < 0")).count() == 0


# -- shards


def check_shards(rows, docs, shards=24):
    count = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and set(count) <= set(range(shards))
    assert max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_are_even_and_keep_groups(spark, clashing, odd, nothing):
    docs = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"own {i}") for i in range(960)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    where = defaultdict(set)
    for r in rows:
        where[docs[r["doc_id"]][1]].add(r["shard"])
    assert len(where.pop("hot")) <= 10  # a third of all rows needs 8 shards
    cut = sum(len(x) > 1 for x in where.values())
    assert cut <= 0.02 * len(where)
    check_shards(sharding.shard(clashing).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sharding.shard(nothing).count() == 0


def test_full_shards_exchange_documents(spark):
    """No document is alone, so there is no room to move into."""
    docs = [(i, f"pair {i // 2}") for i in range(960)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"] // 2].add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 0.05 * len(where)


@pytest.mark.parametrize("seed", range(20))
def test_flows_keep_counts(seed):
    random = np.random.default_rng(seed)
    pairs = [(s, t) for s in range(6) for t in range(6) if s != t]
    wishes = {p: int(random.integers(1, 9)) for p in pairs if random.random() < 0.4}
    tied = {(s, t): int(random.integers(1, 9)) for s, t in pairs if s < t and random.random() < 0.4}
    room = [int(random.integers(0, 4)) for _ in range(6)]
    one_way, both_ways = sharding.flows(wishes, tied, room, seed % 2 == 0)
    inner = [(p, n) for p, n in (*one_way.items(), *both_ways.items()) if max(p) < 6]
    for s in range(6):
        gain = sum(n for p, n in inner if p[1] == s) - sum(n for p, n in inner if p[0] == s)
        assert gain <= room[s]
    assert all(0 <= one_way[p] <= wishes.get(p, 0) for p in pairs)
    assert all(both_ways[s, t] + both_ways[t, s] <= tied.get((s, t), 0) for s, t in pairs if s < t)
    rest = Counter({p: wishes.get(p, 0) - one_way[p] for p in pairs})
    assert all(min(rest[s, t], rest[t, s]) <= 0 for s, t in pairs)  # no two wishes that match are left


# -- pipeline


def test_pipeline_against_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stored(corpus_pipeline.quality_rules(spark, docs, folder), "stage")
    judged = {r["doc_id"] for r in quality.op4_quality(spark, folder).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == judged and kept.columns == docs.columns
    lines = stored(corpus_pipeline.line_dedup(spark, kept, folder), "stage")
    assert lines.columns == docs.columns and lines.count() == kept.count()
    one = stored(corpus_pipeline.near_dedup(spark, lines, folder), "stage")
    codes = {nearcopies.fingerprint(r["text"] or "") for r in lines.collect()}
    assert one.columns == docs.columns and one.count() == len({x for c in codes for x in [close_classes(sorted(codes)).find(c)]})
    mixed = stored(corpus_pipeline.mixing_to_weights(spark, one, folder), "stage")
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def odd_folder(spark, tmp_path, docs):
    """A data folder with these documents, further columns of clashing names, and labels for half of them."""
    names = ("size", "slope", "code", "n_lines", "position", "_order", "kept", "sequence_id", "label")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit("own").alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd, nothing, tmp_path):
    random = np.random.default_rng(8)
    word = lambda: "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(2, 9)))
    prose = [(20 + i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(8)) + ".", "abc"[i % 3]) for i in range(12)]
    docs = odd.union(spark.createDataFrame(prose + prose[:4], odd.schema))
    where = odd_folder(spark, tmp_path / "some", docs)
    kept = corpus_pipeline.documents(spark, where)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, where), "odd")
        assert set(kept.columns) == set(corpus_pipeline.documents(spark, where).columns), name
        assert {r[c] for c in ("size", "slope", "code", "n_lines", "position", "_order") for r in kept.collect()} <= {"own"}, name
    packed = corpus_pipeline.run(spark, where)
    rows = packed.select("doc_id", "piece", "length", "offset").collect()
    assert len({r["doc_id"] for r in rows} & {20 + i for i in range(12)}) >= 8 and not {r["doc_id"] for r in rows} & {3, 4, 5, 6}
    again = corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "dealt", docs.repartition(7)))
    assert sorted(r["length"] for r in again.collect()) == sorted(r["length"] for r in rows)
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "none", nothing)).count() == 0


def test_mix_is_the_same_however_rows_are_dealt(spark):
    rows = [(1 if i < 7 else None if i < 10 else i, " ".join(["word"] * (i % 5 + 1) + [f"t{i}"]), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")
    found = [Counter(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
