"""Conversation repair: the search against all edits and a search over whole strings, damage and digests, odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, repaired turns) over all edits with two inserts at most in one place."""
    best = None
    for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and r[2] for e, r in zip(edits, rows)):
                continue
            audit = "".join(g + e for g, e in zip(gaps, edits)) + gaps[-1]
            cost = sum({"D": 3, "K": 0, "R": 2, "I": 2}[e] for e in audit) + sum(e != "D" and r[3] for e, r in zip(edits, rows))
            if best and (cost, audit) >= best[:2]:
                continue
            for given in itertools.product(("user", "assistant"), repeat=sum(e in "RI" for e in audit)):
                free, own, out = iter(given), iter(rows), []
                for edit in audit:
                    if edit == "I":
                        out.append((next(free), ""))
                        continue
                    row = next(own)
                    if edit != "D":
                        out.append((row[0] if edit == "K" else next(free), row[1]))
                if LEGAL.match("".join(role[:1] or "?" for role, _ in out)):
                    best = (cost, audit, out)
                    break
    return best


def run(rows):
    given = []
    one = repair.Repair(lambda *edit: given.append(edit))
    for row in rows:
        one.row(*row)
    cost = one.close()
    return cost, "".join(g[0] for g in given), [(g[1], g[2]) for g in given if g[0] != "D"]


def test_repair_against_all_edits():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.random() < 0.2) for i in range(rng.choice([0, 1, 2, 3, 3]))]
        rows = [(*r, not r[2] and rng.random() < 0.3) for r in rows]
        assert run(rows) == cheapest(rows), rows


def whole_strings(rows):
    """(cost, audit) by keeping complete strings for every state: no ranks, no tree."""
    live = {0: (0, "")}
    after = {0: 2, 1: 2, 3: 2, 2: 3}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def inserted(live):
        out = dict(live)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                put(out, after[state], (cost + 2, audit + "I"))
        return out

    for role, _, gone, cut in rows:
        fresh = {}
        for state, (cost, audit) in inserted(live).items():
            put(fresh, state, (cost + 3, audit + "D"))
            if not gone:
                put(fresh, after[state], (cost + 2 + cut, audit + "R"))
                if role[:1] == ("a" if state == 2 else "u"):
                    put(fresh, after[state], (cost + cut, audit + "K"))
                if role[:1] == "s" and state == 0:
                    put(fresh, 1, (cost + cut, audit + "K"))
        live = fresh
    return min(way for state, way in inserted(live).items() if state in (0, 3))


def test_repair_of_long_conversations():
    rng = random.Random(4)
    for roles in (["user", "assistant"], ["user"], ["assistant", "system"], ["user", "assistant", "system", "tool"]):
        rows = [(rng.choice(roles), "x", rng.random() < 0.1, False) for _ in range(400)]
        assert run(rows)[:2] == whole_strings(rows)


def test_repair_forgets_what_is_certain():
    class Counted(repair.Repair):
        most = 0

        def row(self, *row):
            super().row(*row)
            nodes, seen = [self.root], 0
            while nodes:
                seen += 1
                nodes += nodes.pop().children
            self.most = max(self.most, seen)

    rng, given = random.Random(5), []
    one = Counted(lambda *edit: given.append(edit))
    for i in range(20_000):
        one.row(rng.choice(["user", "assistant"]), f"t{i}", False, False)
    one.close()
    assert one.most < 100 and sum(g[0] != "I" for g in given) == 20_000


def expected(rows):
    """The query's result by plain Python over the rows of the table."""
    by, blank = defaultdict(list), re.compile(r"[^\x20\x09-\x0D]")
    for conv, turn, role, text in rows:
        own = by[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, count, ready = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in own:
            left = blank.findall(text)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else None if left[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            ready.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = whole_strings(ready)
        state, own, turns = 0, iter(ready), []
        for edit in audit:
            role = "assistant" if state == 2 else "user"
            if edit == "I":
                turns.append(f"{role}:")
            else:
                row = next(own)
                if edit == "D":
                    continue
                role = row[0] if edit == "K" else role
                turns.append(f"{role}:{row[1]}")
            state = 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_repair_query(spark, where):
    rows = spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted(map(tuple, repair.op13_repair(spark, where).collect()), key=str)
    assert got == expected(rows)
    assert any(g[2] for g in got) and any(g[3] for g in got) and any(g[4] for g in got)


def test_repair_odd_rows(spark):
    long = "a b.\n" * 2_000_000
    rows = [(1, i, ["user", "assistant"][i % 2], f"text {i}.") for i in range(30)]
    rows += [(2, i % 3, "user", "same text.") for i in range(9)] + [(3, None, "user", "a."), (3, None, None, None), (3, 5, "assistant", None), (3, 5, "assistant", " \t\n")]
    rows += [(None, 0, "user", "no id."), (None, None, "tool", "x"), (4, 0, "", "role of no letter."), (5, 0, "user", long), (5, 1, "assistant", long + "cut")]
    rows += [(c, 0, "system", "alone?") for c in range(10, 60)] + [(7, 1, "user", "twice."), (7, 1, "user", "twice."), (7, 1, "assistant", "tied.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = expected(rows)
    assert any(w[7] == "" and w[8] == hashlib.sha256(b"").hexdigest() and not any(w[1:7]) for w in want)
    clash = frame.select("*", *[F.lit("x").alias(n) for n in ("dropped", "fault", "kind", "_copy", "audit", "cost", "position")])
    for parts in (1, 5):
        assert sorted(map(tuple, repair.audited(repair.damaged(clash.repartition(parts))).collect()), key=str) == want
    assert repair.audited(repair.damaged(frame.where("false"))).count() == 0
    edits = defaultdict(list)
    for r in repair.repaired(repair.damaged(frame.where("conv_id <> 5"))).collect():
        edits[r["conv_id"]].append((r["position"], r["edit"], r["role"], r["text"]))
    for conv, _, _, _, _, _, _, audit, digest in want:
        if conv in edits:
            own = sorted(edits[conv])
            assert "".join(e[1] for e in own) == audit
            assert hashlib.sha256("\n".join(f"{e[2]}:{e[3]}" for e in own if e[2] is not None).encode()).hexdigest() == digest
