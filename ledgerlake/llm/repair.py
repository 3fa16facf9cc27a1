"""Repair of conversation structure by a Viterbi search whose survivors emit their edits once they share an ancestor."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"  # what [^\x20\x09-\x0D] leaves out
RUNG = 20  # one of so many damages, 0 to 4 of which act

# What the roles so far spell: nothing, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
_ENDS = (START, ASSISTANT)
_DELETE, _REROLE, _INSERT = 3, 2, 2
# What it costs a way in one state, at most, to go on as any way in another state could: by inserts, where it expects what the
# other one expects for nothing, and by deleting a system turn that only an empty beginning could keep.
_AS = {
    START: {SYSTEM: 0, USER: _INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * _INSERT, USER: _INSERT, ASSISTANT: 2 * _INSERT},
    USER: {START: _INSERT + _DELETE, SYSTEM: _INSERT, ASSISTANT: _INSERT},
    ASSISTANT: {START: _DELETE, SYSTEM: 0, USER: _INSERT},
}


@dataclass(frozen=True, order=True)
class Option:
    """Inserts and then one edit of the row (none at the end), from one state to another; roles as the edits give them, None to keep."""

    cost: int
    edits: str
    to: int
    roles: tuple[str | None, ...]


@lru_cache(maxsize=None)
def options(initial: str, must_delete: bool, cut: bool, end: bool = False) -> tuple[tuple[Option, ...], ...]:
    """The cheapest way (ties: ASCII-least edits) from each state to each state across one row, or across the end.

    Inserts stand before a row or at the end, two at most: a third would only come back to a state passed before. Two ways from
    one state across one row end in exactly one edit of that row, so none is a prefix of another one.
    """
    found = []
    for start in range(4):
        best: dict[int, Option] = {}
        state, cost, edits, roles = start, 0, "", ()
        for _ in range(3):
            after, role = _NEXT[state]
            if end:
                ways = [(state, 0, "", ())] if state in _ENDS else []
            else:
                ways = [(state, _DELETE, "D", ())]
                if not must_delete:
                    if initial == role[0]:
                        ways.append((after, cut, "K", (None,)))
                    if initial == "s" and state == START:
                        ways.append((SYSTEM, cut, "K", (None,)))
                    ways.append((after, _REROLE + cut, "R", (role,)))
            for to, more, edit, given in ways:
                way = Option(cost + more, edits + edit, to, roles + given)
                best[to] = min(way, best.get(to, way))
            state, cost, edits, roles = after, cost + _INSERT, edits + "I", (*roles, role)
        found.append(tuple(best.values()))
    return tuple(found)


@dataclass(eq=False, slots=True)
class Node:
    """One step of a survivor's way. Its children are the references that keep it."""

    parent: Node | None
    edits: str
    roles: tuple[str | None, ...]
    row: tuple[str, str] | None
    children: list[Node] = field(default_factory=list)


class Repair:
    """The cheapest edits of one conversation, given row by row; `emit(edit, role, text)` gets each edit once it is certain.

    Every state keeps its cheapest way; of ways that cost the same the one with the ASCII-least edits. Ways are ranked by their
    complete edits: ways with different parents are ordered as their parents are, since all end in an edit of the same row and
    so none is a prefix of another; ways with one parent by what follows it. So a tie is decided on complete suffixes without
    walking them. A state whose way costs more than another one's that goes on in its stead is given up.

    Ways form a tree of parents. A way that no survivor goes on from is cut back to the next branch; what lies before the
    first branch is the same for all survivors, is emitted and dropped. Memory holds the rows behind it alone.
    """

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.emit = emit
        self.root = Node(None, "", (), None)
        self.live: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}

    def _step(self, table: tuple[tuple[Option, ...], ...], row: tuple[str, str] | None) -> None:
        best: dict[int, tuple] = {}
        for state, (cost, rank, _) in self.live.items():
            for way in table[state]:
                key = (cost + way.cost, rank, way.edits, way, state)
                if way.to not in best or key[:3] < best[way.to][:3]:
                    best[way.to] = key
        cost = {to: key[0] for to, key in best.items()}
        best = {to: key for to, key in best.items() if all(cost[to] <= c + _AS[other][to] for other, c in cost.items() if other != to)}
        fresh = {}
        for place, (to, (cost, _, _, way, state)) in enumerate(sorted(best.items(), key=lambda b: b[1][1:3])):
            parent = self.live[state][2]
            node = Node(parent, way.edits, way.roles, row)
            parent.children.append(node)
            fresh[to] = (cost, place, node)
        for _, _, node in self.live.values():
            while not node.children and node.parent is not None:
                node.parent.children.remove(node)
                node = node.parent
        self.live = fresh
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self._out(self.root)

    def _out(self, node: Node) -> None:
        given = iter(node.roles)
        for edit in node.edits:
            if edit == "D":
                self.emit(edit, None, None)
            elif edit == "I":
                self.emit(edit, next(given), "")
            else:
                role = next(given)
                self.emit(edit, role or node.row[0], node.row[1])
        node.row = None

    def row(self, role: str, text: str, must_delete: bool, cut: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        self._step(options(initial, must_delete, cut and not must_delete), (role, text))

    def close(self) -> int:
        """The cost, once all edits are emitted."""
        table = options("", False, False, True)
        cost, _, _, state, way = min((cost + w.cost, rank, w.edits, state, w) for state, (cost, rank, _) in self.live.items() for w in table[state])
        last = Node(self.live[state][2], way.edits, way.roles, None)
        chain = [last]
        while chain[-1].parent is not self.root:
            chain.append(chain[-1].parent)
        for node in reversed(chain):
            self._out(node)
        return cost


# -- damage and faults, as DataFrame functions


def _or_blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: one row in five is damaged by the remainder of crc32(conv_id:turn) by 20.

    0 drops the row (it stays, marked `dropped`, so that its conversation is not lost), 1 empties its text, 2 takes its sentence
    ends, 3 repeats it, 4 makes it a user's. Null ids, turns, roles and texts count as one blank; other columns are left out.
    """
    kind = F.crc32(F.concat_ws(":", _or_blank("conv_id"), _or_blank("turn")).cast("binary")) % RUNG
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_or_blank("text"), "[.!?]", "")).otherwise(_or_blank("text"))
    role = F.when(kind == 4, "user").otherwise(_or_blank("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(times).alias("_copy"))
    return rows.drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with their first fault, each conversation in one partition and in the order of its turns.

    One shuffle by conv_id; the windows and the sort behind it spill, and nothing of a conversation is gathered in memory.
    """
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(last == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


_NONE = object()


class _Sink:
    """Takes the ordered rows of a partition one by one and gives Arrow batches of a bounded size."""

    schema: pa.Schema
    most_rows, most_chars = 8192, 4 << 20

    def __init__(self):
        self.own, self.repair, self.chars = _NONE, None, 0
        self.rows: list[tuple] = []
        self.ready: list[pa.RecordBatch] = []

    def begin(self) -> None: ...

    def seen(self, turn: int | None, role: str, fault: str | None) -> None: ...

    def edit(self, edit: str, role: str | None, text: str | None) -> None: ...

    def end(self, cost: int) -> None: ...

    def take(self, conv_id, turn, role, text, dropped, fault) -> None:
        if self.own is _NONE or conv_id != self.own:
            self.close()
            self.own, self.repair = conv_id, Repair(self.edit)
            self.begin()
        if not dropped:
            self.seen(turn, role, fault)
            self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def close(self) -> None:
        if self.repair is not None:
            self.end(self.repair.close())
            self.repair = None

    def put(self, row: tuple, chars: int = 0) -> None:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= self.most_rows or self.chars >= self.most_chars:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.ready.append(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.rows, self.chars = [], 0

    @classmethod
    def over(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = cls()
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "dropped", "fault"))):
                sink.take(*row)
                if sink.ready:
                    yield from sink.ready
                    sink.ready = []
        sink.close()
        sink.flush()
        yield from sink.ready


class _Edits(_Sink):
    """A row for each edit."""

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def begin(self) -> None:
        self.position = 0

    def edit(self, edit: str, role: str | None, text: str | None) -> None:
        self.put((self.own, self.position, edit, role, text), len(text or ""))
        self.position += 1


class _Digests(_Sink):
    """A row for each conversation: its faults, the cost, the edits and a digest of the repaired text, taken as it is emitted."""

    schema = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def begin(self) -> None:
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        self.illegal, self.turns, self.first, self.last, self.before = 0, 0, None, None, None
        self.audit, self.hash, self.kept = bytearray(), hashlib.sha256(), 0

    def seen(self, turn: int | None, role: str, fault: str | None) -> None:
        self.count[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + 1, turn

    def edit(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit += edit.encode()
        if role is not None:
            self.hash.update(("\n" * (self.kept > 0) + f"{role}:{text}").encode())
            self.kept += 1

    def end(self, cost: int) -> None:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        faults = (self.count[n] for n in ("blank", "duplicate", "truncated"))
        self.put((self.own, gaps, *faults, self.illegal, cost, self.audit.decode(), self.hash.hexdigest()), len(self.audit))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the cheapest edits of each conversation, in order (role and text null where deleted).

    `rows` holds conv_id, turn, role, text and dropped; see damaged(). A conversation's rows are taken by turn, nulls first, ties
    by role and text; repeated rows are duplicates; a null conv_id is a conversation of its own; a role that is empty or has another initial than
    s, u or a cannot be kept; a conversation of dropped rows alone has no edits; further columns are left out; no rows give no
    rows. A conversation streams through one task in order, however long it is, and is never held there: the task keeps what its
    survivors do not agree on yet.
    """
    schema = "conv_id long, position long, edit string, role string, text string"
    return _ordered(rows).mapInArrow(_Edits.over, schema)


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows, order and odd cases are those of repaired(). SHA-256 has to read a conversation's repaired text in order, so
    its digest is taken in the same streaming pass as the edits.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _ordered(rows).mapInArrow(_Digests.over, schema)


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return audited(damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
