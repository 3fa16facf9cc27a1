"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas. DataFrame functions only."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents, parts, running_sum, stored

SHARDS = 24
FULL = 0.9  # of a shard's quota: a shard with that many documents of one group is settled for it
LEAST_GAIN = 0.002  # of the pieces of groups, or of the squares of their counts, that a round has to gain


def _numbered(rows: DataFrame, by: str, order: str, value: str, name: str, digits: int) -> DataFrame:
    return running_sum(rows, parts(rows, by, order, value, digits), by, order, value, name, digits)


def _per_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), shard + 1)


def flows(wishes: dict[tuple[int, int], int], tied: dict[tuple[int, int], int], room: list[int], pairs_first: bool) -> tuple[dict, dict]:
    """What moves between shards so that no shard gains more documents than it loses and has room for, for wishes and ties apart.

    wishes[s, t] documents want to go from s to t; of tied[s, t], s < t, each may go either way. A cycle of shards along
    which documents move leaves all counts as they are; a shard with room passes it on to where its documents came from, by
    way of a node that stands for all rooms. Cycles are taken until none is left. The work depends on the number of
    shards alone.
    """
    size = len(room)
    ahead, either = Counter(wishes), Counter(tied)
    ahead.update({(s, size): n for s, n in enumerate(room) if n > 0})
    spare = sum(ahead.values()) + sum(either.values())
    ahead.update({(size, s): spare for s in range(size)})
    one_way, both_ways = Counter(), Counter()
    edge = lambda s, t: (min(s, t), max(s, t))
    left = lambda s, t: ahead[s, t] + either[edge(s, t)]

    def push(s: int, t: int, n: int) -> None:
        wished = min(n, ahead[s, t])
        ahead[s, t] -= wished
        one_way[s, t] += wished
        either[edge(s, t)] -= n - wished
        both_ways[s, t] += n - wished

    def exchange() -> None:
        for s, t in combinations(range(size), 2):
            n = min(left(s, t), left(t, s), (ahead[s, t] + ahead[t, s] + either[s, t]) // 2)
            push(s, t, n)
            push(t, s, n)

    def way(start: int, end: int) -> list[int] | None:
        came, queue = {start: start}, [start]
        for at in queue:
            for to in range(size + 1):
                if to not in came and left(at, to) > 0 and (at, to) != (start, end):
                    came[to] = at
                    queue.append(to)
                    if to == end:
                        path = [end]
                        while path[-1] != start:
                            path.append(came[path[-1]])
                        return path[::-1]
        return None

    def cycles() -> None:
        for s, t in [(s, t) for s in range(size) for t in range(size) if s != t]:
            while left(s, t) > 0 and (path := way(t, s)) is not None:
                steps = list(zip([s, *path], path))
                n = min(left(*step) for step in steps)
                for step in steps:
                    push(*step, n)

    for step in (exchange, cycles) if pairs_first else (cycles, exchange):
        step()
    return one_way, both_ways


def _by_pair(amounts: dict[tuple[int, int], int], shards: int, s: Column, t: Column) -> Column:
    return F.element_at(F.array(*[F.lit(amounts.get((i, j), 0)).cast("long") for i in range(shards) for j in range(shards)]), s * shards + t + 1)


def _wishes(places: DataFrame, quota: int, full: int, turn: int) -> DataFrame:
    """Adds pieces, to and tie to the places: where a row's documents want to go, if anywhere, and whether the other way is as good.

    Windows hold one row per shard of a group. A shard with `full` documents of a group is settled for that group. A group
    with more than a quota needs several shards and gathers in all of them at once.
    """
    group = Window.partitionBy("group")
    order = group.orderBy(F.col("n") >= full, F.desc("n"), F.xxhash64("group", "shard", F.lit(turn)))
    ranked = places.select(
        "group", "shard", "n", F.count("*").over(group).alias("pieces"), F.sum("n").over(group).alias("_all"), F.row_number().over(order).alias("_at"),
        F.sum((F.col("n") >= full).cast("int")).over(group).alias("_settled"), F.first("n").over(order).alias("_there"),
        F.collect_list("shard").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_shards"))
    homes = F.when(F.col("_all") > quota, F.greatest(F.ceil(F.col("_all") / full) - F.col("_settled"), F.lit(1))).otherwise(1).cast("int")
    ranked = ranked.withColumn("_homes", homes)
    moves = (F.col("_at") > F.col("_homes")) & (F.col("n") < full)
    to = F.get("_shards", F.pmod(F.xxhash64("group", "shard", F.lit(turn)), F.col("_homes")).cast("int"))
    tie = moves & (F.col("_at") == 2) & (F.col("n") == F.col("_there"))
    return ranked.select("group", "shard", "n", "pieces", F.when(moves, to).alias("to"), tie.alias("tie"))


def _moved(wish: DataFrame, moves: DataFrame) -> DataFrame:
    """The places after moves (group, from, to, m)."""
    changes = moves.where("m > 0").select("group", F.inline(F.array(
        F.struct(F.col("to").alias("shard"), F.col("m").alias("n")), F.struct(F.col("from").alias("shard"), (-F.col("m")).alias("n")))))
    return stored(wish.select("group", "shard", "n").union(changes).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "places")


def _covered(first: Column, n: Column, low: Column, high: Column) -> Column:
    """How much of [first, first + n) lies in [low, high)."""
    return F.greatest(F.least(first + n, high) - F.greatest(first, low), F.lit(0).cast("long"))


def propagate(places: DataFrame, quota: int, shards: int, digits: int, least: float = LEAST_GAIN) -> DataFrame:
    """(group, shard, n) after label propagation; places has the same columns, and a shard at or below `quota` stays there.

    The neighbours of a document are the documents of its group, so a shard's label counts as much as the group has
    documents there. In a round each group's documents want to go to the shard where it has most. What may move is settled by
    shard, from one number per pair of shards: flows() matches moves with moves back and with free room, so quotas hold on
    the net flow. Where nothing can be matched, groups that lie in one shard make way: they go as a whole where the others come
    from. Either way the squares of the counts grow, so rounds come to an end. They end once three in a row lessen
    neither the pieces of groups nor grow the squares by `least`.
    A group with more documents than a shard takes is settled where it has FULL of the quota, and gathers in as many as it needs.
    """
    full, calm, before, turn = max(1, int(quota * FULL)), 0, None, 0
    while calm < 3:
        wish = stored(_wishes(places, quota, full, turn), "wishes")
        found = wish.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).collect()  # a row per shard
        pieces, squares = sum(r["rows"] for r in found), sum(r["squares"] for r in found)
        gained = before is None or pieces < before[0] * (1 - least) or squares > before[1] * (1 + least)
        calm, before, turn = 0 if gained else calm + 1, (pieces, squares), turn + 1
        wanted, tied = Counter(), Counter()
        for r in wish.where("to is not null").groupBy("shard", "to", "tie").agg(F.sum("n").alias("n")).collect():  # two rows per pair of shards
            if r["tie"]:
                tied[min(r["shard"], r["to"]), max(r["shard"], r["to"])] += r["n"]
            else:
                wanted[r["shard"], r["to"]] += r["n"]
        if not wanted and not tied:
            break
        load = {r["shard"]: r["n"] for r in found}
        room = [max(0, quota - load.get(s, 0)) for s in range(shards)]
        one_way, both_ways = flows(wanted, tied, room, turn % 2 == 1)
        going = wish.where("to is not null").withColumn("_order", F.md5(F.concat_ws("/", "group", "shard", F.lit(str(turn)))))
        if gained and any(n for (s, t), n in (one_way + both_ways).items() if s < shards and t < shards):
            low, high = F.least("shard", "to"), F.greatest("shard", "to")
            pair = F.when(F.col("tie"), F.concat_ws("=", low, high)).otherwise(F.concat_ws(">", "shard", "to"))
            going = _numbered(going.withColumn("_pair", pair), "_pair", "_order", "n", "_first", digits)
            up, down = _by_pair(both_ways, shards, low, high), _by_pair(both_ways, shards, high, low)
            nothing = F.lit(0).cast("long")
            moves = going.select("group", F.inline(F.when(F.col("tie"), F.array(
                F.struct(low.alias("from"), high.alias("to"), _covered(F.col("_first"), F.col("n"), nothing, up).alias("m")),
                F.struct(high.alias("from"), low.alias("to"), _covered(F.col("_first"), F.col("n"), up, up + down).alias("m")),
            )).otherwise(F.array(F.struct(F.col("shard").alias("from"), F.col("to").alias("to"), _covered(
                F.col("_first"), F.col("n"), nothing, _by_pair(one_way, shards, F.col("shard"), F.col("to"))).alias("m"))))))
            places = _moved(wish, moves)
        else:
            places = _moved(wish, _making_way(wish, going, wanted, tied, room, digits, turn))
    return places


def _making_way(wish: DataFrame, going: DataFrame, wanted: Counter, tied: Counter, room: list[int], digits: int, turn: int) -> DataFrame:
    """Moves (group, from, to, m): as many wishes as groups that lie in the wished shard as a whole make way for.

    They go where the wishes come from, as many documents as wish to leave there and as there is room for.
    """
    shards, asked = len(room), wanted + Counter({(s, t) if turn % 2 else (t, s): n for (s, t), n in tied.items()})
    wishing = Counter(s for s, _ in asked)
    asked = {(s, t): n + room[s] // wishing[s] for (s, t), n in asked.items()}
    starts, at = {}, Counter()
    for s, t in sorted(asked):  # what t gives to s covers [starts, starts + asked) of its whole groups
        starts[s, t] = at[t]
        at[t] += asked[s, t]
    whole = wish.where("pieces = 1").select("group", "shard", "n", F.col("shard").cast("string").alias("_shard"), F.md5(F.concat_ws("/", "group", F.lit(str(turn)))).alias("_order"))
    whole = _numbered(whole, "_shard", "_order", "n", "_first", digits)
    ends = [F.when((F.col("shard") == t) & (F.col("_first") >= starts[s, t]) & (F.col("_first") + F.col("n") <= starts[s, t] + asked[s, t]), F.lit(s)) for s, t in sorted(asked)]
    out = stored(whole.select("group", F.col("shard").alias("from"), F.coalesce(*ends).alias("to"), F.col("n").alias("m")).where("to is not null"), "making-way")
    taken = Counter({(r["to"], r["from"]): r["m"] for r in out.groupBy("from", "to").agg(F.sum("m").alias("m")).collect()})  # a row per pair of shards
    # A tie goes in the one direction that was asked for, so its row may be the one at the other end.
    source = F.when(F.col("tie") & ((F.col("shard") < F.col("to")) != F.lit(bool(turn % 2))), F.col("to")).otherwise(F.col("shard"))
    target = F.when(source == F.col("shard"), F.col("to")).otherwise(F.col("shard"))
    going = going.select("group", "n", "_order", source.alias("from"), target.alias("to"))
    going = _numbered(going.withColumn("_pair", F.concat_ws(">", "from", "to")), "_pair", "_order", "n", "_first", digits)
    m = _covered(F.col("_first"), F.col("n"), F.lit(0).cast("long"), _by_pair(taken, shards, F.col("from"), F.col("to")))
    return out.union(going.select("group", "from", "to", m.alias("m")))


def shard(docs: DataFrame, shards: int = SHARDS, digits: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`; law "rows": counts at most one apart.

    Documents with equal texts are linked. They start in shards by digest and move by propagate(); documents without a
    link cut no edge wherever they are, so they are placed last and make the counts even. Slots number the rows of a
    shard from 0. Groups, not pairs, are what is joined; ranks come from running_sum, so a text that a third of all
    rows share is spread, over tasks and, beyond a quota, over shards.

    A null text has 0 bytes and is linked with other null texts only; a null doc_id and repeated rows are placed like
    any other; no rows give no rows; further columns are left out.
    """
    rows = stored(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.coalesce(F.md5("text"), F.lit("null")).alias("group"),
    ).withColumn("_order", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "group"))).withColumn("_one", F.lit(1).cast("long")), "shard-rows")
    members = rows.groupBy("group").agg(F.count("*").alias("n"))
    several = members.where("n > 1").select("group")
    linked = stored(_numbered(rows.join(several, "group", "left_semi"), "group", "_order", "_one", "_rank", digits), "linked")
    alone = stored(rows.join(several, "group", "left_anti"), "alone")

    total = rows.count()
    start = linked.groupBy("group", F.pmod(F.xxhash64("_order"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    places = propagate(_within(stored(start, "places"), total // shards, shards, digits), total // shards, shards, digits)

    # A group's documents, by rank, go to its shards in turn; a shard's groups follow one another.
    places = places.withColumn("_shard", F.col("shard").cast("string")).withColumn("_group", F.md5("group"))
    places = _numbered(places, "_shard", "_group", "n", "_first", digits)
    places = _numbered(places.withColumn("_by", F.lpad("_shard", 6, "0")), "group", "_by", "n", "_from", 6)
    placed = linked.join(places.select("group", "shard", "n", "_first", "_from"), "group").where("_rank >= _from and _rank < _from + n")
    placed = placed.withColumn("slot", F.col("_first") + F.col("_rank") - F.col("_from"))

    load = {r["shard"]: r["n"] for r in places.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    filled = [load.get(s, 0) for s in range(shards)]
    need = [total // shards + (s < total % shards) - filled[s] for s in range(shards)]
    starts = [sum(need[:s]) for s in range(shards)]
    alone = _numbered(alone.withColumn("_all", F.lit("all")), "_all", "_order", "_one", "_rank", digits)
    # The last shard that starts at the rank or before; shards that need nothing start where the next one does.
    index = sum(((F.col("_rank") >= F.lit(s)).cast("int") for s in starts[1:]), F.lit(0))
    alone = alone.withColumn("shard", index.cast("int"))
    alone = alone.withColumn("slot", F.col("_rank") - _per_shard(starts, F.col("shard")) + _per_shard(filled, F.col("shard")))
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.select(*columns).union(alone.select(*columns))


def _within(places: DataFrame, quota: int, shards: int, digits: int) -> DataFrame:
    """The places with no shard above `quota`: what a shard has too much goes where there is room.

    All linked documents are at most shards x quota plus a remainder below `shards`, which a quota one higher holds.
    """
    ranked = _numbered(places.withColumn("_shard", F.col("shard").cast("string")).withColumn("_order", F.md5(F.concat_ws("/", "group", "shard"))), "_shard", "_order", "n", "_before", digits)
    load = {r["shard"]: r["n"] for r in places.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    if all(n <= quota for n in load.values()):
        return places
    limits = [quota] * shards
    spare = sum(load.values()) - quota * shards
    for s in range(max(0, spare)):
        limits[s] += 1
    kept = F.greatest(F.least(F.col("n"), _per_shard(limits, F.col("shard")) - F.col("_before")), F.lit(0))
    ranked = stored(ranked.withColumn("_kept", kept), "within")
    room = [limits[s] - min(load.get(s, 0), limits[s]) for s in range(shards)]
    starts = [sum(room[:s]) for s in range(shards)]
    over = ranked.where("n > _kept").withColumn("_all", F.lit("all")).withColumn("_rest", F.col("n") - F.col("_kept"))
    over = _numbered(over, "_all", "_order", "_rest", "_at", digits)
    # A row's rest covers [_at, _at + _rest) of the room; each shard takes its overlap.
    parts_ = F.explode(F.array(*[
        F.struct(F.lit(s).alias("to"), (F.least(F.col("_at") + F.col("_rest"), F.lit(starts[s] + room[s])) - F.greatest(F.col("_at"), F.lit(starts[s]))).alias("m"))
        for s in range(shards)
    ])).alias("x")
    moved = over.select("group", parts_).where("x.m > 0").select("group", F.col("x.to").alias("shard"), F.col("x.m").alias("n"))
    stay = ranked.where("_kept > 0").select("group", "shard", F.col("_kept").alias("n"))
    return stored(stay.union(moved).groupBy("group", "shard").agg(F.sum("n").alias("n")), "places")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(documents(spark, folder))
