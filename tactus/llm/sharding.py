"""Shards by balanced label propagation: linked documents gather under capacity quotas.

Documents with equal texts are linked. What moves between shards is a unit, the documents of one
text in one shard, so a round handles one row per text and shard however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm import ranks
from tactus.llm.shared import settle

#: Parts that the free room of a shard is split into, so that a round's moves are granted in parallel.
LANES = 64
#: Rounds under the exact quotas after that.
GATHER = 2
#: Parts of one text's documents in the last step, where documents are matched to their units.
PARTS = 32


def _room(loads: dict[int, int], quota: dict[int, int]) -> dict[int, int]:
    return {s: quota[s] - loads.get(s, 0) for s in quota}


def _loads(units: DataFrame) -> dict[int, int]:
    """Linked documents in each shard: as many rows as there are shards."""
    return {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}


def _choice(values: dict[int, int], of: Column, otherwise: int = 0) -> Column:
    """A number per shard as an expression."""
    pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), of), F.lit(otherwise))


def _round(units: DataFrame, room: dict[int, int]) -> tuple[DataFrame, int]:
    """Move units towards the shard with most documents of their text, as far as there is room.

    Gives the new units and how many documents moved.

    A unit goes to the fullest shard with room that holds more of its text (of equal ones, the one
    with the smaller number). The room of a shard is dealt to lanes in proportion to what they ask
    for; in a lane, larger units come first and the last one may move in part.
    """
    has_room = _choice({s: int(r > 0) for s, r in room.items()}, F.col("shard")) == 1
    best = units.where(has_room).groupBy("text_key").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("best"))
    asked = units.join(best, "text_key", "left").withColumns({"to": -F.col("best.minus"), "most": F.col("best.n")})
    ahead = (F.col("most") > F.col("n")) | ((F.col("most") == F.col("n")) & (F.col("to") < F.col("shard")))
    asked = asked.select("text_key", "shard", "n", F.when(ahead & (F.col("to") != F.col("shard")), F.col("to")).alias("to"))
    asked = asked.withColumn("lane", F.pmod(F.xxhash64("text_key", "shard"), F.lit(LANES)).cast("int"))
    demand = {(r["to"], r["lane"]): r["n"] for r in asked.where("to is not null").groupBy("to", "lane").agg(F.sum("n").alias("n")).collect()}
    total: dict[int, int] = {}
    for (to, _), n in demand.items():
        total[to] = total.get(to, 0) + n
    grants: dict[int, int] = {}
    for to, all_asked in total.items():
        given, reached = 0, 0
        for lane in range(LANES):  # cumulative rounding: the grants of a shard add up to its room
            reached += demand.get((to, lane), 0)
            upto = min(room[to], all_asked) * reached // all_asked
            grants[to * LANES + lane] = upto - given
            given = upto
    if not any(grants.values()):
        return units, 0
    w = Window.partitionBy("to", "lane").orderBy(F.desc("n"), "text_key", "shard").rowsBetween(Window.unboundedPreceding, -1)
    grant = _choice(grants, F.col("to") * LANES + F.col("lane"))
    moved = asked.where("to is not null").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    moved = moved.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), grant - F.col("before"))))
    stays = asked.where("to is null").select("text_key", "shard", "n")
    both = F.array(
        F.struct(F.col("to").alias("shard"), F.col("go").alias("n")), F.struct(F.col("shard"), (F.col("n") - F.col("go")).alias("n"))
    )
    dealt = moved.select("text_key", F.explode(both).alias("x")).select("text_key", "x.shard", "x.n").where("n > 0")
    units = stays.unionByName(dealt).groupBy("text_key", "shard").agg(F.sum("n").alias("n"))
    return units, sum(grants.values())


def _spread(bounds: list[tuple[int, int]], low: Column, n: Column) -> Column:
    """The shards that the places ``low`` to ``low + n`` fall into, and how many fall into each."""
    cells, begin = [], 0
    for s, end in bounds:
        held = F.least(low + n, F.lit(end)) - F.greatest(low, F.lit(begin))
        cells.append(F.struct(F.lit(s).alias("shard"), held.cast("long").alias("n")))
        begin = end
    return F.filter(F.array(*cells), lambda c: c["n"] > 0)


def _bounds(room: dict[int, int]) -> list[tuple[int, int]]:
    """Shards with room, and the number of places up to the end of each."""
    out, upto = [], 0
    for s, r in sorted(room.items()):
        if r > 0:
            upto += r
            out.append((s, upto))
    return out


def _relieved(units: DataFrame, loads: dict[int, int], quota: dict[int, int]) -> DataFrame:
    """Move the smallest units out of shards over their quota, whole where they fit."""
    room = _room(loads, quota)
    excess = {s: -r for s, r in room.items() if r < 0}
    if not excess:
        return units
    over = units.where(F.col("shard").isin(list(excess))).withColumn("lane", F.pmod(F.xxhash64("text_key"), F.lit(LANES)).cast("int"))
    held = {(r["shard"], r["lane"]): r["n"] for r in over.groupBy("shard", "lane").agg(F.sum("n").alias("n")).collect()}
    cuts: dict[int, int] = {}
    for s, out in excess.items():
        given, reached, whole = 0, 0, loads[s]
        for lane in range(LANES):
            reached += held.get((s, lane), 0)
            cuts[s * LANES + lane] = out * reached // whole - given
            given = out * reached // whole
    w = Window.partitionBy("shard", "lane").orderBy("n", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = _choice(cuts, F.col("shard") * LANES + F.col("lane"))
    over = over.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    over = over.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), cut - F.col("before"))))
    leaves = over.where("go > 0").select("text_key", "go").withColumn("__all", F.lit(0))
    leaves = ranks.running(leaves, ["__all"], ["text_key", "go"], LANES, "low", value=F.col("go"))
    leaves = leaves.select("text_key", F.explode(_spread(_bounds(room), F.col("low"), F.col("go"))).alias("x")).select("text_key", "x.shard", "x.n")
    stays = over.select("text_key", "shard", (F.col("n") - F.col("go")).alias("n")).where("n > 0")
    rest = units.where(~F.col("shard").isin(list(excess)))
    return rest.unionByName(stays).unionByName(leaves).groupBy("text_key", "shard").agg(F.sum("n").alias("n"))


def shards(
    docs: DataFrame,
    n_shards: int = 24,
    rounds: int = 6,
    slack: float = 0.25,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards whose row counts are at most one apart.

    Each text that occurs twice or more begins scattered by a hash of its rows. In each of up to
    ``rounds`` rounds, Spark joins and windows move its documents to the shard that holds most of
    them, as far as quotas allow, until a round moves none; a text with more copies than a shard may hold fills one and gathers
    the rest in others. During the rounds a quota is looser by ``slack``; then shards over their
    quota give up their smallest units, and GATHER rounds bring together what that has scattered. Rows without a link fill what is left. ``slot`` counts the rows of a shard
    from 0 without a gap, ``cut_links`` is the number of equal texts that a row has in other shards.

    Every row gets a place: repeated rows and null ids too. A null text counts as an empty one and
    all such rows are linked. Other columns are not looked at. An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(
        docs[id_column].alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("text_key"),
    )
    rows = settle(rows)
    total = rows.count()
    quota = {s: total // n_shards + int(s < total % n_shards) for s in range(n_shards)}
    copies = settle(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))

    start = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(n_shards)).cast("int")
    linked = rows.join(copies, "text_key", "left_semi")
    units = settle(linked.groupBy("text_key", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")))
    loads = _loads(units)
    loose = {s: q + int(q * slack) for s, q in quota.items()}
    for _ in range(rounds if loads else 0):
        units, moved = _round(units, _room(loads, loose))
        if not moved:
            break
        units = settle(units)
        loads = _loads(units)
    units = settle(_relieved(units, loads, quota))
    for _ in range(GATHER if loads else 0):
        units, moved = _round(units, _room(_loads(units), quota))
        if not moved:
            break
        units = settle(units)
    loads = _loads(units)

    # Documents of a text take its units in turn. Both sides are cut into parts, so that no key is hot.
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    linked = linked.withColumn("part", part)
    counts = linked.groupBy("text_key", "part").agg(F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("text_key").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("from", F.coalesce(F.sum("held").over(w.orderBy("part")), F.lit(0)))
    ranges = units.withColumn("low", F.coalesce(F.sum("n").over(w.orderBy(F.desc("n"), "shard")), F.lit(0)))
    pieces = counts.join(ranges, "text_key").where(
        (F.col("low") < F.col("from") + F.col("held")) & (F.col("low") + F.col("n") > F.col("from"))
    )
    pieces = pieces.select("text_key", "part", (F.col("low") - F.col("from")).alias("lo"), (F.col("low") + F.col("n") - F.col("from")).alias("hi"), "shard", F.col("n").alias("with"))
    pieces = pieces.groupBy("text_key", "part").agg(F.collect_list(F.struct("lo", "hi", "shard", "with")).alias("pieces"))  # at most one per shard
    mine = Window.partitionBy("text_key", "part").orderBy("doc_id")
    placed = linked.withColumn("nth", F.row_number().over(mine) - 1).join(pieces, ["text_key", "part"]).join(copies, "text_key")
    own = F.filter("pieces", lambda p: (p["lo"] <= F.col("nth")) & (F.col("nth") < p["hi"]))[0]
    placed = placed.select("doc_id", "size", "text_crc32", own["shard"].alias("shard"), (F.col("copies") - own["with"]).alias("cut_links"))

    segments = ranks.segments_for(total)
    free = rows.join(copies, "text_key", "left_anti")
    free = ranks.running(free.withColumn("__all", F.lit(0)), ["__all"], ["doc_id", "text_key"], segments, "nth")
    shard = F.lit(None).cast("int")
    for s, end in reversed(_bounds(_room(loads, quota))):
        shard = F.when(F.col("nth") < end, s).otherwise(shard)
    free = free.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.lit(0).cast("long").alias("cut_links"))

    every = placed.unionByName(free)
    every = ranks.running(every, ["shard"], ["doc_id", "text_crc32", "size"], segments, "slot")
    return every.select(
        F.col("doc_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "cut_links",
    )
