"""Sharding by balanced label propagation, with DataFrame operations only.

Documents of equal text are linked: through their group, as a star, never pair by pair. Each starts
in the shard that its id hashes to. In each round the members of a group vote for a shard, and those
elsewhere ask to move to the shard with most of them. What a shard may take is its quota, the room it
has left: requests are added up in a hashed order and granted up to it; what is granted is joined to
the members, which take the shard's label. As members of a group in one shard are alike, a row stands
for all of them: (group, shard, number). Rounds end when nothing moves. A group larger than a shard
fills one after another; others stay whole.

Then sizes are made even. Shards above the mean give up what lies beyond it, which goes to those below
it, so that at most two groups a shard are cut; documents without links fill up what is left, longer
ones first, so that the sizes differ by about one short document.

Orders are exact but never sorted in one task: a hashed order is cut into cells, the cells' sums are
added up, and only cells are sorted. Of all this the driver sees a number for each shard.

A null text has no bytes and is linked with empty ones. A null id is dealt by its row, repeated ids
share their place in the order and repeated rows are linked. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, settle

#: A cell of an order has about so many rows; there are at least CELLS of them.
CELL_ROWS, CELLS = 20_000, 4096
#: While documents move, a shard may hold so much more than the mean.
SLACK = 0.25


def running(rows: DataFrame, by: list[str], weight: Column, cells: int) -> DataFrame:
    """Adds `before`: the sum of weight over the rows of the same `by` that come first in the order of `turn`, a hash. rows is read twice and should be a table."""
    rows = rows.withColumns({"cell": F.shiftright(F.shiftrightunsigned("turn", 33) * F.lit(max(1, cells)), 31), "weight": weight})
    upto = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "cell").agg(F.sum("weight").alias("weight"))
    sums = sums.select(*by, "cell", F.coalesce(F.sum("weight").over(upto), F.lit(0)).alias("base"))
    ties = [c for c in ("id", "crc", "size") if c in rows.columns]
    within = Window.partitionBy(*by, "cell").orderBy("turn", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*by, "cell"])
    return rows.withColumn("before", F.col("base") + F.coalesce(F.sum("weight").over(within), F.lit(0))).drop("cell", "weight", "base")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard, of rows (shard, size, n)."""
    found = {r["shard"]: r["load"] for r in rows.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _of_shard(values: list, shard: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), shard)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "shard").agg(F.max("size").alias("size"), F.sum("n").alias("n")).where("n > 0")


def propagate(state: DataFrame, shards: int, quota: int, cells: int, rounds: int = 24) -> DataFrame:
    """Moves members of groups, rows (grp, shard, size, n), to where most of their group are, as far as shards of `quota` bytes have room.

    A group asks for the shard of most members among those with room for all the others, or for the
    emptiest one; it moves as a whole or not at all. One too large for these asks for the shard of
    most members that has any room, for those in shards of fewer, and takes what it gets.
    """
    for _ in range(rounds):
        room = [quota - x for x in _loads(state, shards)]
        vote = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
        groups = state.groupBy("grp").agg(F.max("size").alias("size"), F.sum("n").alias("all"), F.collect_list(vote).alias("votes"))
        emptiest = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("tie"), F.lit(room.index(max(room))).alias("shard"))
        votes = F.array_append("votes", emptiest)
        with_room = lambda docs: F.array_max(F.filter(votes, lambda v: _of_shard(room, v["shard"]) >= docs(v) * F.col("size")))
        groups = groups.withColumn("best", with_room(lambda v: F.col("all") - v["n"]))
        groups = groups.withColumns({"large": F.col("best").isNull(), "best": F.coalesce("best", with_room(lambda v: F.lit(1)))})
        leaving = F.filter("votes", lambda v: F.when(F.col("large"), v < F.col("best")).otherwise(v["shard"] != F.col("best.shard")))
        asks = groups.select("grp", "size", "large", "best", F.col("best.shard").alias("goal"), F.xxhash64("grp").alias("turn"), F.aggregate(leaving, F.lit(0).cast("long"), lambda a, v: a + v["n"]).alias("wanted"))
        asks = settle(asks.where("best is not null and wanted > 0"), "shard-asks")
        left = _of_shard(room, F.col("goal")) - F.col("before")
        granted = F.when(left >= F.col("wanted") * F.col("size"), F.col("wanted")).when(F.col("large"), F.greatest(F.floor(left / F.col("size")), F.lit(0)))
        asks = running(asks, ["goal"], F.col("wanted") * F.col("size"), cells).withColumn("granted", granted.cast("long")).where("granted > 0")
        moves = state.join(asks.select("grp", "large", "best", "goal", "granted"), "grp").where((F.col("shard") != F.col("goal")) & (~F.col("large") | (vote < F.col("best"))))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        moves = moves.withColumn("moved", F.least("n", F.greatest(F.col("granted") - earlier, F.lit(0)))).where("moved > 0")
        moves = settle(moves.select("grp", "size", "shard", "goal", "moved"), "shard-moves")
        if moves.isEmpty():
            return state
        out = moves.select("grp", "shard", "size", (-F.col("moved")).alias("n"))
        into = moves.select("grp", F.col("goal").alias("shard"), "size", F.col("moved").alias("n"))
        new = settle(_merged(state.select("grp", "shard", "size", "n").unionByName(out).unionByName(into)), "shard-state")
        discard(state, moves)
        state = new
    return state


def _ends(room: list[float], total: int, spread: bool) -> list[float]:
    """Where each shard's part of `total` bytes ends, without the last: in proportion to its room (spread), or one room filled after the other, all stretched if they are too small."""
    room = [max(0.0, x) for x in room]
    scale = total / sum(room) if sum(room) > 0 else 0.0
    return [x * (scale if spread else max(1.0, scale)) for x in itertools.accumulate(room)][:-1]


def even_out(state: DataFrame, shards: int, mean: float, cells: int) -> DataFrame:
    """Takes from shards above the mean what lies beyond it, whole groups but for the last, and gives it to those below."""
    load = _loads(state, shards)
    if max(load) <= mean:
        return state
    over = settle(state.where(_of_shard(load, F.col("shard")) > mean).withColumn("turn", F.xxhash64("grp", "shard")), "shard-over")
    kept = F.least("n", F.greatest(F.floor((F.lit(mean) - F.col("before")) / F.col("size")), F.lit(0)))
    over = running(over, ["shard"], F.col("n") * F.col("size"), cells).withColumn("n", (F.col("n") - kept).cast("long")).where("n > 0").drop("before")
    over = settle(over, "shard-over")
    ends = _ends([mean - x for x in load], over.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0, spread=False)
    # How many of a row's documents have their middle before an end; the difference of two ends is a shard's part.
    first = lambda end: F.least(F.col("n"), F.greatest(F.lit(0), F.ceil((F.lit(end) - F.col("before")) / F.col("size") - 0.5))).cast("long")
    upto_end = [*map(first, ends), F.col("n")]
    parts = [F.struct(F.lit(s).alias("shard"), (upto_end[s] - (upto_end[s - 1] if s else F.lit(0))).alias("n")) for s in range(shards)]
    given = running(over, [], F.col("n") * F.col("size"), cells).select("grp", "size", F.explode(F.filter(F.array(*parts), lambda p: p["n"] > 0)).alias("p"))
    given = given.select("grp", "p.shard", "size", "p.n")
    out = over.select("grp", "shard", "size", (-F.col("n")).alias("n"))
    return settle(_merged(state.select("grp", "shard", "size", "n").unionByName(out).unionByName(given)), "shard-state")


def _fill(rows: DataFrame, room: list[float], cells: int) -> DataFrame:
    """Adds `shard` to a table of documents (size, turn, ...), each shard getting bytes in proportion to its room."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    ends = _ends(room, total, spread=True)
    middle = F.col("before") + F.col("size") / 2
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= middle)) if ends else F.lit(0)
    return running(rows, [], F.col("size"), cells).withColumn("shard", shard).drop("before")


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, size (bytes of the text plus 8), text_crc32, shard and slot, its place in the shard from 0 on without gaps."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.monotonically_increasing_id())
    items = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("grp"), F.xxhash64(key).alias("turn"))
    items = settle(items, "shard-items")
    count, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean, cells = total / shards, max(CELLS, count // CELL_ROWS)
    per_shard = max(1, cells // shards)
    start = items.groupBy("grp", F.pmod("turn", F.lit(shards)).cast("int").alias("shard")).agg(F.max("size").alias("size"), F.count("*").alias("n"))
    linked = start.groupBy("grp").agg(F.collect_list(F.struct("shard", "size", "n")).alias("rows"), F.sum("n").alias("all")).where("all > 1")
    state = settle(linked.select("grp", F.inline("rows")), "shard-state")
    state = even_out(propagate(state, shards, int(mean * (1 + SLACK)), per_shard), shards, mean, per_shard)

    homes = state.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("homes"))
    items = settle(items.join(homes, "grp", "left"), "shard-homes")
    whole = items.where(F.size("homes") == 1).withColumn("shard", F.col("homes")[0]["shard"])
    # Members of a cut group are dealt to its shards by their place in the group.
    parted = settle(items.where(F.size("homes") > 1), "shard-parted")
    passed = F.aggregate("homes", F.struct(F.lit(-1).alias("shard"), F.lit(0).cast("long").alias("upto")), lambda a, h: F.when(a["upto"] > F.col("before"), a).otherwise(F.struct(h["shard"].alias("shard"), (a["upto"] + h["n"]).alias("upto"))))
    parted = running(parted, ["grp"], F.lit(1).cast("long"), per_shard).withColumn("shard", passed["shard"]).drop("before")
    cols = ["id", "size", "crc", "turn", "shard"]
    placed = settle(whole.select(cols).unionByName(parted.select(cols)), "shard-placed")
    alone = items.where("homes is null").select(cols[:-1])
    load = _loads(placed.withColumn("n", F.lit(1)), shards)
    short = F.col("size") <= (total / count if count else 0)
    for part in (~short, short):
        some = settle(_fill(settle(alone.where(part), "shard-alone"), [mean - x for x in load], cells), "shard-filled")
        load = [a + b for a, b in zip(load, _loads(some.withColumn("n", F.lit(1)), shards), strict=True)]
        placed = placed.unionByName(some.select(cols))
    out = running(settle(placed, "shard-placed"), ["shard"], F.lit(1).cast("long"), per_shard)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("before").cast("long").alias("slot"))
