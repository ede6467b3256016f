"""Sharding by balanced label propagation, with DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, salts

SHARDS = 24
ROUNDS = 8


def quotas(wanted: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many linked documents may go from shard a to b in one round, and the free ones left in each shard.

    ``wanted[a, b]`` linked documents in a want to be in b. Shards swap equal
    numbers; what one side wants beyond that is paid for with documents that
    have no links (``free``), which go the other way. So no size ever changes.
    """
    free = free.copy()
    swap = np.minimum(wanted, wanted.T)
    allowed = swap.copy()
    rest = wanted - swap
    for a, b in sorted(zip(*np.nonzero(rest), strict=True), key=lambda ab: (-rest[ab], ab)):
        paid = min(rest[a, b], free[b])
        allowed[a, b] += paid
        free[b] -= paid
        free[a] += paid
    return allowed, free


def label_propagation_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Places every document: ``id_col, size, text_crc32, shard, slot, group_size, start_shard``.

    Documents of equal text are linked. All begin dealt out evenly (counts at
    most one apart). In each round a group's parts move towards the shard that
    holds most of it (the largest few, where it exceeds one shard) under the
    swap quotas above, so the counts stay even and fewer links are cut. State
    is one row for each (group, shard), not for each document, so a group of a
    third of all rows is at most ``shards`` rows. Null texts count as empty;
    rows repeated or without identifier are placed like any other. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.coalesce(F.col(text_col), F.lit(""))
    facts = scratch.table(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"))
    )
    rows = facts.count()
    if not rows:
        return facts.select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("group_size"), F.lit(0).alias("start_shard")
        )
    n = salts(rows)
    salted = facts.withColumn("salt", F.pmod(F.xxhash64("id", "digest"), F.lit(n)).cast("int"))

    # Two-step ranks: inside a salt by a window, across salts by their counts.
    first = Window.partitionBy("salt").orderBy("id", "digest")
    inside = Window.partitionBy("salt", "digest").orderBy("id")
    before = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("salt").count().withColumn("salt_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = scratch.table(
        salted.withColumn("rank", F.row_number().over(first))
        .withColumn("in_group", F.row_number().over(inside))
        .join(F.broadcast(offsets), "salt")  # at most 4096 rows
        .withColumn("start_shard", ((F.col("salt_offset") + F.col("rank") - 1) % shards).cast("int"))
        .drop("salt_offset", "rank")
    )
    scratch.drop(facts)

    of_group = Window.partitionBy("digest")
    fragments = placed.groupBy("digest", F.col("start_shard").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    fragments = scratch.table(fragments.withColumn("total", F.sum("n").over(of_group)).filter("total > 1"))
    begun = np.zeros(shards, dtype=np.int64)
    for shard, count in placed.groupBy("start_shard").count().collect():
        begun[shard] = count
    start_free = begun - per_shard(fragments, "n", shards)
    free = start_free.copy()
    room = int(begun.min())
    for _ in range(rounds):
        moves = wishes(fragments, max(1, room))
        wanted = np.zeros((shards, shards), dtype=np.int64)
        for a, b, m in moves.groupBy("shard", "target").agg(F.sum("m")).collect():
            wanted[a, b] = m
        allowed, left = quotas(wanted, free)
        if not allowed.sum():
            break
        moved = scratch.table(apply_moves(fragments, moves, allowed))
        scratch.drop(fragments)
        fragments, free = moved, left
    return settle(placed, fragments, start_free, free, shards).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "group_size", "start_shard"
    )


def per_shard(df: DataFrame, column: str, shards: int) -> np.ndarray:
    out = np.zeros(shards, dtype=np.int64)
    for shard, total in df.groupBy("shard").agg(F.sum(column)).collect():
        out[shard] = total
    return out


def wishes(fragments: DataFrame, room: int) -> DataFrame:
    """``digest, shard, target, m``: m documents of a fragment want to go to the group's target shard.

    A group larger than a shard aims at as many shards as it needs; each of its
    other fragments picks one of them in turn. Nobody asks for more than the
    target can hold.
    """
    by_size = Window.partitionBy("digest").orderBy(F.desc("n"), F.xxhash64("digest", "shard"))
    ranked = fragments.withColumn("place", F.row_number().over(by_size) - 1).withColumn("homes", F.ceil(F.col("total") / room).cast("int"))
    # Homes that still have room, numbered anew, so that nobody waits for a full one.
    open_ = ranked.filter((F.col("place") < F.col("homes")) & (F.col("n") < room))
    numbered = Window.partitionBy("digest").orderBy("place")
    homes = open_.select("digest", (F.row_number().over(numbered) - 1).alias("home"), F.count(F.lit(1)).over(Window.partitionBy("digest")).alias("open"), F.col("shard").alias("target"), (F.lit(room) - F.col("n")).alias("space"))
    movers = ranked.filter("place >= homes").join(homes.filter("home = 0").select("digest", "open"), "digest")
    movers = movers.withColumn("home", ((F.col("place") - F.col("homes")) % F.col("open")).cast("int")).select("digest", "shard", "n", "home")
    homes = homes.drop("open")
    queue = Window.partitionBy("digest", "home").orderBy("n", "shard").rowsBetween(Window.unboundedPreceding, -1)
    asked = movers.join(homes, ["digest", "home"]).withColumn("taken", F.coalesce(F.sum("n").over(queue), F.lit(0)))
    return asked.withColumn("m", F.least("n", F.col("space") - F.col("taken"))).filter("m > 0").select("digest", "shard", "target", "m")


def apply_moves(fragments: DataFrame, moves: DataFrame, allowed: np.ndarray) -> DataFrame:
    """The fragments after each (from, to) queue has let its quota through, largest moves first."""
    spark = fragments.sparkSession
    quota = spark.createDataFrame([(int(a), int(b), int(allowed[a, b])) for a, b in zip(*np.nonzero(allowed), strict=True)], "shard int, target int, quota long")
    queue = Window.partitionBy("shard", "target").orderBy(F.desc("m"), "digest").rowsBetween(Window.unboundedPreceding, -1)
    passed = (
        moves.join(F.broadcast(quota), ["shard", "target"])  # at most shards * shards rows
        .withColumn("ahead", F.coalesce(F.sum("m").over(queue), F.lit(0)))
        .withColumn("m", F.least("m", F.col("quota") - F.col("ahead")))
        .filter("m > 0")
    )
    change = passed.select("digest", "shard", (-F.col("m")).alias("n")).unionByName(passed.select("digest", F.col("target").alias("shard"), F.col("m").alias("n")))
    both = fragments.select("digest", "shard", "n").unionByName(change).groupBy("digest", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
    return both.withColumn("total", F.sum("n").over(Window.partitionBy("digest")))


def settle(placed: DataFrame, fragments: DataFrame, start_free: np.ndarray, free: np.ndarray, shards: int) -> DataFrame:
    """Gives each document its shard and its slot there."""
    # Linked documents: a group's members are numbered; its fragments are consecutive stretches of those numbers.
    upto = Window.partitionBy("digest").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretches = fragments.withColumn("upto", F.sum("n").over(upto)).groupBy("digest").agg(F.sum("n").alias("group_size"), F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("stretches"))
    before = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("digest", "salt").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0)))
    cells = cells.drop("count").join(stretches, "digest")
    linked = placed.join(cells, ["digest", "salt"], "left")
    number = F.col("ahead") + F.col("in_group")
    with_home = linked.withColumn("home", F.get(F.filter("stretches", lambda s: s["upto"] >= number), F.lit(0))["shard"])

    # Free documents: the last ones of a shard that gave some away fill the shards that took some.
    fewer, more = np.maximum(start_free - free, 0), np.maximum(free - start_free, 0)
    # (from, to, first, last): the free documents numbered first..last of a shard go to another.
    table, need = [], more.copy()
    for a in range(shards):
        at = int(start_free[a] - fewer[a])
        left = int(fewer[a])
        for b in range(shards):
            k = int(min(left, need[b]))
            if k:
                table.append((a, b, at + 1, at + k))
                at, left, need[b] = at + k, left - k, need[b] - k
    spark = placed.sparkSession
    rules = spark.createDataFrame(table, "start_shard int, to int, low long, high long").groupBy("start_shard").agg(F.collect_list(F.struct("to", "low", "high")).alias("rules"))
    single = F.col("home").isNull()
    cell = Window.partitionBy("start_shard", "salt", single).orderBy("id", "digest")
    numbered = with_home.withColumn("single", single).withColumn("k", F.row_number().over(cell))
    ahead = Window.partitionBy("start_shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = with_home.filter(single).groupBy("start_shard", "salt").count().withColumn("free_ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    counts = counts.join(F.broadcast(rules), "start_shard", "left")
    k = F.col("k") + F.col("free_ahead")
    goes = F.get(F.filter("rules", lambda r: (r["low"] <= k) & (k <= r["high"])), F.lit(0))["to"]
    done = numbered.join(counts, ["start_shard", "salt"], "left").withColumn("shard", F.coalesce("home", F.when(F.col("single"), goes), "start_shard"))
    done = done.select("id", "size", "text_crc32", "digest", "shard", "start_shard", "salt", F.coalesce("group_size", F.lit(1)).alias("group_size"))

    inside = Window.partitionBy("shard", "salt").orderBy("id", "digest")
    slots = done.groupBy("shard", "salt").count()
    earlier = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("slot_ahead", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    return done.withColumn("slot", F.row_number().over(inside)).join(slots, ["shard", "salt"]).withColumn("slot", F.col("slot") - 1 + F.col("slot_ahead"))
