"""Sharding by balanced label propagation over groups of equal texts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, ROUNDS, LUCK, SEED, ROWS_PER_BUCKET, HOT = 16, 6, 1024, 3, 50_000, 1000


def propagate(nodes: DataFrame, hot: DataFrame, cap: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Move linked documents (doc_id, size, group, shard, weight of group) to their neighbours' shards.

    In each round a group wants the shard, of those that still have room, that holds most of its bytes.  Those who want to
    move queue up in seeded order, groups as a whole, and documents one by one where a group is large against a shard;
    of the queue as much moves as the shard's quota has room for.  Documents in full shards stay, so a group that no
    shard can hold fills one after another.  All that leaves the executors is the load of each shard.  ``hot`` has the
    groups of more than a thousandth of all rows, so a thousand at most: their rows are told by broadcast where to go.
    """
    big = F.col("group_bytes") > cap / 16
    turn = F.pmod(F.when(big, F.xxhash64("doc_id", F.lit(SEED))).otherwise(F.xxhash64("group", F.lit(SEED))), F.lit(LUCK)).cast("int")
    nodes = cut(nodes.withColumn("turn", turn).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "group", "left").fillna({"hot": False}))
    for _ in range(rounds):
        load = {r["shard"]: r["b"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("b")).collect()}  # at most one row for each shard
        room = [max(0.0, cap - load.get(s, 0)) for s in range(shards)]
        free = [s for s in range(shards) if room[s] > cap / 64]
        if not free:
            break
        cells = nodes.where(F.col("shard").isin(free)).groupBy("group", "shard").agg(F.sum("size").alias("b"))
        wish = cells.groupBy("group").agg(F.max_by("shard", F.struct("b", -F.col("shard"))).alias("wish"), F.count(F.lit(1)).alias("cells")).where("cells > 1")
        wish = cut(wish.select("group", "wish"))
        large = nodes.where("hot").join(F.broadcast(wish.join(F.broadcast(hot), "group", "left_semi")), "group", "left")
        asked = large.unionByName(nodes.where("not hot").join(wish, "group", "left")).withColumn("asks", F.coalesce(F.col("shard").isin(free) & (F.col("wish") != F.col("shard")), F.lit(False)))
        queue = asked.where("asks").groupBy("wish", "turn").agg(F.sum("size").alias("b"))
        upto = F.sum("b").over(Window.partitionBy("wish").orderBy("turn"))
        space = F.element_at(F.array(*map(F.lit, room)), F.col("wish") + 1)
        let = queue.withColumn("upto", upto).where(F.col("upto") <= space).select(F.col("wish").alias("to"), F.col("turn").alias("let"))  # shards x LUCK rows at most
        moved = asked.join(F.broadcast(let), F.col("asks") & (F.col("wish") == F.col("to")) & (F.col("turn") == F.col("let")), "left")
        moved = cut(moved.select(*[c for c in nodes.columns if c != "shard"], F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved")))
        nodes, any_moved = moved.drop("moved"), not moved.where("moved").isEmpty()
        if not any_moved:
            break
    return nodes


def _dealt(rows: DataFrame, buckets: int, by: list[str], seed: int) -> DataFrame:
    """Add ``bucket`` by seeded hash, so that running sums never need one task for all rows."""
    return rows.withColumn("order", F.xxhash64(*by, F.lit(seed))).withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes and one; a null text has none and groups with empty ones.  Documents start by hash;
    those of equal texts are linked and propagate (see :func:`propagate`).  Then what has no link, and what a shard holds
    beyond its quota, fills all shards up to equal bytes, but for about one document.  Slots count from 0 within a shard.
    Rows without doc_id are placed by the rest of the row; repeated rows each get a slot; extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ))
    n, total = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    cap = (total or 0) / shards
    base = base.withColumn("group", F.xxhash64("h", "text_crc32", "size")).drop("h")
    groups = base.groupBy("group").agg(F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = cut(groups)
    hot = groups.where(F.col("members") > max(HOT, (n or 0) / 1000)).select("group")
    told = groups.select("group", "group_bytes")
    few = base.join(F.broadcast(told.join(F.broadcast(hot), "group", "left_semi")), "group")
    rest = base.join(F.broadcast(hot), "group", "left_anti")
    linked = few.unionByName(rest.join(told.join(F.broadcast(hot), "group", "left_anti"), "group")).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(shards)).cast("int"))
    linked = propagate(linked.select("doc_id", "size", "text_crc32", "group", "group_bytes", "shard"), hot, cap, shards, rounds)
    # What a shard holds beyond its quota goes back to the pool.
    over = linked.groupBy("shard", "turn").agg(F.sum("size").alias("b")).withColumn("upto", F.sum("b").over(Window.partitionBy("shard").orderBy("turn")))
    over = over.where(F.col("upto") > cap).select(F.col("shard").alias("s"), F.col("turn").alias("t"))
    linked = cut(linked.join(F.broadcast(over), (F.col("shard") == F.col("s")) & (F.col("turn") == F.col("t")), "left"))
    held = linked.where("s is null").select("doc_id", "size", "text_crc32", "shard")
    singles = rest.join(groups, "group", "left_anti").select("doc_id", "size", "text_crc32")
    pool = singles.unionByName(linked.where("s is not null").select("doc_id", "size", "text_crc32"))
    load = {r["shard"]: r["b"] for r in held.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    ends, at = [], 0.0
    for s in range(shards):
        at += max(0.0, cap - load.get(s, 0))
        ends.append(at)
    buckets = max(64, -(-(n or 0) // rows_per_bucket))
    placed = cut(held.unionByName(_filled(_dealt(pool, buckets, ["doc_id", "size", "text_crc32"], SEED + 1), ends)))
    # The pool's buckets went to shards in their order, so slots are dealt anew: a shard has rows in all buckets.
    return _slots(_dealt(placed, buckets, ["doc_id", "size", "text_crc32"], SEED + 2))


def _filled(pool: DataFrame, ends: list[float]) -> DataFrame:
    """A document goes to the shard in whose stretch of the pool's bytes its middle lies."""
    pool = cut(pool)
    sums = pool.groupBy("bucket").agg(F.sum("size").alias("b")).withColumn("before", F.sum("b").over(Window.orderBy("bucket")) - F.col("b"))
    run = F.sum("size").over(Window.partitionBy("bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("before") + run - F.col("size") / 2
    place: Column = sum((F.when(F.col("middle") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    return pool.join(sums.select("bucket", "before"), "bucket").withColumn("middle", middle).select("doc_id", "size", "text_crc32", place.cast("int").alias("shard"))


def _slots(placed: DataFrame) -> DataFrame:
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    first = counts.select("shard", "bucket", first.alias("first"))
    turn = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size", "text_crc32"))
    return placed.join(first, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + turn - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
