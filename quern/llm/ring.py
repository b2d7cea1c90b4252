"""Operator 3: sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring of 64-bit positions holds `vnodes` points of every shard. A row's place is a hash of its doc_id; its
home is the shard of the next point clockwise. A shard takes no more than its bound; rows that overflow go on
clockwise to the next shard with room. With the bounds n // shards, one more for the first n % shards shards,
counts differ by one at most (law `rows`), and a row leaves its home only if that is full.

Which rows of an arc overflow is a matter of counts: the counts of the arcs (shards x vnodes numbers, whatever
the size of the corpus) are walked around the ring on the driver, which gives for every arc a list of runs
(rows a to b of the arc go to shard s, from slot t on). Rows get their rank within their arc and look their
run up. An arc may hold many rows (all null ids are on one): equal rows are counted before they are ranked, others ranked in parts.
No text is shuffled, and no row is collected.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LAW = "rows"
#: Parts in which the rows of an arc are ranked, and equal rows that are made again in one go.
PARTS, CHUNK = 64, 100_000


def _points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; positions are signed 64-bit."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big", signed=True)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def flow(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first, last, shard, slot) for the arcs in clockwise order; ranks and slots count from 0.

    Rows stay at home while there is room, in the arcs' order; what is left over goes on clockwise from its
    arc to the next shard with room.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    runs, over = [], []

    def put(arc: int, first: int, n: int, shard: int) -> None:
        runs.append((arc, first, first + n - 1, shard, slot[shard]))
        room[shard] -= n
        slot[shard] += n

    for arc, (n, home) in enumerate(zip(counts, owners)):
        if k := min(n, room[home]):
            put(arc, 0, k, home)
        if n > k:
            over.append((arc, k, n - k))
    for arc, first, n in over:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            if k := min(n, room[owners[at]]):
                put(arc, first, k, owners[at])
                first, n = first + k, n - k
    return runs


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    size is the text's UTF-8 bytes plus 1 (null text: 1, and the checksum of nothing). Rows with a null or a
    repeated doc_id are placed like any others, each row once. Slots are gapless in each shard. An empty table gives an
    empty result; further columns are ignored. Equal texts are not kept together: under this law a group may
    exceed a shard.
    """
    spark = docs.sparkSession
    points = _points(shards, vnodes)
    owners = [s for _, s in points]
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    # Arc of a position: the number of points below it, past the last one the first again. Found by the position's
    # leading byte and a search in the short list that this byte leaves.
    place = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place"))
    edges = [bisect.bisect_left(points, (b << 56, -1)) for b in range(-128, 129 - 1)] + [len(points)]
    lists = F.array(*[F.array(*[F.lit(p) for p, _ in points[edges[i] : edges[i + 1]]]).cast("array<bigint>") for i in range(256)])
    starts = F.array(*[F.lit(e) for e in edges[:256]])
    byte = (F.shiftright("place", 56) + 128).cast("int")
    below = F.size(F.filter(F.get(lists, byte), lambda p: p < F.col("place")))
    rows = rows.withColumn("arc", ((F.get(starts, byte) + below) % len(points)).cast("int"))
    same = ["arc", "place", "doc_id", "text_crc32", "size"]
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int").alias("part")
    groups = cut(rows.groupBy(*same).agg(F.count("*").alias("many")).select("*", part), "ring")
    counts = groups.groupBy("arc", "part").agg(F.sum("many").alias("n"))
    counted = {r.arc: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    runs = flow([counted.get(a, 0) for a in range(len(points))], owners, shards)
    # At most one run for each arc and, over all arcs, one more for each time that a shard fills up.
    table = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)], "arc int, first long, last long, shard int, base long")
    before = counts.select("arc", "part", (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("many").over(Window.partitionBy("arc", "part").orderBy("place", "doc_id", "text_crc32", "size"))
    ranked = groups.withColumn("inside", inside - F.col("many")).join(F.broadcast(before), ["arc", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    # Equal rows are made again: at most CHUNK by one task at a time.
    ones = ranked.where("many = 1").select(*same, "rank")
    starts_ = ranked.where("many > 1").select(*same, "many", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(CHUNK).cast("long"))).alias("at")).repartition("arc", "doc_id", "at")
    again = starts_.select(*same, "rank", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK, F.col("many")) - 1)).alias("i")).select(*same, (F.col("rank") + F.col("i")).alias("rank"))
    placed = ones.unionByName(again).alias("r").join(F.broadcast(table).alias("t"), F.expr("r.arc = t.arc and r.rank between t.first and t.last"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.get(F.array(*[F.lit(o) for o in owners]), F.col("r.arc")).alias("home_shard"))
