"""Captured events at rest: coverage of sequence numbers, bounded retention, complete snapshots, stale summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def producer_coverage(sent: DataFrame) -> DataFrame:
    """producer, head, contiguous_through, n_gaps, n_missing, n_duplicates of (producer, sequence), numbers from 1."""
    numbers = sent.groupBy("producer", "sequence").agg(F.count("*").alias("times"))
    before = F.coalesce(F.lag("sequence").over(Window.partitionBy("producer").orderBy("sequence")), F.lit(0))
    gaps = numbers.withColumn("before", before).withColumn("missing", F.col("sequence") - F.col("before") - 1)
    first_gap = F.min(F.when(F.col("missing") > 0, F.col("before")))
    return gaps.groupBy("producer").agg(
        F.max("sequence").alias("head"), F.coalesce(first_gap, F.max("sequence")).alias("contiguous_through"), F.count_if(F.col("missing") > 0).alias("n_gaps"),
        F.sum("missing").alias("n_missing"), F.sum(F.col("times") - 1).alias("n_duplicates"),
    )


def retained(events: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The last `most` rows of each group, and dropped_before: cursors under it have expired (null if nothing was dropped)."""
    last = events.withColumn("age", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("age") <= most + 1)
    low = F.when(F.max("age").over(Window.partitionBy(group)) > most, F.min(F.when(F.col("age") <= most, F.col(order))).over(Window.partitionBy(group)))
    return last.withColumn("dropped_before", low).where(F.col("age") <= most)


def complete(frames: DataFrame, group: str, position: str) -> DataFrame:
    """The group, n_frames and complete: positions are 0, 1, 2 and so on, each once."""
    sums = frames.groupBy(group).agg(F.count("*").alias("n_frames"), F.count_distinct(position).alias("k"), F.min(position).alias("low"), F.max(position).alias("high"))
    return sums.select(group, "n_frames", ((F.col("k") == F.col("n_frames")) & (F.col("low") == 0) & (F.col("high") == F.col("n_frames") - 1)).alias("complete"))


def freshness(sources: DataFrame, owner: str, dirty: Column) -> DataFrame:
    """owner, n_sources, n_dirty, status: a summary is stale when any row that it stands on is dirty."""
    sums = sources.groupBy(owner).agg(F.count("*").alias("n_sources"), F.count_if(dirty).alias("n_dirty"))
    return sums.withColumn("status", F.when(F.col("n_dirty") > 0, "stale").otherwise("current"))


def best_per_facet(candidates: DataFrame, facet: str, confidence: str, utility: str, key: str) -> DataFrame:
    """facet, key of its best candidate: most confidence, then most utility, then the smallest key."""
    return candidates.groupBy(facet).agg(F.max_by(key, F.struct(confidence, utility, -F.col(key))).alias(key))


def missing_facets(wanted: DataFrame, candidates: DataFrame, facet: str) -> DataFrame:
    """Wanted facets without a candidate, each as an unknown block."""
    return wanted.join(candidates, facet, "left_anti").select(facet, F.lit("unknown").alias("block"))


def digest_chain(records: DataFrame) -> DataFrame:
    """user_id, event_id, link of `records` (user_id, event_id, record): link = H(link before + H(record)), by event_id within each user.

    Each user's rows are in one partition, in order, and pass by once: only the last digest is held, however many there are.
    """
    own = F.sha2(F.col("record").cast("binary"), 256).alias("own")
    ordered = records.select("user_id", "event_id", own).repartition("user_id").sortWithinPartitions("user_id", "event_id")

    def run(batches):
        import hashlib

        import pyarrow as pa

        user, link = None, ""
        for batch in batches:
            links = []
            for u, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                user, link = u, hashlib.sha256(((link if u == user else "") + own).encode()).hexdigest()
                links.append(link)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.string())], names=["user_id", "event_id", "link"])

    return ordered.select("user_id", "event_id", "own").mapInArrow(run, "user_id long, event_id long, link string")
