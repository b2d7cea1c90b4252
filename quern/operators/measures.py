"""Reports over groups: nearest-rank percentiles without a group in one task, ratios, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins between the least and the greatest value of a group in the first pass.
BINS = 4096


def percentiles(rows: DataFrame, group: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """The group, n, and p<percent> for each: the value of rank (n * percent + 99) div 100, nulls left out.

    Two passes. Values are counted by bins first (a count for each bin and group, combined before the shuffle); then only the rows of the bins
    that hold a wanted rank are ranked, each bin by itself.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    spread = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (BINS - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(F.broadcast(ends), group).withColumn("_bin", spread)
    counts = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_m"), F.max("n").alias("n"))
    upto = F.sum("_m").over(Window.partitionBy(*group).orderBy("_bin"))
    wanted = counts.withColumn("_before", upto - F.col("_m")).withColumn("_p", F.explode(F.array(*map(F.lit, percents)))).withColumn("_rank", F.call_function("div", F.col("n") * F.col("_p") + 99, F.lit(100)) - F.col("_before"))
    wanted = wanted.where((F.col("_rank") > 0) & (F.col("_rank") <= F.col("_m"))).select(*group, "_bin", "_p", "_rank")
    few = binned.join(F.broadcast(wanted.select(*group, "_bin").distinct()), [*group, "_bin"], "left_semi")
    ranked = few.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_bin").orderBy("_v")))
    hit = ranked.join(F.broadcast(wanted), [*group, "_bin"]).where("_at = _rank")
    return hit.groupBy(*group).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents))


def ratio(part: Column, of: Column, scale: int = 10_000) -> Column:
    """part * scale div of, whole numbers; null if there is nothing."""
    return F.when(of > 0, F.call_function("div", part * scale, of))


def compare(baseline: DataFrame, candidate: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """key, baseline, candidate, verdict: better, same, worse (by more than `tolerance` of the baseline; more is worse), added or removed."""
    both = baseline.select(key, F.col(value).alias("baseline")).join(candidate.select(key, F.col(value).alias("candidate")), key, "full_outer")
    verdict = F.when(F.col("baseline").isNull(), "added").when(F.col("candidate").isNull(), "removed").when(F.col("candidate") > F.col("baseline") * (1 + tolerance), "worse").when(F.col("candidate") < F.col("baseline") * (1 - tolerance), "better").otherwise("same")
    return both.withColumn("verdict", verdict)


def merkle_root(leaves: DataFrame, order: str, leaf: str) -> DataFrame:
    """root: the root of a binary tree over the leaves in order; a last one without a partner goes up as it is. No leaves give none.

    Each round halves the table: numbered leaves are grouped by half their number, so that no task holds more than its share.
    """
    from ..sources.steps import settle

    ordered = leaves.select(order, leaf).orderBy(order)
    counts = leaves.count()
    level = settle(ordered.withColumn("_m", F.monotonically_increasing_id()), "leaves")
    # Numbers without gaps: the place in its part, and the rows of the parts before it.
    parts = level.groupBy(F.shiftright("_m", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    level = level.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), F.col(leaf).alias("h"))
    while counts > 1:
        pairs = level.groupBy(F.call_function("div", F.col("i"), F.lit(2)).alias("j")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("b"))
        level = settle(pairs.select(F.col("j").alias("i"), F.when(F.col("b").isNull(), F.col("a")).otherwise(F.sha2(F.concat(F.lit("node\u0000"), "a", "b"), 256)).alias("h")), "level")
        counts = (counts + 1) // 2
    return level.select(F.col("h").alias("root"))


def overlaps(pairs: list[tuple[str, str]]) -> Column:
    """How many of several pairs of array columns share an element."""
    return reduce(lambda a, b: a + b, (F.when(F.arrays_overlap(a, b), 1).otherwise(0) for a, b in pairs))
