"""States of slots from the claims that survive: known, in conflict, unknown; alternatives and their support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import overlap_join

MICRO, CAP = 1_000_000, 999_999


def truth_state(claims: DataFrame) -> DataFrame:
    """subject, predicate, state, n_values: no surviving value is unknown, one is known, more are a conflict."""
    values = claims.groupBy("subject", "predicate").agg(F.count_distinct(F.when(~F.col("negative"), F.col("object"))).alias("n_values"))
    state = F.when(F.col("n_values") == 0, "unknown").when(F.col("n_values") == 1, "known").otherwise("conflict")
    return values.select("subject", "predicate", state.alias("state"), "n_values")


def noisy_or(strengths: Column | str) -> Column:
    """1 - product of (1 - p) in whole millionths, each factor cut down, in the array's order, capped."""
    left = F.aggregate(strengths, F.lit(MICRO).cast("long"), lambda acc, p: ((acc * (F.lit(MICRO) - p) - (acc * (F.lit(MICRO) - p)) % MICRO) / MICRO).cast("long"))
    return F.least(F.lit(MICRO) - left, F.lit(CAP).cast("long"))


def alternatives(claims: DataFrame) -> DataFrame:
    """A row for each object of a slot: claims, families, shared validity and support (the best of each family, noisy-or)."""
    best = claims.where(~F.col("negative")).groupBy("subject", "predicate", "object", "family").agg(F.max("confidence").alias("best"), F.count("*").alias("n"), F.max("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"))
    grouped = best.groupBy("subject", "predicate", "object").agg(F.sort_array(F.collect_list(F.struct("family", "best"))).alias("f"), F.sum("n").alias("n_claims"), F.max("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"))
    return grouped.select("subject", "predicate", "object", "n_claims", F.size("f").alias("n_families"), noisy_or(F.transform("f", lambda x: x["best"])).alias("support"), "valid_from", "valid_to")


def conflicts(claims: DataFrame, width: int) -> DataFrame:
    """Pairs of claims of a slot with different objects whose validity overlaps, each once, by bins of `width` (ends not null)."""
    rows = claims.where(~F.col("negative")).select("subject", "predicate", F.col("claim_id").alias("id"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"), "object")
    pairs = overlap_join(rows.drop("object"), rows.drop("object"), ["subject", "predicate"], width).where("l_id < r_id")
    of = lambda end: rows.select(F.col("id").alias(f"{end}_id"), F.col("object").alias(f"{end}_object"))
    both = pairs.join(of("l"), "l_id").join(of("r"), "r_id").where("l_object <> r_object")
    return both.select("subject", "predicate", F.col("l_id").alias("claim_id_a"), F.col("r_id").alias("claim_id_b"))


def promotion(kind: Column, asserted: Column, primary: Column, families: Column, trust: Column, ambiguity: Column, classification: Column) -> Column:
    """How ready a proposal is, from 0 to 1: explicitness, use to come, trust and corroboration, less ambiguity and sensitivity."""
    explicit = F.when(asserted, 1.0).when(primary > 0, 0.65).otherwise(0.15)
    use = F.when(kind.isin("boundary", "correction", "commitment"), 1.0).when(kind.isin("goal", "claim"), 0.8).when(kind.isin("preference", "relationship"), 0.72).when(kind == "summary", 0.65).otherwise(0.55)
    support = F.when(families == 0, 0.0).when(families == 1, 0.35).when(families == 2, 0.75).otherwise(1.0)
    sensitive = F.when(classification == 0, 0.0).when(classification == 1, 0.05).when(classification == 2, 0.15).otherwise(0.3)
    raw = 0.3 * explicit + 0.2 * use + 0.3 * trust + 0.2 * support - 0.2 * ambiguity - 0.1 * sensitive
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def resolve(claims: DataFrame, at: int, complete: Column) -> DataFrame:
    """subject, predicate, state (incomplete, unknown, known, conflict), valid_until, of known claims (negative ones take an object off) at a time."""
    slot = ["subject", "predicate"]
    ends = F.when(F.col("valid_from") > at, F.col("valid_from")).when(F.col("valid_to") > at, F.col("valid_to"))
    until = claims.groupBy(*slot).agg(F.min(ends).alias("valid_until"))
    gone = claims.where(F.col("negative") & (F.col("valid_from") <= at)).select(*slot, "object").distinct()
    live = claims.where(~F.col("negative") & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.lit(at) < F.col("valid_to")))).join(gone, [*slot, "object"], "left_anti")
    n = live.groupBy(*slot).agg(F.count_distinct("object").alias("n"))
    state = F.when(~complete, "incomplete").when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "known").otherwise("conflict")
    return until.join(n, slot, "left").select(*slot, state.alias("state"), "valid_until")
