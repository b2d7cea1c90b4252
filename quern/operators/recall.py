"""Deterministic recall: a gate, what time and perspective show, eight routes, fusion, activation, selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..sources.steps import settle

# What a query says if it speaks of memory, of something vague, of time, of us.
SAYS = {
    "explicit_memory_language": ("remember", "recall", "memory", "помнишь", "вспомни", "раньше", "тогда"),
    "vague_reference": ("это", "этот", "эта", "там", "он", "она", "they", "it", "that"),
    "temporal_language": ("when", "before", "after", "когда", "раньше", "прошл"),
    "relationship_intent": ("we", "us", "our", "together", "мы", "нам", "наш", "вместе"),
}
MANDATORY = ("required", "explicit", "implicit_continuity", "associative", "relational", "historical", "forensic")


def gate(query: Column, mode: str = "auto", referent: Column | None = None, topic: Column | None = None) -> Column:
    """A struct of run, depth, reasons for each query: whether memory is read, and how deep."""
    q = text.normalize(query)
    none = F.lit(False)
    said = lambda name: q.rlike("|".join(SAYS[name]))
    referent, topic = (c if c is not None else none for c in (referent, topic))
    found = {
        "required_by_caller": F.lit(mode in ("required", "explicit")), "explicit_memory_language": said("explicit_memory_language"), "vague_reference": said("vague_reference") | (F.size(F.split(q, " ")) <= 3),
        "active_referent": referent, "active_topic": topic, "temporal_language": said("temporal_language"), "historical_intent": F.lit(mode in ("historical", "forensic")), "relationship_intent": F.lit(mode == "relational") | said("relationship_intent"),
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())))
    run = F.lit(mode in MANDATORY) | (F.lit(mode in ("auto", "optional")) & (F.size(reasons) > 0)) if mode != "never" else none
    deep = F.lit("deep") if mode in ("historical", "forensic") else F.when(found["vague_reference"] & referent, "standard").otherwise("hot")
    return F.struct(run.alias("run"), F.when(~run, "none").otherwise(deep).alias("depth"), reasons.alias("reasons"))


def visible(mode: str, commit: Column, now: Column | None = None, during: tuple[int, int] | None = None, history: bool = False) -> Column:
    """Whether a fact (tx_from, tx_to, valid_from, valid_to, conflict) shows: at a commit, now or during a range; losers of conflicts in history only."""
    known = (F.col("tx_from") <= commit) & (F.col("tx_to").isNull() | (commit < F.col("tx_to")))
    open_end = F.col("valid_to").isNull()
    valid = F.lit(True)
    if mode == "current":
        valid = F.col("valid_from").isNull() | ((F.col("valid_from") <= now) & (open_end | (now < F.col("valid_to"))))
    elif mode in ("valid_during", "bitemporal"):
        valid = F.col("valid_from").isNull() | ((F.col("valid_from") < during[1]) & (open_end | (F.lit(during[0]) < F.col("valid_to"))))
    return known & valid & (F.lit(history) | ~F.col("conflict").isin("superseded", "resolved_loser"))


def perspective(subjects: Column, names: Column, participants: tuple[str, ...], query: str) -> Column:
    """No subject, one of the participants, or a name that the query holds."""
    said = " ".join("".join(c if c.isalnum() else " " for c in query.lower()).split())
    named = F.exists(names, lambda n: (text.normalize(n) != "") & F.contains(F.lit(said), text.normalize(n)))
    return (F.size(subjects) == 0) | F.arrays_overlap(subjects, F.array(*map(F.lit, participants))) | named


def use_decision(influence: Column, personal: Column, shared: Column, constraint_only: Column, style_only: Column, mention: Column, explicit: bool, external_denied: Column | None = None) -> Column:
    """How a document may be used: withheld for privacy or uncertainty, as a constraint or a style only, mentioned or silently."""
    deny = (influence == "deny") | (external_denied if external_denied is not None else F.lit(False))
    said = F.when(mention & F.lit(explicit), "mention").otherwise("silently")
    return F.when(deny, "withhold_privacy").when(influence == "conditional", "withhold_uncertainty").when(personal & ~shared & F.lit(not explicit), "withhold_privacy").when(constraint_only, "only_constraint").when(style_only, "only_style").otherwise(said)


def alias_strength(name: Column, query: Column) -> Column:
    """Millionths: the query is the name, holds it, or is held by it."""
    return F.when(query == name, 1_000_000).when((name != "") & F.contains(query, name), 900_000).when((query != "") & F.contains(name, query), 700_000).otherwise(0).cast("long")


def fused(routes: DataFrame) -> DataFrame:
    """id, rrf, strength, n_routes from (route, id, strength): ranks by strength, then id, in each route, and reciprocal-rank fusion in whole numbers.

    Ranks of a long route are found by ranges of strength, not in one task: see ranked().
    """
    return ranked(routes).groupBy("id").agg(F.sum(numbers.rrf("route", "rank")).alias("rrf"), F.max("strength").alias("strength"), F.count("*").alias("n_routes"))


def ranked(routes: DataFrame) -> DataFrame:
    """`routes` and rank (from 1). Equal strengths are counted first; a row's rank is what is stronger and its place among its equals."""
    counts = routes.groupBy("route", "strength").agg(F.count("*").alias("m"))
    before = counts.select("route", "strength", (F.sum("m").over(Window.partitionBy("route").orderBy(F.desc("strength"))) - F.col("m")).alias("before"))
    place = F.row_number().over(Window.partitionBy("route", "strength").orderBy("id"))
    return routes.withColumn("place", place).join(before, ["route", "strength"]).select("route", "id", "strength", (F.col("before") + F.col("place")).alias("rank"))


def spread(scores: DataFrame, relations: DataFrame, hops: int, frontier: int, intent: str = "", least: int = 10_000) -> DataFrame:
    """id, activation, hop: what scores (id, score) give to their neighbours over relations (source, target, kind, weight, trust: micros).

    Each hop sums what comes in by decay, kind, weight and trust, keeps the `frontier` strongest of those not visited, and goes on from them.
    """
    both = relations.select(F.col("source").alias("id"), F.col("target").alias("next"), "kind", "weight", "trust").unionByName(relations.select(F.col("target").alias("id"), F.col("source").alias("next"), "kind", "weight", "trust"))
    front = settle(scores.select("id", F.col("score").alias("activation")).orderBy(F.desc("activation"), "id").limit(frontier), "front")
    visited, found = front.select("id"), None
    for hop in range(1, hops + 1):
        give = numbers.product(F.least("activation", F.lit(100_000_000)), numbers.relation_weight("kind", intent), F.col("weight"), F.col("trust"), F.lit(numbers.decay(hop)))
        come = front.join(both, "id").join(visited.withColumnRenamed("id", "next"), "next", "left_anti").select("next", give.alias("give")).where(F.col("give") >= least)
        front = settle(come.groupBy(F.col("next").alias("id")).agg(F.sum("give").cast("long").alias("activation")).orderBy(F.desc("activation"), "id").limit(frontier), "front")
        visited = visited.unionByName(front.select("id"))
        step = front.withColumn("hop", F.lit(hop))
        found = step if found is None else found.unionByName(step)
    return found


def select_context(ranked_rows: DataFrame, group: list[str], most_tokens: int) -> DataFrame:
    """The rows of each group that are read in order of `place` until one would exceed the tokens; that one stops the reading.

    Withheld rows (included false) cost nothing. The cost is a running sum, so no group is gathered in Python.
    """
    cost = F.when(F.col("included"), F.col("tokens")).otherwise(F.lit(0))
    total = F.sum(cost).over(Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    summed = ranked_rows.withColumn("used", total)
    stop = F.min(F.when(F.col("used") > most_tokens, F.col("place"))).over(Window.partitionBy(*group))
    return summed.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).drop("stop")


def sufficiency(required: Column, covered: Column, conflicts: Column, unsupported: Column, included: Column, primary_needed: bool) -> Column:
    """A struct of sufficient, missing and confidence (millionths): the share of facets, less 400,000 for missing support and 500,000 for conflicts."""
    missing = F.array_except(required, covered)
    share = F.when(F.size(required) == 0, F.when(included > 0, 1_000_000).otherwise(0)).otherwise(F.call_function("div", F.size(F.array_intersect(required, covered)) * 1_000_000, F.greatest(F.size(required), F.lit(1))))
    penalty = F.when(F.lit(primary_needed) & (unsupported > 0), 400_000).otherwise(0) + F.when(conflicts > 0, 500_000).otherwise(0)
    enough = (F.size(missing) == 0) & (conflicts == 0) & (unsupported == 0) & (included > 0)
    return F.struct(enough.alias("sufficient"), missing.alias("missing"), F.greatest(share - penalty, F.lit(0)).cast("long").alias("confidence"))
