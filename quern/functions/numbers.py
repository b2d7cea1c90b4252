"""Whole-number scores, times, costs and hashes as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000
# Weights of the recall routes.
ROUTE_WEIGHTS = {"active_context": 1300, "exact_alias": 1250, "relationship": 1150, "episodic": 1050, "temporal": 950, "structural": 900, "lexical": 800, "supplied_vector": 850}
# Base weights of relation kinds, in millionths; other kinds have 550,000.
RELATION_WEIGHTS = {
    "contains": 650_000, "part_of": 650_000, "hierarchy_parent": 650_000, "about": 600_000, "related_to": 600_000, "similar_to": 600_000, "supports": 800_000, "refines": 800_000, "verified_by": 800_000, "learned_from": 800_000,
    "occurred_in": 750_000, "participant_in": 750_000, "preceded_by": 750_000, "followed_by": 750_000, "triggered": 700_000, "resulted_in": 700_000, "motivated_by": 700_000, "caused_by": 700_000, "supersedes": 850_000, "corrected_by": 850_000,
    "contradicts": 300_000, "shared_with": 900_000, "shared_history": 900_000, "running_joke": 900_000, "has_boundary": 850_000, "committed_to": 850_000, "requires": 850_000,
}
# What an intent adds to the weights of some kinds.
INTENT_BOOSTS = {
    "relational": (200_000, ("shared_with", "shared_history", "running_joke", "related_to")),
    "historical_truth": (150_000, ("occurred_in", "preceded_by", "followed_by", "supersedes", "corrected_by", "contradicts")),
    "forensic": (150_000, ("occurred_in", "preceded_by", "followed_by", "supersedes", "corrected_by", "contradicts")),
    "procedural": (150_000, ("requires", "verified_by", "learned_from")),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole(a: Column, b: Column | int) -> Column:
    """a div b of whole numbers, towards zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


def quantize(x: Column | str) -> Column:
    """A number from 0 to 1 in millionths, rounded half up; others are clamped."""
    return F.floor(F.least(F.greatest(_col(x).cast("double"), F.lit(0.0)), F.lit(1.0)) * MICRO + 0.5).cast("long")


def rrf(route: Column | str, rank: Column | str) -> Column:
    """What a rank in a route adds to a score: weight * 1,000,000 div (60 + rank)."""
    weights = F.create_map(*(F.lit(v) for kv in ROUTE_WEIGHTS.items() for v in kv))
    return whole(weights[_col(route)].cast("long") * MICRO, _col(rank).cast("long") + 60)


def modifiers(trust, importance, strength, exact, participant, temporal) -> Column:
    """What a document's own facts add: trust / 2, importance / 3, the strongest route / 5, and steps for three matches."""
    step = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    return whole(trust, 2) + whole(importance, 3) + whole(strength, 5) + step(exact, 500_000) + step(participant, 300_000) + step(temporal, 150_000)


def relation_weight(kind: Column | str, intent: str = "") -> Column:
    """The weight of a relation kind in millionths, with what an intent adds, at most a million."""
    boost, kinds = INTENT_BOOSTS.get(intent, (0, ()))
    weights = F.create_map(*(F.lit(v) for k, w in RELATION_WEIGHTS.items() for v in (k, min(MICRO, w + boost * (k in kinds)))))
    return F.coalesce(F.try_element_at(weights, _col(kind)), F.lit(550_000)).cast("long")


def decay(hop: int, factor: int = 700_000) -> int:
    """factor to the power of `hop`, in whole millionths, cut down at each step."""
    return reduce(lambda acc, _: acc * factor // MICRO, range(hop), MICRO)


def product(*values: Column) -> Column:
    """The product of millionths, cut down after each factor; the first may be greater than a million."""
    return reduce(lambda acc, v: whole(acc.cast("decimal(38,0)") * v, MICRO), values)


def count_bucket(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n == 0, "zero").when(n == 1, "one").when(n <= 4, "few").when(n <= 16, "several").otherwise("many")


def work_bucket(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n <= 1, "constant").when(n <= 32, "small").when(n <= 256, "medium").otherwise("large")


def nearest_rank(n: Column, percent: int) -> Column:
    """The rank, from 1, of a percentile among n values."""
    return whole(n * percent + 99, 100)


def temporal_class(start: Column, end: Column, now: Column) -> Column:
    """What a validity is at a time: historical, bounded_current, future or current."""
    return F.when(end <= now, "historical").when(end.isNotNull(), F.when(start <= now, "bounded_current").otherwise("future")).when(start > now, "future").otherwise("current")


def backoff(attempts: Column, base: int, most: int, retry_after: Column | None = None) -> Column:
    """Milliseconds to wait after so many attempts: doubled each time, or as told, at most `most`."""
    shift = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(31))
    own = F.least(F.lit(base) * F.pow(F.lit(2.0), shift), F.lit(float(most))).cast("long")
    return F.least(F.coalesce(retry_after, own) if retry_after is not None else own, F.lit(most)).cast("long")


def cost(inputs: Column, outputs: Column, request: int, per_input: int, per_output: int) -> Column:
    """Micro-units for a call: each side's price per million tokens rounded up."""
    part = lambda n, rate: whole(n * rate + (MICRO - 1), MICRO)
    return F.lit(request) + part(inputs, per_input) + part(outputs, per_output)


def charge(parts: list[tuple[Column, int]], request: int) -> Column:
    """Micro-units for a call by several tariffs, rounded up once; null if a count is."""
    return whole(reduce(add, (n * rate for n, rate in parts)) + (MICRO - 1), MICRO) + request


def marginal_value(utility: Column, new_facets: Column) -> Column:
    """utility, times 2n + 1 where n new facets are covered."""
    return utility * F.when(new_facets == 0, F.lit(1)).otherwise(2 * new_facets + 1)


def r0_score(utility: Column, new_facets: Column, tokens: Column) -> Column:
    """utility times 1 + the new facets (8 at most); null, which stops, under 100 a token."""
    value = utility * (F.least(new_facets, F.lit(8)) + 1)
    return F.when(whole(value, F.greatest(tokens, F.lit(1))) >= 100, value)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def level(name: Column | str, most: int = 4) -> Column:
    """A node's level by its name: half of the leading zero bits of a hash's first byte."""
    first = F.conv(F.substr(F.sha2(_col(name), 256), F.lit(1), F.lit(2)), 16, 2)
    zeros = F.when(first == "0", 8).otherwise(8 - F.length(first))
    return F.least(whole(zeros.cast("long"), 2), F.lit(most).cast("long"))


def name_uuid(*parts: Column) -> Column:
    """A stable identifier in the form of a UUID, from a hash of the parts."""
    h = F.sha2(F.concat_ws("\u0000", *parts), 256)
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("8"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))


def leaf(domain: str, *parts: Column) -> Column:
    """The hash of a leaf: the domain, then each part after its length, so that parts can't be moved between leaves."""
    framed = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return F.sha2(F.concat(F.lit(f"{domain}\u0000"), *framed), 256)
