"""Verified links from buckets of candidates, without all pairs of a large bucket.

Of buckets with the same members one is enough. In each, of whatever size, the most central member (in the most buckets) is compared with each other. Then, for a few rounds,
PIVOTS of the members of a large bucket, other ones in each, are compared with all that are in another component: in a group of near copies that
reach each other through others only, a member meets some that it links to. What is still apart after
that is compared with every member of another component. Of buckets that have more pairs than splitting them costs, the ids are dealt anew
for that, into parts that two ids which link share: those that have a phrase in common, and no more, would be compared with all of them, as
the square of their number. So each pair of a bucket is either verified, or known to be connected,
or ruled out by the facts or parts of its two ends; and a group of near copies costs a few pairs a member.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small_side
from .components import components

#: Rounds of a few members before the rest is compared, how many of a bucket are drawn in each, and the least members of a bucket for that.
ROUNDS, PIVOTS, LARGE = 1, 8, 33
#: The least members of a bucket that is split for the last comparison, and how often the sum of its members' prices must go into the square of their
#: number. So many buckets of an id are looked at to tell that a pair was met before.
SPLIT, WORTH, KNOWN = 128, 14, 32
#: The most entries of a bucket whose ids are looked at, one by one, for another that they may link with: that is so many looks an id at most.
CROWD = 1024
Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def shared_members(entries: DataFrame, may: Condition | None = None) -> DataFrame:
    """The distinct rows of `entries` (bucket, id: longs, and facts of the id, not null) whose bucket has two ids or more.

    With `may`, which says by these facts of two ids (x("fact")) if they may link, only (bucket, id), and of buckets of CROWD entries or
    fewer only the ids that may link with another of the bucket: nearly all that meet by chance end there, before their texts are read.
    """
    # Least and greatest are combined before the shuffle; buckets of one id, nearly all of them, end there.
    both = [F.min("id").alias("lo"), F.max("id").alias("hi")]
    counts = entries.groupBy("bucket").agg(*both, *([F.count("*").alias("many")] if may else [])).where("lo < hi")
    shared = small_side(cut(counts.select("bucket", *([(F.col("many") <= CROWD).alias("few")] if may else [])), "shared"))
    if not may:
        return cut(entries.join(shared, "bucket").distinct(), "members")
    found = cut(entries.join(shared, "bucket"), "found")
    few = found.where(" and ".join(f"{c} is not null" for c in entries.columns)).where("few").drop("few")
    ends = {e: few.select(*(F.col(c).alias(f"{c}_{e}") for c in few.columns)) for e in "xy"}
    x, y = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    # For each entry the search ends at the first that it may link with, and it is one row at most. Both ends are one shuffle.
    left = ends["x"].join(ends["y"], (x("bucket") == y("bucket")) & (x("id") != y("id")) & may(x, y), "left_semi")
    left = left.select(x("bucket").alias("bucket"), x("id").alias("id")).distinct()
    out = cut(left.unionByName(found.where("not few").select("bucket", "id").distinct()), "members")
    drop(found)
    return out


def linked(members: DataFrame, facts: DataFrame, verify: Callable[[DataFrame], DataFrame], may: Condition, rounds: int = ROUNDS, closer: tuple[Callable[[DataFrame], DataFrame], Condition] | None = None, split: tuple[Callable[[DataFrame], DataFrame], str] | None = None) -> DataFrame:
    """The components (node, component) of the links in `members` (bucket, id: longs, each row once).

    `facts` has a row of facts for each id; `may(x, y)` says by those of two ids (x("fact")) if they may link. `verify` takes a table
    of pairs (a, b), a < b, each once, and returns those that link. `closer` takes a table of ids (id, each once) and returns further facts of
    some (id, ...), too wide to be carried through all rounds, and has what they say of two ids (all null for others); pairs of the last
    comparison only are met by them. `split` takes a table of ids (id, each once) and returns their parts (bucket, id), of which any two that
    link share one; with it is the fact that is an id's price of being split.
    """
    names = [c for c in facts.columns if c != "id"]
    facts = cut(facts, "facts")
    ends = lambda df, end: df.select("bucket", *(F.col(c).alias(f"{c}_{end}") for c in df.columns if c != "bucket"))
    x, y = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    central = lambda df: df.groupBy("bucket").agg(F.max_by(F.struct("id", *names), F.struct("degree", -F.col("id"))).alias("r")).select("bucket", "r.*")
    pairs_of = lambda df: df.select(F.least(x("id"), y("id")).alias("a"), F.greatest(x("id"), y("id")).alias("b")).distinct()
    # A bucket of two, as most are, is one pair. Of larger ones that have the same members, as copies make, one goes on.
    whole = cut(members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("many"), F.bit_xor(F.xxhash64("id")).alias("ids")), "buckets")
    two = whole.where("many = 2").select(F.col("lo").alias("id_x"), F.col("hi").alias("id_y")).distinct()
    for e in "xy":
        two = two.join(facts.select(*(F.col(c).alias(f"{c}_{e}") for c in facts.columns)), f"id_{e}")
    large = cut(whole.where("many > 2").groupBy("lo", "hi", "many", "ids").agg(F.min("bucket").alias("bucket")).select("bucket"), "larger")
    members = cut(members.join(small_side(large), "bucket"), "members")
    # Facts and components go to ids, a row each, and only then to each of their buckets.
    gathered = lambda df: df.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")).join(facts, "id")
    spread = lambda df, *more: df.select(F.explode("buckets").alias("bucket"), "id", *names, *more)
    full = cut(gathered(members), "owners")
    lead = cut(central(spread(full, F.size("buckets").alias("degree"))), "leads")
    met = ends(lead, "x").join(ends(spread(full), "y"), "bucket").where((x("id") != y("id")) & may(x, y))
    tried = cut(pairs_of(met.select("id_x", "id_y").unionByName(two.where(may(x, y)).select("id_x", "id_y"))), "tried")
    links = cut(verify(tried), "links")
    grouped = small_side(cut(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "groups"))
    drop(members, lead)

    known = F.slice("buckets", 1, KNOWN).alias("known")

    def labelled(full: DataFrame, *more: Column, price: str | None = None) -> DataFrame:
        label = spread(full.join(grouped.withColumnRenamed("node", "id"), "id", "left"), *more, F.coalesce("component", "id").alias("own"))
        # A bucket whose members are all in one component is done: only others go on.
        # The largest is its main component, so that the rest is small.
        parts = label.groupBy("bucket", "own").agg(F.count("*").alias("size"), F.sum(price or F.lit(0)).alias("price"))
        mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("many"), F.sum("price").alias("price"), F.max_by("own", F.struct("size", -F.col("own"))).alias("main")).where("parts > 1")
        mixed = mixed.select("bucket", "main", "many", ((F.col("many") >= SPLIT) & (F.col("many") * F.col("many") >= F.col("price") * WORTH)).alias("heavy"))
        return cut(label.join(small_side(cut(mixed, "mixed")), "bucket").withColumn("rest", F.col("own") != F.col("main")), "labels")

    def nearer(pairs: DataFrame) -> DataFrame:
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
        own = cut(closer[0](ids), "closer")
        for e, end in (("x", "a"), ("y", "b")):
            pairs = pairs.join(own.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{e}") for c in own.columns if c != "id")), end, "left")
        return pairs.where(closer[1](x, y)).select("a", "b")

    for r in range(rounds + 1):
        label = labelled(full, *([known] if r == rounds else []), price=split[1] if split and r == rounds else None)
        if split and r == rounds:
            crowd = cut(label.where("heavy").select("id").distinct(), "crowd")
            if crowd.limit(1).count():
                label = label.where("not heavy").unionByName(labelled(cut(gathered(split[0](crowd)), "parts"), known))
        rest = label.where("rest")
        if not rest.limit(1).count():
            break
        if r < rounds:
            drawn = [F.min_by(F.struct("id", *names, "own"), F.xxhash64("id", "bucket", F.lit(PIVOTS * r + k))) for k in range(PIVOTS)]
            large = label.where(F.col("many") >= LARGE)
            pivots = large.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("drawn")).select("bucket", F.inline("drawn"))
            new = pairs_of(ends(pivots, "x").join(ends(large, "y"), "bucket").where((x("own") != y("own")) & may(x, y)))
        else:
            # All that is left: pairs of a rest and a main member, and of two of the rest; each in the first bucket that it shares.
            # Two that share a bucket that was split are met in their parts, if they may link.
            one_way = ~y("rest") | (x("id") < y("id"))
            first = F.coalesce(F.array_min(F.array_intersect(x("known"), y("known"))) == F.col("bucket"), F.lit(True))
            new = pairs_of(ends(label.where("rest"), "x").join(ends(label, "y"), "bucket").where((x("own") != y("own")) & one_way & may(x, y) & first))
        fresh = cut(new.join(tried, ["a", "b"], "left_anti"), "fresh")
        if closer and r == rounds:
            fresh = cut(nearer(fresh), "near")
        more = cut(verify(fresh), "links")
        if more.limit(1).count():
            # Components so far are stars, which settle in fewer rounds than the links that made them.
            stars = grouped.select(F.col("node").alias("src"), F.col("component").alias("dst"))
            grouped = small_side(cut(components(stars.unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))), "groups"))
        if r < rounds:
            tried = cut(tried.unionByName(fresh), "tried")
        drop(label, fresh)
    return grouped
