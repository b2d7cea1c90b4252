"""Breadth-first reach, branch statistics and routes over edge tables; the frontier is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import settle


def reach(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "out", include_starts: bool = False) -> DataFrame:
    """node, hop: nodes within `hops` of the starts (column node), with the least hop; a level is one join."""
    out = edges.select(F.col("parent").alias("node"), F.col("child").alias("next"))
    back = edges.select(F.col("child").alias("node"), F.col("parent").alias("next"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    seen = frontier = starts.select("node", F.lit(0).alias("hop")).distinct()
    for h in range(1, hops + 1):
        frontier = settle(frontier.join(step, "node").select(F.col("next").alias("node"), F.lit(h).alias("hop")).distinct().join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen if include_starts else seen.where("hop > 0")


def branches(edges: DataFrame, depth: int) -> DataFrame:
    """node, children, descendants (distinct), leaves, depth for every node that has a child; at most `depth` levels."""
    leaf = edges.select(F.col("child").alias("below")).join(edges.select(F.col("parent").alias("below")), "below", "left_anti").distinct().withColumn("leaf", F.lit(1))
    level = pairs = edges.select(F.col("parent").alias("node"), F.col("child").alias("below"), F.lit(1).alias("d")).distinct()
    for d in range(2, depth + 1):
        level = settle(level.join(edges.select(F.col("parent").alias("below"), F.col("child").alias("c")), "below").select("node", F.col("c").alias("below"), F.lit(d).alias("d")).distinct(), "level")
        pairs = pairs.unionByName(level)
    far = pairs.groupBy("node", "below").agg(F.min("d").alias("near"), F.max("d").alias("d")).join(leaf, "below", "left")
    return far.groupBy("node").agg(F.count_if(F.col("near") == 1).alias("children"), F.count("*").alias("descendants"), F.count("leaf").alias("leaves"), F.max("d").alias("depth"))


#: Confidence in basis points: whole is 10,000.
WHOLE = 10_000


def combine(a, b):
    """The product of two confidences in basis points, rounded half up."""
    return F.floor((a * b + WHOLE // 2) / WHOLE).cast("long")


def _steps(edges: DataFrame, level: DataFrame) -> DataFrame:
    """The routes (start, node, keys, hops, confidence) one edge longer, without a node twice."""
    step = edges.select(F.col("parent").alias("node"), "child", F.col("confidence").alias("c"))
    on = level.join(step, "node").where(~F.array_contains("keys", F.col("child")))
    return on.select("start", F.col("child").alias("node"), F.concat("keys", F.array("child")).alias("keys"), (F.col("hops") + 1).alias("hops"), combine(F.col("confidence"), F.col("c")).alias("confidence"))


def _from(starts: DataFrame) -> DataFrame:
    return starts.select(F.col("node").alias("start"), "node", F.array("node").alias("keys"), F.lit(0).alias("hops"), F.lit(WHOLE).cast("long").alias("confidence"))


def routes(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, path (keys joined by `>`), hops, confidence of every route of 1 to `depth` edges (parent, child, confidence) from the starts (column node)."""
    return beam(edges, starts, depth, None).drop("start")


def beam(edges: DataFrame, starts: DataFrame, depth: int, width: int | None) -> DataFrame:
    """Routes as above, but of each level and start only the `width` of most confidence go on; ties to the smaller path."""
    level, found = _from(starts), None
    best = Window.partitionBy("start").orderBy(F.desc("confidence"), "path")
    for _ in range(depth):
        on = _steps(edges, level).withColumn("path", F.concat_ws(">", "keys"))
        level = settle(on if width is None else on.withColumn("place", F.row_number().over(best)).where(F.col("place") <= width).drop("place"), "routes")
        found = level if found is None else found.unionByName(level)
    return found.select("node", "path", "hops", "confidence", "start")


def impact(relations: DataFrame, selected: str, hops: int) -> DataFrame:
    """symbol, test: what depends on a symbol by relations (kind, source, target), at most `hops` away: who calls, imports or uses it, and its tests."""
    uses = relations.where(F.col("kind").isin("calls", "imports", "uses_type")).select(F.col("target").alias("parent"), F.col("source").alias("child"))
    tested = relations.where("kind = 'tested_by'").select(F.col("source").alias("parent"), F.col("target").alias("child"))
    starts = relations.sparkSession.createDataFrame([(selected,)], "node string")
    found = reach(uses.unionByName(tested), starts, hops)
    near = found.select("node").unionByName(starts).distinct()
    tests = tested.join(near.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct().withColumn("t", F.lit(True))
    return found.join(tests, "node", "left").select(F.col("node").alias("symbol"), F.coalesce("t", F.lit(False)).alias("test"))


def faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """rule, node of what breaks a hierarchy: a repeated edge, a loop, a node with several parents, a parent that isn't in nodes."""
    edges = edges.select("parent", "child")
    repeated = edges.groupBy("parent", "child").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("rule"), F.col("child").alias("node"))
    loops = edges.where("parent = child").select(F.lit("loop").alias("rule"), F.col("child").alias("node"))
    several = edges.groupBy("child").agg(F.count_distinct("parent").alias("n")).where("n > 1").select(F.lit("several").alias("rule"), F.col("child").alias("node"))
    unknown = edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select(F.lit("unknown").alias("rule"), F.col("parent").alias("node"))
    return repeated.unionByName(loops).unionByName(several).unionByName(unknown).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """parent, children: its distinct children in order, as one string joined by commas."""
    return edges.groupBy("parent").agg(F.array_join(F.sort_array(F.collect_set("child")), ",").alias("children"))


def closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, above: all pairs reachable over edges (node, above), by doubling; in a cycle nodes reach themselves."""
    known = settle(edges.select("node", "above").distinct(), "closure")
    n = known.count()
    for _ in range(rounds):
        longer = known.join(known.select(F.col("node").alias("above"), F.col("above").alias("next")), "above").select("node", F.col("next").alias("above"))
        known, before = settle(known.unionByName(longer).distinct(), "closure"), n
        n = known.count()
        if n == before:
            return known
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")


def acyclic(edges: DataFrame, rounds: int = 1000) -> bool:
    """Whether edges (parent, child) hold no cycle, a loop included: nodes without a parent are taken off until none is left, or nothing goes."""
    left = settle(edges.select("parent", "child").distinct(), "acyclic")
    n = left.count()
    for _ in range(rounds):
        if not n:
            return True
        left = settle(left.join(left.select(F.col("child").alias("parent")), "parent", "left_semi"), "acyclic")
        n, before = left.count(), n
        if n == before:
            return False
    raise RuntimeError(f"no end after {rounds} rounds")


def levels(edges: DataFrame, nodes: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, level, place: a topological order; level is the longest way from a node without parents, places go by level, then name. A cycle raises ValueError."""
    level = settle(nodes.select("node", F.lit(0).alias("level")), "levels")
    edges = edges.select("parent", "child").distinct()
    for r in range(1, rounds):
        up = level.join(edges, level["node"] == edges["parent"]).where(F.col("level") == r - 1).select(F.col("child").alias("node"), F.lit(r).alias("level"))
        if not up.limit(1).count():
            counts = level.groupBy("level").agg(F.count("*").alias("m"))
            before = counts.select("level", (F.sum("m").over(Window.orderBy("level")) - F.col("m")).alias("before"))
            place = F.row_number().over(Window.partitionBy("level").orderBy("node"))
            return level.withColumn("p", place).join(F.broadcast(before), "level").select("node", "level", (F.col("before") + F.col("p")).alias("place"))
        if r > level.count():
            raise ValueError("the edges hold a cycle")
        level = settle(level.unionByName(up).groupBy("node").agg(F.max("level").alias("level")), "levels")
    raise ValueError("the edges hold a cycle")


def pull(members: DataFrame, set_: str, member: str, start, rounds: int = 100) -> DataFrame:
    """The members that sets pull in from a start: whoever shares a set with one that is in, until none is new."""
    seen = settle(members.sparkSession.createDataFrame([(start,)], f"{member} {dict(members.dtypes)[member]}"), "pulled")
    front = seen
    for _ in range(rounds):
        sets = members.join(front, member, "left_semi").select(set_).distinct()
        front = settle(members.join(sets, set_, "left_semi").select(member).distinct().join(seen, member, "left_anti"), "pulled")
        if not front.limit(1).count():
            return seen
        seen = settle(seen.unionByName(front), "pulled")
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")


def climb(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, above, hop: each start and its ancestors by all ways up, at most `depth` steps."""
    level = found = starts.select("node", F.col("node").alias("above"), F.lit(0).alias("hop"))
    up = edges.select(F.col("child").alias("above"), F.col("parent").alias("next"))
    for h in range(1, depth + 1):
        level = settle(level.join(up, "above").select("node", F.col("next").alias("above"), F.lit(h).alias("hop")), "climb")
        if not level.limit(1).count():
            break
        found = found.unionByName(level)
    return found


def depths(level: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """node, depth: the longest way of steps (node, child) from the nodes of `level` (node, depth), at most `most` steps."""
    found = front = settle(level, "depths")
    for d in range(1, most + 1):
        front = settle(front.select("node").distinct().join(steps, "node").select(F.col("child").alias("node"), F.lit(d).alias("depth")), "depths")
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    return found.groupBy("node").agg(F.max("depth").alias("depth"))


def violations(edges: DataFrame, known, root, fits, most_parents: int) -> DataFrame:
    """rule, node of what breaks a hierarchy of edges (parent, child); known, root and fits are predicates of an edge."""
    of = lambda rule, df: df.select(F.lit(rule).alias("rule"), "node")
    twice = edges.groupBy("parent", "child").agg(F.count("*").alias("n")).where("n > 1").select(F.col("child").alias("node"))
    many = edges.groupBy("child").agg(F.count_distinct("parent").alias("n")).where(F.col("n") > most_parents).select(F.col("child").alias("node"))
    child, parent = F.col("child").alias("node"), F.col("parent").alias("node")
    parts = [of("duplicate_edge", twice), of("too_many_parents", many), of("loop", edges.where("parent = child").select(child)), of("unknown_parent", edges.where(~known).select(parent)), of("root_has_parent", edges.where(root).select(child)), of("partition", edges.where(~fits).select(child))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.distinct()
