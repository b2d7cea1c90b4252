"""Queries over graphs and hierarchies: walks, cycles, orders, activation, generations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import graph, recall, scans
from ..sources.tables import EDGES_SQL, edges, micros, table
from .registry import query

_PARTS_SQL = """typed AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target, CASE l_linenumber % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'about' ELSE 'contradicts' END AS kind FROM lineitem WHERE l_quantity >= 45)"""


def _typed(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity >= 45")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "calls").when(F.col("l_linenumber") % 3 == 1, "about").otherwise("contradicts")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return li.select(name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target"), kind.alias("kind")).distinct()


@query(f"""WITH RECURSIVE {_PARTS_SQL}, b AS (SELECT source AS a, target AS b FROM typed WHERE kind <> 'contradicts' UNION SELECT target, source FROM typed WHERE kind = 'about'), w(node, hop) AS (SELECT 'p1', 0 UNION SELECT b, hop + 1 FROM w JOIN b ON a = node WHERE hop < 4)
    SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node HAVING min(hop) > 0""")
def typed_traversal(spark, d):
    """Undirected kinds are walked both ways, directed ones along, excluded ones not at all."""
    t = _typed(spark, d).where("kind <> 'contradicts'")
    both = t.select(F.col("source").alias("parent"), F.col("target").alias("child")).unionByName(t.where("kind = 'about'").select(F.col("target").alias("parent"), F.col("source").alias("child")))
    return graph.reach(both, spark.createDataFrame([("p1",)], "node string"), 4)


@query(f"""WITH RECURSIVE {EDGES_SQL}, w(node, hop) AS (SELECT 'r2', 0 UNION SELECT child, hop + 1 FROM w JOIN edges ON parent = node WHERE hop < 32) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node ORDER BY min(hop), node LIMIT 200""")
def service_traversal(spark, d):
    """The start comes too; at most so many nodes (a budget of the request), nearest first."""
    found = graph.reach(edges(spark, d), spark.createDataFrame([("r2",)], "node string"), 4, include_starts=True)
    return found.orderBy("hop", "node").limit(200)


@query(f"WITH RECURSIVE {EDGES_SQL}, e AS (SELECT * FROM edges WHERE child NOT LIKE '%7'), w(node) AS (SELECT 'r0' UNION SELECT child FROM w JOIN e ON parent = node) SELECT node FROM w WHERE node <> 'r0'")
def candidate_traversal(spark, d):
    e = edges(spark, d).where(~F.endswith("child", F.lit("7")))
    return graph.reach(e, spark.createDataFrame([("r0",)], "node string"), 4).select("node")


@query("SELECT 'edges' AS graph, true AS acyclic UNION ALL SELECT 'loop', false UNION ALL SELECT 'ring', false")
def acyclicity(spark, d):
    """A hierarchy without cycles, the same with a loop, and with a way back from a leaf to the root."""
    e = edges(spark, d)
    more = lambda *rows: e.unionByName(spark.createDataFrame(list(rows), "parent string, child string"))
    found = [("edges", graph.acyclic(e)), ("loop", graph.acyclic(more(("n1", "n1")))), ("ring", graph.acyclic(more(("c1", "r0"), ("c1", "r1"), ("c1", "r2"), ("c1", "r3"), ("c1", "r4"))))]
    return spark.createDataFrame(found, "graph string, acyclic boolean")


@query(f"""WITH RECURSIVE {EDGES_SQL}, up(node, above) AS (SELECT child, parent FROM edges UNION SELECT up.node, parent FROM up JOIN edges ON child = above), n AS (SELECT 'n' || n_nationkey AS child, 'n' || (n_nationkey * 7 % 25) AS parent FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)
    SELECT n.child, n.parent, n.child = n.parent OR EXISTS (SELECT 1 FROM up WHERE up.node = n.parent AND up.above = n.child) AS cycle FROM n""")
def cycle_reject(spark, d):
    """New edges that would close a cycle: the child is already above the parent."""
    n = table(spark, d, "nation")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    new = n.select(name("n", F.col("n_nationkey")).alias("child"), name("n", F.col("n_nationkey") * 7 % 25).alias("parent")).unionByName(n.select(name("r", F.col("n_regionkey")).alias("child"), name("n", F.col("n_nationkey")).alias("parent")))
    above = graph.closure(edges(spark, d).select(F.col("child").alias("node"), F.col("parent").alias("above")))
    hit = above.select(F.col("node").alias("parent"), F.col("above").alias("child"), F.lit(True).alias("hit"))
    return new.join(hit, ["parent", "child"], "left").select("child", "parent", (F.col("hit").isNotNull() | (F.col("child") == F.col("parent"))).alias("cycle"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, n AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges), w(node, level) AS (SELECT node, 0 FROM n UNION SELECT child, level + 1 FROM w JOIN edges ON parent = node), l AS (SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY node)
    SELECT node, level, row_number() OVER (ORDER BY level, node) AS place FROM l""")
def topological_order(spark, d):
    e = edges(spark, d)
    return graph.levels(e, e.select(F.col("parent").alias("node")).union(e.select("child")).distinct())


_WEIGHTS = " ".join(f"WHEN '{k}' THEN {w}" for k, w in numbers.RELATION_WEIGHTS.items())


@query(f"SELECT event_id, CASE kind {_WEIGHTS} ELSE 550000 END AS base, least(1000000, CASE kind {_WEIGHTS} ELSE 550000 END + CASE WHEN kind IN ('shared_with', 'shared_history', 'running_joke', 'related_to') THEN 200000 ELSE 0 END) AS relational FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'shared_with' WHEN 1 THEN 'supports' WHEN 2 THEN 'related_to' WHEN 3 THEN 'contradicts' ELSE event_type END AS kind FROM events)")
def relation_weights(spark, d):
    i = F.col("event_id") % 5
    kind = F.when(i == 0, "shared_with").when(i == 1, "supports").when(i == 2, "related_to").when(i == 3, "contradicts").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", numbers.relation_weight(kind).alias("base"), numbers.relation_weight(kind, "relational").alias("relational"))


@query("SELECT hop, decay, CAST(decay AS BIGINT) * 900000 // 1000000 * 800000 // 1000000 AS carried FROM (VALUES (1, 700000), (2, 490000), (3, 343000), (4, 240100), (5, 168070)) v(hop, decay)")
def decay_products(spark, d):
    rows = spark.createDataFrame([(h, numbers.decay(h)) for h in range(1, 6)], "hop int, decay long")
    return rows.select("hop", "decay", numbers.product(F.col("decay"), F.lit(900_000), F.lit(800_000)).alias("carried"))


_REL_SQL = "rel AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'about' AS kind, 500000 + c_custkey % 5 * 100000 AS weight, 900000 AS trust FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 800000, 950000 FROM nation)"
_GIVE = "(((({a} * {w} // 1000000) * weight // 1000000) * trust // 1000000) * {d} // 1000000)"


@query(f"""WITH {_REL_SQL}, b AS (SELECT source AS id, target AS nxt, kind, weight, trust FROM rel UNION ALL SELECT target, source, kind, weight, trust FROM rel), f0 AS (SELECT 'c' || c_custkey AS id, CAST(least(c_acctbal * 100, 100000000) AS BIGINT) AS a FROM customer WHERE c_acctbal > 5000 ORDER BY a DESC, id LIMIT 20),
    f1 AS (SELECT nxt AS id, sum(g) AS a FROM (SELECT nxt, CAST({_GIVE.format(a='CAST(a AS HUGEINT)', w='600000', d='700000')} AS BIGINT) AS g FROM f0 JOIN b USING (id) WHERE nxt NOT IN (SELECT id FROM f0)) WHERE g >= 10000 GROUP BY 1 ORDER BY a DESC, id LIMIT 20),
    f2 AS (SELECT nxt AS id, sum(g) AS a FROM (SELECT nxt, CAST({_GIVE.format(a='CAST(least(a, 100000000) AS HUGEINT)', w="CASE kind WHEN 'about' THEN 600000 ELSE 650000 END", d='490000')} AS BIGINT) AS g FROM f1 JOIN b USING (id) WHERE nxt NOT IN (SELECT id FROM f0 UNION ALL SELECT id FROM f1)) WHERE g >= 10000 GROUP BY 1 ORDER BY a DESC, id LIMIT 20)
    SELECT id, CAST(a AS BIGINT) AS activation, 1 AS hop FROM f1 UNION ALL SELECT id, CAST(a AS BIGINT), 2 FROM f2""")
def spreading_activation(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    rel = c.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit("about").alias("kind"), (500_000 + F.col("c_custkey") % 5 * 100_000).alias("weight"), F.lit(900_000).alias("trust"))
    rel = rel.unionByName(n.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"), F.lit("part_of").alias("kind"), F.lit(800_000).cast("long").alias("weight"), F.lit(950_000).alias("trust")))
    scores = c.where("c_acctbal > 5000").select(name("c", "c_custkey").alias("id"), F.round(F.least(F.col("c_acctbal") * 100, F.lit(1e8))).cast("long").alias("score"))
    return recall.spread(scores, rel, 2, 20)


@query(f"WITH {EDGES_SQL} SELECT parent, list_sort(list(child)) AS children, 7 AS generation FROM edges GROUP BY parent")
def graph_compaction(spark, d):
    return edges(spark, d).groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children")).withColumn("generation", F.lit(7))


@query("SELECT event_id // 1000 AS generation, count(*) AS objects FROM events WHERE event_id // 1000 >= (SELECT max(event_id) // 1000 - 3 FROM events) GROUP BY 1")
def generation_pruning(spark, d):
    e = table(spark, d, "events").withColumn("generation", F.expr("event_id div 1000"))
    floor = F.broadcast(e.agg((F.max("generation") - 3).alias("floor")))
    return e.join(floor).where("generation >= floor").groupBy("generation").agg(F.count("*").alias("objects"))


@query(f"""WITH {EDGES_SQL}, hid AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0) SELECT parent, child FROM edges WHERE child NOT IN (SELECT node FROM hid) AND parent NOT IN (SELECT node FROM hid)""")
def membership_visibility(spark, d):
    """A membership shows if both its ends do."""
    hid = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")).unionByName(table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")))
    return edges(spark, d).join(hid.withColumnRenamed("node", "child"), "child", "left_anti").join(hid.withColumnRenamed("node", "parent"), "parent", "left_anti").select("parent", "child")


@query("SELECT n_regionkey AS view, count(*) AS visible FROM nation WHERE n_nationkey % 4 <> 1 GROUP BY 1")
def available_views(spark, d):
    return table(spark, d, "nation").where("n_nationkey % 4 <> 1").groupBy(F.col("n_regionkey").alias("view")).agg(F.count("*").alias("visible"))


@query(f"""WITH {EDGES_SQL}, dup AS (SELECT * FROM edges UNION ALL SELECT parent, child FROM edges WHERE child LIKE 's%1' UNION ALL SELECT 'n0', child FROM edges WHERE child LIKE 'c%5' UNION ALL SELECT 'x9', 'c1' UNION ALL SELECT 'c2', 'c2'),
    prim AS (SELECT parent, child, child || parent < 'm' AS pri FROM dup)
    SELECT 'duplicate_edge' AS rule, child AS node FROM dup GROUP BY parent, child HAVING count(*) > 1 UNION SELECT 'loop', child FROM dup WHERE parent = child UNION SELECT 'unknown_parent', parent FROM dup WHERE parent LIKE 'x%'
    UNION SELECT 'too_many_parents', child FROM dup GROUP BY child HAVING count(DISTINCT parent) > 1 UNION SELECT 'root_has_parent', child FROM dup WHERE child LIKE 'r%' UNION SELECT 'partition', child FROM dup WHERE left(parent, 1) = 'n' AND left(child, 1) NOT IN ('c', 's')""")
def hierarchy_validation(spark, d):
    """Structural rules as violation queries: repeated edges, loops, unknown parents, too many parents, roots with parents, members of a wrong kind."""
    e = edges(spark, d)
    more = spark.createDataFrame([("x9", "c1"), ("c2", "c2")], "parent string, child string")
    all_ = e.unionByName(e.where("child like 's%1'")).unionByName(e.where("child like 'c%5'").select(F.lit("n0").alias("parent"), "child")).unionByName(more)
    return graph.violations(all_, known=~F.startswith("parent", F.lit("x")), root=F.startswith("child", F.lit("r")), fits=~F.startswith("parent", F.lit("n")) | F.substring("child", 1, 1).isin("c", "s"), most_parents=1)


@query("SELECT event_id AS child, CASE event_type WHEN 'signup' THEN 6 WHEN 'purchase' THEN 5 WHEN 'view' THEN 4 WHEN 'click' THEN 3 ELSE 1 END AS precedence FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 6 WHEN 'purchase' THEN 5 WHEN 'view' THEN 4 WHEN 'click' THEN 3 ELSE 1 END DESC, event_id) = 1")
def assignment_precedence(spark, d):
    rank = F.when(F.col("event_type") == "signup", 6).when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "view", 4).when(F.col("event_type") == "click", 3).otherwise(1)
    best = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", rank.alias("precedence")), F.struct(rank, -F.col("event_id"))).alias("b"))
    return best.select(F.col("b.event_id").alias("child"), F.col("b.precedence").alias("precedence"))


@query("""WITH RECURSIVE p AS (SELECT event_id AS child, event_id - (event_id % 7 + 1) * 3 AS parent FROM events WHERE event_id % 5 <> 0), w(node, depth) AS (SELECT event_id, 0 FROM events WHERE event_id % 5 = 0 UNION ALL SELECT child, depth + 1 FROM w JOIN p ON parent = node WHERE depth < 12)
    SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def evidence_depth(spark, d):
    """The longest derivation from an original, over a forest of derived events."""
    e = table(spark, d, "events").select("event_id")
    level = e.where("event_id % 5 = 0").select(F.col("event_id").alias("node"), F.lit(0).alias("depth"))
    step = e.where("event_id % 5 <> 0").select(F.col("event_id").alias("child"), (F.col("event_id") - (F.col("event_id") % 7 + 1) * 3).alias("node"))
    return graph.depths(level, step, 12)


@query("SELECT a.doc_id AS old, b.doc_id AS new, a.lang FROM (SELECT doc_id, lang, source, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS nxt FROM documents) a JOIN documents b ON b.doc_id = a.nxt WHERE a.lang <> 'en'")
def source_invalidation(spark, d):
    """A newer revision of a source invalidates the one before."""
    nxt = F.lead("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("old"), nxt.alias("new"), "lang").where("new is not null and lang <> 'en'")


@query(f"WITH RECURSIVE {EDGES_SQL}, w(node, hop) AS (SELECT 'n3', 0 UNION SELECT child, hop + 1 FROM w JOIN edges ON parent = node) SELECT node, 'dirty' AS mark FROM w")
def hierarchy_invalidate(spark, d):
    return graph.reach(edges(spark, d), spark.createDataFrame([("n3",)], "node string"), 4, include_starts=True).select("node", F.lit("dirty").alias("mark"))


@query("SELECT l_orderkey AS parent, l_linenumber AS ordinal, 'derived_from' AS kind, l_partkey AS child FROM lineitem WHERE l_quantity > 30")
def lineage_graph(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("ordinal"), F.lit("derived_from").alias("kind"), F.col("l_partkey").alias("child"))
