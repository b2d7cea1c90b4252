"""Queries over revisions: as-of reads of nodes, claims and edges, joins by identity and time, ordered reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, values
from ..operators import graph, measures, scans, temporal, truth
from ..sources.tables import CLAIMS_SQL, EDGES_SQL, claims, edges, micros, table
from .registry import AT, MID_SQL, at_mid, query

NODES_SQL = """nodes AS (SELECT o_custkey AS id, o_orderkey AS tx_from, lead(o_orderkey) OVER w AS tx_to, epoch_us(o_orderdate) AS valid_from, CASE WHEN o_orderkey % 4 > 0 THEN epoch_us(o_orderdate) + 86400000000 * 400 END AS valid_to,
    o_orderstatus AS state FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""
NODE_MID, NODE_AT = "(SELECT max(o_orderkey) * 2 // 3 FROM orders)", 800_000_000_000_000
LINKS_SQL = """links AS (SELECT l_partkey AS part, l_suppkey AS supplier, l_orderkey * 10 + l_linenumber AS tx_from, lead(l_orderkey * 10 + l_linenumber) OVER w AS tx_to, epoch_us(l_shipdate) AS valid_from, epoch_us(l_shipdate) + 86400000000 * 900 AS valid_to,
    CASE WHEN l_returnflag = 'R' THEN 'retracted' ELSE 'active' END AS lifecycle FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber))"""
LINK_MID = "(SELECT max(l_orderkey) * 20 // 3 FROM lineitem)"


def nodes(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("tx_from"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("tx_to"), micros("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 4 > 0, micros("o_orderdate") + 86_400_000_000 * 400).alias("valid_to"), F.col("o_orderstatus").alias("state"))
    return rows.join(F.broadcast(o.agg(F.expr("max(o_orderkey) * 2 div 3").alias("mid"))))


def links(spark, d):
    li = table(spark, d, "lineitem")
    tx = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = li.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), tx.alias("tx_from"), F.lead(tx).over(Window.partitionBy("l_partkey", "l_suppkey").orderBy(tx)).alias("tx_to"), micros("l_shipdate").alias("valid_from"), (micros("l_shipdate") + 86_400_000_000 * 900).alias("valid_to"), F.when(F.col("l_returnflag") == "R", "retracted").otherwise("active").alias("lifecycle"))
    return rows.join(F.broadcast(li.agg(F.expr("max(l_orderkey) * 20 div 3").alias("mid"))))


@query(f"WITH {NODES_SQL} SELECT id, tx_from, state FROM nodes WHERE tx_from <= {NODE_MID} AND (tx_to IS NULL OR {NODE_MID} < tx_to)")
def graph_asof(spark, d):
    return temporal.as_of(nodes(spark, d), F.col("mid")).select("id", "tx_from", "state")


@query(f"WITH {NODES_SQL} SELECT id, tx_from, state FROM nodes WHERE tx_from <= {NODE_MID} AND (tx_to IS NULL OR {NODE_MID} < tx_to) AND valid_from <= {NODE_AT} AND (valid_to IS NULL OR {NODE_AT} < valid_to)")
def node_at_valid_time(spark, d):
    return temporal.bitemporal(nodes(spark, d), ["id"], F.col("mid"), NODE_AT).select("id", "tx_from", "state")


@query(f"WITH {CLAIMS_SQL} SELECT claim_id, subject, object FROM claims WHERE tx_from <= {MID_SQL} AND (tx_to IS NULL OR {MID_SQL} < tx_to) AND valid_from <= {AT + 500_000_000_000} AND (valid_to IS NULL OR {AT + 500_000_000_000} < valid_to)")
def claim_at_valid_time(spark, d):
    return temporal.bitemporal(at_mid(spark, d), ["subject", "predicate"], F.col("mid"), AT + 500_000_000_000).select("claim_id", "subject", "object")


@query(f"WITH {LINKS_SQL} SELECT part, supplier, tx_from FROM links WHERE tx_from <= {LINK_MID} AND (tx_to IS NULL OR {LINK_MID} < tx_to) AND valid_from <= {NODE_AT} AND {NODE_AT} < valid_to AND lifecycle = 'active'")
def edge_at_valid_time(spark, d):
    return temporal.bitemporal(links(spark, d), ["part", "supplier"], F.col("mid"), NODE_AT).where("lifecycle = 'active'").select("part", "supplier", "tx_from")


@query("SELECT lang AS corpus, max(doc_id) AS revision FROM documents WHERE doc_id <= (SELECT max(doc_id) // 2 FROM documents) GROUP BY lang")
def asof_source_revision(spark, d):
    docs = table(spark, d, "documents")
    upto = F.broadcast(docs.agg(F.expr("max(doc_id) div 2").alias("upto")))
    return docs.join(upto).where("doc_id <= upto").groupBy(F.col("lang").alias("corpus")).agg(F.max("doc_id").alias("revision"))


@query("SELECT event_type AS view, arg_max(event_id, built) AS generation, max(built) AS built_from FROM (SELECT *, event_id // 100 * 100 AS built FROM events WHERE event_id % 100 = 7) WHERE built <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1")
def asof_generation(spark, d):
    e = table(spark, d, "events")
    half = F.broadcast(e.agg(F.expr("max(event_id) div 2").alias("half")))
    g = e.where("event_id % 100 = 7").withColumn("built", F.expr("event_id div 100 * 100")).join(half).where("built <= half")
    return g.groupBy(F.col("event_type").alias("view")).agg(F.max_by("event_id", "built").alias("generation"), F.max("built").alias("built_from"))


@query("SELECT e.event_id AS semantic, s.seq AS storage FROM events e JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) * 2 AS seq FROM events WHERE event_type = 'purchase') s USING (event_id)")
def semantic_to_storage(spark, d):
    numbered = scans.ids_to_numbers(table(spark, d, "events").where("event_type = 'purchase'").select("event_id"), "event_id")
    return numbered.select(F.col("event_id").alias("semantic"), ((F.col("number") + 1) * 2).alias("storage"))


@query("SELECT p.event_id AS seq, max(m.event_id) AS manifest FROM events p JOIN events m ON m.event_type = 'signup' AND m.user_id = p.user_id AND m.event_id <= p.event_id WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def asof_manifest(spark, d):
    """The last manifest at or before each read: one pass over the ordered events of a user, not a join by range."""
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "events").withColumn("manifest", last).where("event_type = 'purchase' and manifest is not null").select(F.col("event_id").alias("seq"), "manifest")


@query("SELECT user_id AS workspace, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal, event_id AS commit FROM events QUALIFY ordinal % 10 = 1")
def ordinal_to_commit(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("workspace"), n.alias("ordinal"), F.col("event_id").alias("commit")).where("ordinal % 10 = 1")


@query(f"WITH {LINKS_SQL}, u AS (SELECT part, supplier, tx_from, lifecycle FROM links WHERE tx_from <= {LINK_MID}) SELECT part, supplier FROM u GROUP BY 1, 2 HAVING arg_max(lifecycle, tx_from) = 'active'")
def edge_delta_merge(spark, d):
    """A built segment (the older half) under the deltas since: the last revision of an edge holds, and one that isn't active removes it."""
    rows = links(spark, d).where("tx_from <= mid").select("part", "supplier", "tx_from", "lifecycle", (F.col("tx_from") <= F.expr("mid div 2")).alias("built"))
    segment = scans.latest(rows.where("built").drop("built"), ["part", "supplier"], "tx_from").where("lifecycle = 'active'")
    merged = scans.latest(segment.select("part", "supplier", "tx_from", "lifecycle").unionByName(rows.where("not built").drop("built")), ["part", "supplier"], "tx_from")
    return merged.where("lifecycle = 'active'").select("part", "supplier")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 4")
def lexical_delta_merge(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang")
    delta = base.where("doc_id % 10 in (3, 4)").select("doc_id", F.when(F.col("doc_id") % 10 == 3, "put").otherwise("delete").alias("op"), F.upper("lang").alias("lang"))
    return scans.overlay(base, delta, "doc_id", ["lang"])


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'error' AND t.user_id = e.user_id AND t.event_id = e.event_id + 1) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)")
def tombstone_anti_join(spark, d):
    e = table(spark, d, "events")
    dead = e.where("event_type = 'error'").select("user_id", (F.col("event_id") - 1).alias("event_id"))
    denied = table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("user_id"))
    return e.join(dead, ["user_id", "event_id"], "left_anti").join(denied, "user_id", "left_anti").select("event_id")


@query(f"WITH {CLAIMS_SQL}, m AS (SELECT subject, count(*) AS members, count(DISTINCT predicate) AS slots FROM claims WHERE family = 1 GROUP BY subject) SELECT subject, members, members >= 2 AND slots = 1 AS sound FROM m")
def conflict_members(spark, d):
    g = claims(spark, d).where("family = 1").groupBy("subject").agg(F.count("*").alias("members"), F.count_distinct("predicate").alias("slots"))
    return g.select("subject", "members", ((F.col("members") >= 2) & (F.col("slots") == 1)).alias("sound"))


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7) UNION ALL SELECT 'line', l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 40 <> 3)")
def referential_checks(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    c, p = table(spark, d, "customer").where("c_custkey % 50 <> 7"), table(spark, d, "part").where("p_partkey % 40 <> 3")
    lost = o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return lost.unionByName(li.join(p, li["l_partkey"] == p["p_partkey"], "left_anti").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id")))


@query("""WITH RECURSIVE m AS (SELECT l_orderkey AS s, l_partkey AS b FROM lineitem), w(b) AS (SELECT 5 UNION SELECT m2.b FROM w JOIN m m1 ON m1.b = w.b AND m1.s % 40 = 1 JOIN m m2 ON m2.s = m1.s) SELECT b AS block FROM w""")
def conflict_closure(spark, d):
    """Blocks that conflicts (sets of blocks) pull in, until none is new."""
    m = table(spark, d, "lineitem").where("l_orderkey % 40 = 1").select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("b"))
    return graph.pull(m, "s", "b", 5).select(F.col("b").alias("block"))


@query(f"WITH RECURSIVE {EDGES_SQL}, w(node, hop) AS (SELECT child, 0 FROM edges WHERE child IN ('c3', 's2') UNION SELECT parent, hop + 1 FROM w JOIN edges ON child = node) SELECT DISTINCT node FROM w")
def dependency_closure(spark, d):
    starts = spark.createDataFrame([("c3",), ("s2",)], "node string")
    return graph.reach(edges(spark, d), starts, 8, "in", include_starts=True).select("node")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name, substr(p_name, 1, 8) AS excerpt FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A' AND l_quantity > 40")
def citation_join(spark, d):
    li, p, s = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 40"), table(spark, d, "part"), table(spark, d, "supplier")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select("l_orderkey", "l_linenumber", "p_name", "s_name", F.substr("p_name", F.lit(1), F.lit(8)).alias("excerpt"))


@query("""SELECT p.event_id, CASE WHEN e.event_id IS NULL THEN 'unknown' WHEN e.event_type = 'error' THEN 'forbidden' WHEN sha256(e.props) <> sha256(CASE WHEN p.event_id % 13 = 0 THEN 'x' ELSE e.props END) THEN 'hash' WHEN e.event_id = p.event_id THEN 'self' ELSE 'ok' END AS issue
    FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_id ELSE event_id * 2 END AS cited FROM events WHERE event_type = 'purchase') p LEFT JOIN events e ON e.event_id = p.cited""")
def proposal_evidence(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("event_id", F.when(F.col("event_id") % 10 == 0, F.col("event_id")).otherwise(F.col("event_id") * 2).alias("cited"))
    of = e.select(F.col("event_id").alias("cited"), F.col("event_type").alias("kind"), F.sha2("props", 256).alias("digest"), "props")
    said = F.sha2(F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("props")), 256)
    issue = F.when(F.col("kind").isNull(), "unknown").when(F.col("kind") == "error", "forbidden").when(F.col("digest") != said, "hash").when(F.col("cited") == F.col("event_id"), "self").otherwise("ok")
    return p.join(of, "cited", "left").select("event_id", issue.alias("issue"))


_ENTITY = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query(f"""WITH m AS (SELECT s_suppkey AS mention, {_ENTITY.format("'Customer  ' || s_suppkey % 60")} AS surface, s_nationkey AS scope, s_suppkey % 9 = 0 AS sensitive FROM supplier),
    r AS (SELECT c_custkey AS node, {_ENTITY.format("'Customer ' || c_custkey % 60")} AS name, c_nationkey AS scope, c_custkey % 4 = 0 AS active, c_custkey % 11 = 0 AS sensitive FROM customer),
    s AS (SELECT mention, node, m.sensitive AS ms, r.sensitive AS rs, round(least(1.0, 0.7 + CASE WHEN m.scope = r.scope THEN 0.15 ELSE 0 END + 0.1 + CASE WHEN active THEN 0.05 ELSE 0 END), 6) AS score FROM m JOIN r ON r.name = m.surface),
    k AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second, count(*) OVER (PARTITION BY mention) AS n FROM s WINDOW w AS (PARTITION BY mention ORDER BY score DESC, node))
    SELECT mention, CASE WHEN k.mention IS NULL THEN 'new' WHEN score >= CASE WHEN ms OR rs THEN 0.98 ELSE 0.9 END AND (second IS NULL OR round(score - second, 6) >= 0.03) THEN 'existing' ELSE 'ambiguous' END AS result, node, CAST(score AS DOUBLE) AS score FROM k WHERE place = 1""")
def entity_resolution(spark, d):
    from ..functions import text
    from ..operators import cognition

    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    mentions = s.select(F.col("s_suppkey").alias("mention"), text.collapse(F.concat(F.lit("Customer  "), (F.col("s_suppkey") % 60).cast("string"))).alias("name"), F.col("s_nationkey").alias("scope"), (F.col("s_suppkey") % 9 == 0).alias("sensitive"))
    records = c.select(F.col("c_custkey").alias("node"), text.collapse(F.concat(F.lit("Customer "), (F.col("c_custkey") % 60).cast("string"))).alias("name"), F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 4 == 0).alias("active"), (F.col("c_custkey") % 11 == 0).alias("sensitive"))
    return cognition.resolve(mentions, records).where("result <> 'new'").select("mention", "result", "node", F.round("score", 6).alias("score"))


@query(f"""WITH {CLAIMS_SQL}, cur AS (SELECT subject, predicate, min(claim_id) AS claim_id FROM claims WHERE tx_to IS NULL OR family = 0 GROUP BY 1, 2), c AS (SELECT x.* FROM claims x JOIN cur USING (subject, predicate, claim_id)),
    p AS (SELECT event_id, user_id AS subject, CASE WHEN event_id % 20 = 0 THEN 'none' ELSE event_type END AS predicate, CAST(event_id % 5 AS INTEGER) AS object, epoch_us(ts) - 3600000000 AS s, event_id % 4 AS family, event_id % 3 = 0 AS explicit FROM events WHERE event_id % 2 = 1)
    SELECT p.event_id, CASE WHEN c.claim_id IS NULL THEN 'new' WHEN c.family % 2 <> p.family % 2 THEN 'scoped_coexistence' WHEN c.object = p.object AND (c.valid_to IS NULL OR p.s < c.valid_to) AND c.valid_from < p.s + 86400000000 THEN 'duplicate'
        WHEN NOT ((c.valid_to IS NULL OR p.s < c.valid_to) AND c.valid_from < p.s + 86400000000) OR (explicit AND p.s > c.valid_from AND c.object <> p.object) THEN 'temporal_transition'
        WHEN starts_with(CAST(p.object AS VARCHAR), CAST(c.object AS VARCHAR)) AND length(CAST(p.object AS VARCHAR)) > length(CAST(c.object AS VARCHAR)) THEN 'refinement' WHEN p.predicate IN ('click', 'view') THEN 'independent_evidence' ELSE 'contradiction' END AS change
    FROM p LEFT JOIN c ON c.subject = p.subject AND c.predicate = p.predicate""")
def claim_change(spark, d):
    from ..operators import cognition

    c = claims(spark, d).where("tx_to is null or family = 0")
    e = table(spark, d, "events").where("event_id % 2 = 1")
    start = micros("ts") - 3_600_000_000
    p = e.select("event_id", F.col("user_id").alias("subject"), F.when(F.col("event_id") % 20 == 0, "none").otherwise(F.col("event_type")).alias("predicate"), (F.col("event_id") % 5).cast("string").alias("object"), start.alias("valid_from"), (start + 86_400_000_000).alias("valid_to"), (F.col("event_id") % 2).cast("string").alias("scope"), (F.col("event_id") % 3 == 0).alias("explicit"), F.col("event_type").isin("click", "view").alias("many"))
    current = c.select("claim_id", "subject", "predicate", F.col("object").cast("string").alias("object"), "valid_from", "valid_to", (F.col("family") % 2).cast("string").alias("scope"))
    return cognition.classify(p, current).select("event_id", "change")


@query("""WITH a AS (SELECT p_partkey, p_brand || p_type AS f FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey, p_brand || p_type AS f FROM part WHERE p_partkey % 2 = 1),
    ua AS (SELECT f, min(p_partkey) AS k FROM a GROUP BY f HAVING count(*) = 1), ub AS (SELECT f, min(p_partkey) AS k FROM b GROUP BY f HAVING count(*) = 1)
    SELECT a.p_partkey, CASE WHEN ua.k IS NOT NULL THEN ub.k END AS before FROM a LEFT JOIN ua ON ua.f = a.f AND ua.k = a.p_partkey LEFT JOIN ub ON ub.f = a.f""")
def fingerprint_continuity(spark, d):
    """A symbol keeps its identity if its fingerprint is there once in the parent snapshot and once in this one."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("f"))
    a, b = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")
    once = lambda df, name: df.groupBy("f").agg(F.count("*").alias("n"), F.min("p_partkey").alias(name)).where("n = 1").drop("n")
    both = once(a, "own").join(once(b, "before"), "f")
    return a.join(both.select(F.col("own").alias("p_partkey"), "before"), "p_partkey", "left").select("p_partkey", "before")


@query("SELECT doc_id, page_id, substr(text, 1, 12) AS part FROM documents JOIN pages ON page_id = doc_id WHERE length(text) >= 12 AND strpos(left(text, 12), chr(10)) = 0")
def symbol_to_file(spark, d):
    from ..functions import text

    files = table(spark, d, "documents").select("doc_id", "text")
    symbols = table(spark, d, "pages").select("page_id")
    part = text.source_range("text", F.lit(1), F.lit(0), F.lit(1), F.lit(12))
    return symbols.join(files, F.col("page_id") == F.col("doc_id")).select("doc_id", "page_id", part.alias("part")).where("part is not null")


@query("""WITH t AS (SELECT l_orderkey AS run, list_sort(list(DISTINCT l_partkey)) AS tests FROM lineitem GROUP BY 1), i AS (SELECT s_suppkey AS symbol, [s_suppkey, s_suppkey + 7] AS tests FROM supplier) SELECT symbol, max(run) AS run FROM i JOIN t ON list_has_any(i.tests, t.tests) GROUP BY symbol""")
def ci_evidence(spark, d):
    """The last run that holds one of a symbol's tests: an equi-join on tests, the greatest run by aggregation."""
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("test"))
    symbols = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.explode(F.array("s_suppkey", F.col("s_suppkey") + 7)).alias("test"))
    last = runs.groupBy("test").agg(F.max("run").alias("run"))
    return symbols.join(last, "test").groupBy("symbol").agg(F.max("run").alias("run"))


@query("""SELECT r.event_id, CASE WHEN s.user_id IS NULL THEN 'fresh' WHEN s.digest = sha256(r.event_type) THEN 'replay' ELSE 'conflict' END AS outcome FROM events r LEFT JOIN (SELECT user_id, sha256(arg_min(event_type, event_id)) AS digest, min(event_id) AS first FROM events WHERE event_id % 2 = 0 GROUP BY user_id) s ON s.user_id = r.user_id AND s.first < r.event_id""")
def idempotency(spark, d):
    e = table(spark, d, "events")
    receipts = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.sha2(F.min_by("event_type", "event_id"), 256).alias("digest"), F.min("event_id").alias("first"))
    both = e.join(receipts, "user_id", "left")
    seen = F.col("first") < F.col("event_id")
    return both.select("event_id", F.when(F.coalesce(seen, F.lit(False)), F.when(F.col("digest") == F.sha2("event_type", 256), "replay").otherwise("conflict")).otherwise("fresh").alias("outcome"))


@query("SELECT DISTINCT a.label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.label % 3 <> b.label % 3")
def reindex_plan(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"))
    return v.join(after, "vec_id").where("label % 3 <> other % 3").select("label").distinct()


# Windows.


@query("SELECT event_id, user_id, row_number() OVER w AS revision, event_type AS lifecycle, lead(event_id) OVER w AS closed_by FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lifecycle_revisions(spark, d):
    """Each change of a lifecycle is a revision that closes the one before it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("revision"), F.col("event_type").alias("lifecycle"), F.lead("event_id").over(w).alias("closed_by"))


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR) || coalesce(event_type, '')) AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT user_id, event_id, k, sha256(own) AS link FROM h WHERE k = 1 UNION ALL SELECT h.user_id, h.event_id, h.k, sha256(c.link || h.own) FROM c JOIN h ON h.user_id = c.user_id AND h.k = c.k + 1)
    SELECT user_id, count(*) AS links, CAST(0 AS BIGINT) AS broken FROM c GROUP BY user_id""")
def audit_chain_verify(spark, d):
    """Each stored link against the link before it and the record: no broken ones here. One window a chain, no fold."""
    from ..operators import capture

    rows = table(spark, d, "events").select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), F.coalesce("event_type", F.lit(""))).alias("record"))
    stored = capture.digest_chain(rows).join(rows, ["user_id", "event_id"])
    before = F.coalesce(F.lag("link").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    checked = stored.withColumn("again", F.sha2(F.concat(before, F.sha2("record", 256)), 256))
    return checked.groupBy("user_id").agg(F.count("*").alias("links"), F.count_if(F.col("again") != F.col("link")).alias("broken"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS workspace_seq, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS ordinal FROM events")
def tenant_sequences(spark, d):
    order = ("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("workspace_seq"), F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy(*order)).alias("ordinal"))


@query(f"WITH {CLAIMS_SQL} SELECT subject, claim_id, tx_from, CASE WHEN revision = 1 THEN 'asserted' WHEN negative THEN 'retracted' ELSE 'revised' END AS reason, claim_id || ':' || family AS citation FROM claims")
def knowledge_timeline(spark, d):
    reason = F.when(F.col("revision") == 1, "asserted").when(F.col("negative"), "retracted").otherwise("revised")
    return claims(spark, d).select("subject", "claim_id", "tx_from", reason.alias("reason"), F.concat_ws(":", F.col("claim_id").cast("string"), F.col("family").cast("string")).alias("citation")).orderBy("tx_from", "claim_id")


@query(f"WITH RECURSIVE {EDGES_SQL}, w(node, spot, hop) AS (SELECT child, child, 0 FROM edges WHERE left(child, 1) = 's' UNION ALL SELECT node, parent, hop + 1 FROM w JOIN edges ON child = spot) SELECT node, spot AS ancestor, max(hop) OVER (PARTITION BY node) - hop AS age FROM w")
def symbol_history(spark, d):
    """A symbol's place in each ancestor snapshot, oldest first."""
    starts = edges(spark, d).where(F.startswith("child", F.lit("s"))).select("child").distinct()
    up = graph.climb(edges(spark, d), starts.withColumnRenamed("child", "node"), 8)
    return up.select("node", F.col("above").alias("ancestor"), (F.max("hop").over(Window.partitionBy("node")) - F.col("hop")).alias("age"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS unmeasured, floor(abs(value)) AS total, floor(abs(value) / 2) AS hits, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events),
    w AS (SELECT *, sum(CASE WHEN unmeasured THEN 0 ELSE total END) OVER f AS t, sum(CASE WHEN unmeasured THEN 0 ELSE hits END) OVER f AS h, sum(CASE WHEN unmeasured THEN 0 ELSE 1 END) OVER f AS n FROM e WINDOW f AS (PARTITION BY user_id, part ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, CAST(n AS BIGINT) AS samples, CASE WHEN unmeasured OR n < 2 THEN 'unmeasured' WHEN h * 10000 >= t * 4900 THEN 'reuse' ELSE 'miss' END AS residency FROM w""")
def cache_samples(spark, d):
    """The last four measured samples; one that isn't measured starts anew."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("unmeasured"), F.floor(F.abs("value")).alias("total"), F.floor(F.abs("value") / 2).alias("hits"))
    e = e.withColumn("part", F.sum(F.col("unmeasured").cast("int")).over(Window.partitionBy("user_id").orderBy("event_id")))
    f = Window.partitionBy("user_id", "part").orderBy("event_id").rowsBetween(-3, 0)
    of = lambda c: F.sum(F.when(F.col("unmeasured"), F.lit(0)).otherwise(c)).over(f)
    w = e.withColumn("t", of(F.col("total"))).withColumn("h", of(F.col("hits"))).withColumn("n", of(F.lit(1)))
    return w.select("user_id", "event_id", F.col("n").alias("samples"), F.when(F.col("unmeasured") | (F.col("n") < 2), "unmeasured").when(F.col("h") * 10_000 >= F.col("t") * 4900, "reuse").otherwise("miss").alias("residency"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) SELECT conv_id, turn, n FROM t WHERE upto <= 400 OR upto = n""")
def rolling_eviction(spark, d):
    """The newest turns of a conversation that fit; older ones go as whole turns, the last stays whatever its size."""
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n")).withColumn("upto", upto)
    return t.where("upto <= 400 or upto = n").select("conv_id", "turn", "n")


@query("""WITH c AS (SELECT l_suppkey AS child, l_partkey AS parent, max(l_linenumber) AS source, max(CAST(floor(l_discount * 100000) AS BIGINT)) AS confidence FROM lineitem WHERE l_discount >= 0.03 GROUP BY 1, 2)
    SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY source DESC, confidence DESC, parent) AS place FROM c QUALIFY place <= 3""")
def hierarchy_parents(spark, d):
    """Of each child's candidates the best few parents, by where they come from, then confidence; the first is the primary one."""
    c = table(spark, d, "lineitem").where("l_discount >= 0.03").groupBy(F.col("l_suppkey").alias("child"), F.col("l_partkey").alias("parent")).agg(F.max("l_linenumber").alias("source"), F.max(F.floor(F.col("l_discount") * 100_000).cast("long")).alias("confidence"))
    place = F.row_number().over(Window.partitionBy("child").orderBy(F.desc("source"), F.desc("confidence"), "parent"))
    return c.withColumn("place", place).where("place <= 3").select("child", "parent", "place")


@query(f"""WITH {CLAIMS_SQL}, live AS (SELECT *, tx_from <= {MID_SQL} AS known FROM claims), gone AS (SELECT subject, predicate, object FROM live WHERE known AND negative AND valid_from <= {AT + 10**12}),
    s AS (SELECT l.* FROM live l ANTI JOIN gone g ON g.subject = l.subject AND g.predicate = l.predicate AND g.object = l.object WHERE known AND NOT negative AND valid_from <= {AT + 10**12} AND (valid_to IS NULL OR {AT + 10**12} < valid_to + 86400000000)),
    n AS (SELECT subject, predicate, count(DISTINCT object) AS n FROM s GROUP BY 1, 2), b AS (SELECT subject, predicate, min(CASE WHEN valid_from > {AT + 10**12} THEN valid_from WHEN valid_to + 86400000000 > {AT + 10**12} THEN valid_to + 86400000000 END) AS until FROM live WHERE known GROUP BY 1, 2)
    SELECT b.subject, b.predicate, CASE WHEN b.subject % 10 = 9 THEN 'incomplete' WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'known' ELSE 'conflict' END AS state, until AS valid_until FROM b LEFT JOIN n USING (subject, predicate)""")
def resolved_state(spark, d):
    """A slot's state at a commit and a time, what retracts taken off, with the next moment at which it may change; slots that aren't complete say so."""
    rows = at_mid(spark, d).where("tx_from <= mid").withColumn("valid_to", F.col("valid_to") + 86_400_000_000)
    return truth.resolve(rows, AT + 10**12, F.col("subject") % 10 != 9)


@query(f"""WITH {CLAIMS_SQL}, n AS (SELECT subject, count(DISTINCT object) FILTER (NOT negative AND tx_to IS NULL) AS v, count(*) FILTER (negative) AS q FROM claims GROUP BY subject)
    SELECT subject, CASE WHEN v = 1 THEN 'supported' WHEN v > 1 THEN 'disputed' WHEN q > 0 THEN 'unknown_open_question' ELSE 'unknown_no_claim' END AS state FROM n""")
def knowledge_query_state(spark, d):
    n = claims(spark, d).groupBy("subject").agg(F.count_distinct(F.when(~F.col("negative") & F.col("tx_to").isNull(), F.col("object"))).alias("v"), F.count_if("negative").alias("q"))
    return n.select("subject", F.when(F.col("v") == 1, "supported").when(F.col("v") > 1, "disputed").when(F.col("q") > 0, "unknown_open_question").otherwise("unknown_no_claim").alias("state"))


@query("SELECT user_id, event_id, epoch_us(ts) AS at, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def timeline_limit(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, d, "events").withColumn("p", place).where("p <= 5").select("user_id", "event_id", micros("ts").alias("at"), F.col("event_type").alias("state"))
