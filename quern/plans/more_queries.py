"""Further reads: routes checked again, generations published, schemas, jobs and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, values
from ..operators import graph, revisions, scans
from ..sources.tables import CLAIMS_SQL, EDGES_SQL, claims, edges, micros, table
from .registry import AT, query


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'maximum' END AS fault FROM events")
def schema_validation(spark, d):
    """props against a schema with one whole number of at most 90: what is wrong, null if nothing is."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", F.when(k.isNull(), "missing").when(k > 90, "maximum").alias("fault"))


@query("SELECT event_id, event_type AS kind, CASE event_type WHEN 'view' THEN CAST(event_id AS VARCHAR) WHEN 'click' THEN props ELSE event_type END AS value FROM events")
def claim_objects(spark, d):
    """Values of several kinds as tag and text."""
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", kind.alias("kind"), F.when(kind == "view", F.col("event_id").cast("string")).when(kind == "click", F.col("props")).otherwise(kind).alias("value"))


@query("SELECT event_id, '{\"at\":' || epoch_us(ts) || ',\"kind\":\"' || event_type || '\"}' AS json FROM events")
def compact_json(spark, d):
    return table(spark, d, "events").select("event_id", values.canonical(kind="event_type", at=micros("ts")).alias("json"))


@query(f"WITH {EDGES_SQL}, r AS (SELECT a.parent AS root, a.child AS mid, b.child AS leaf FROM edges a JOIN edges b ON b.parent = a.child) SELECT root, mid, leaf, leaf NOT LIKE '%3' AS valid FROM r WHERE root = 'r1'")
def validate_routes(spark, d):
    """Cached routes held against the edges of now: one that lost an edge isn't valid."""
    e = edges(spark, d)
    b = e.select(F.col("parent").alias("mid"), F.col("child").alias("leaf"))
    routes = e.where("parent = 'r1'").select(F.col("parent").alias("root"), F.col("child").alias("mid")).join(b, "mid")
    now = b.where(~F.endswith("leaf", F.lit("3"))).withColumn("ok", F.lit(True))
    return routes.join(now, ["mid", "leaf"], "left").select("root", "mid", "leaf", F.coalesce("ok", F.lit(False)).alias("valid"))


@query(f"WITH {EDGES_SQL} SELECT parent AS node, count(*) AS children, min(child) AS first FROM edges WHERE parent IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) GROUP BY parent")
def resolve_nodes(spark, d):
    ok = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent"))
    return edges(spark, d).join(ok, "parent", "left_semi").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.min("child").alias("first"))


@query(f"WITH {EDGES_SQL}, gone AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal < 0) SELECT parent, child, 2 AS generation FROM edges WHERE child NOT IN (SELECT node FROM gone)")
def publish_generation(spark, d):
    """A new generation without members that were deleted since it was built; checked for cycles before it is shown."""
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"))
    new = edges(spark, d).join(gone, "child", "left_anti")
    if not graph.acyclic(new):
        raise ValueError("the generation holds a cycle")
    return new.select("parent", "child", F.lit(2).alias("generation"))


@query("SELECT 's' || s_suppkey AS node, 'balance' AS reason FROM supplier WHERE s_acctbal < 0")
def record_deletions(spark, d):
    return table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("balance").alias("reason"))


@query("SELECT event_id, 'balanced' AS lineage FROM events WHERE event_id - (event_id % 7 + 1) * 3 >= 0 AND event_id % 5 <> 0")
def lineage_acyclicity(spark, d):
    """Derivations that go back in time only can't hold a cycle: those that are sound."""
    i = F.col("event_id")
    return table(spark, d, "events").where((i - (i % 7 + 1) * 3 >= 0) & (i % 5 != 0)).select("event_id", F.lit("balanced").alias("lineage"))


@query("SELECT o_custkey AS run, count(*) AS requests, count(*) FILTER (o_orderstatus = 'F') AS results, sum(length(o_orderpriority)) AS parts FROM orders GROUP BY 1")
def model_requests(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("requests"), F.count_if(F.col("o_orderstatus") == "F").alias("results"), F.sum(F.length("o_orderpriority")).alias("parts"))


@query(f"""WITH {CLAIMS_SQL}, h AS (SELECT subject, predicate, claim_id, object, valid_from, valid_to FROM claims WHERE tx_to IS NULL AND NOT negative) SELECT a.subject, a.claim_id AS a, b.claim_id AS b FROM h a JOIN h b ON a.subject = b.subject AND a.claim_id < b.claim_id AND a.object <> b.object
    WHERE a.valid_from < coalesce(b.valid_to, {AT} * 2) AND b.valid_from < coalesce(a.valid_to, {AT} * 2)""")
def rebuild_conflicts(spark, d):
    """Pairs of a subject's open heads that differ and overlap: at most a head for each predicate meets."""
    h = claims(spark, d).where("tx_to is null and not negative")
    far = F.lit(AT * 2)
    side = lambda t: h.select("subject", *(F.col(c).alias(f"{c}_{t}") for c in ("claim_id", "object", "valid_from", "valid_to")))
    both = side("a").join(side("b"), "subject").where("claim_id_a < claim_id_b and object_a <> object_b")
    meet = (F.col("valid_from_a") < F.coalesce("valid_to_b", far)) & (F.col("valid_from_b") < F.coalesce("valid_to_a", far))
    return both.where(meet).select("subject", F.col("claim_id_a").alias("a"), F.col("claim_id_b").alias("b"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, CASE WHEN count(*) FILTER (event_type = 'error') >= 10 THEN 'open' ELSE 'closed' END AS state FROM events GROUP BY user_id")
def admission_state(spark, d):
    n = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(n.alias("failures"), F.when(n >= 10, "open").otherwise("closed").alias("state"))


@query("SELECT event_id, (event_id * 25214903917 + 11) % 281474976710656 AS drawn FROM events")
def seeded_draws(spark, d):
    """Reproducible draws by a congruence of 48 bits, the same on any machine."""
    x = F.col("event_id").cast("decimal(38,0)") * F.lit(25214903917).cast("decimal(19,0)") + F.lit(11)
    return table(spark, d, "events").select("event_id", (x % F.lit(281474976710656).cast("decimal(19,0)")).cast("long").alias("drawn"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 1000000 + 0.5) AS BIGINT) AS micros FROM lineitem")
def confidence_micros(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_discount") * numbers.MICRO + 0.5).cast("long").alias("micros"))


@query("SELECT conv_id, turn, strlen(text) AS bytes, sha256(text) AS digest FROM conversations WHERE strlen(text) <= 1048576")
def materialized_originals(spark, d):
    raw = F.encode("text", "UTF-8")
    return table(spark, d, "conversations").where(F.octet_length("text") <= 1 << 20).select("conv_id", "turn", F.octet_length(raw).alias("bytes"), F.sha2(raw, 256).alias("digest"))


@query("SELECT p_partkey AS artifact, p_brand AS locator, p_size AS parts FROM part WHERE p_size >= 10")
def artifact_reads(spark, d):
    return table(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("artifact"), F.col("p_brand").alias("locator"), F.col("p_size").alias("parts"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1")
def first_of_key(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy("user_id", "props").agg(F.min("event_id").alias("event_id")).select("event_id")
    return e.join(first, "event_id", "left_semi").select("event_id", "event_type")


@query("SELECT c_custkey, c_mktsegment || ':' || c_nationkey AS scope, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS place FROM customer")
def canonical_membership(spark, d):
    place = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("scope"), place.alias("place"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) AS tokens, lang FROM documents WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) <= 200")
def prepared_candidates(spark, d):
    """Blocks whose whole form fits a unit's budget."""
    from ..functions import text

    return table(spark, d, "documents").select("doc_id", text.token_count("text").alias("tokens"), "lang").where("tokens <= 200")


@query("SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events")
def policy_epochs(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w).alias("epoch"))


@query("SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) * 9 // 10 FROM events) ORDER BY event_id")
def uncheckpointed_tail(spark, d):
    e = table(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.expr("max(event_id) * 9 div 10").alias("c")))).where("event_id > c").select("event_id", "user_id")


@query("SELECT term, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda t: length(t) >= 6)) AS term FROM documents) GROUP BY term HAVING count(*) >= 20")
def index_terms(spark, d):
    """Terms that many documents have."""
    from ..functions import text

    p = revisions.postings(table(spark, d, "documents"), "doc_id", text.token_set("text", 6))
    return p.groupBy("term").agg(F.count("*").alias("documents")).where("documents >= 20")


@query("SELECT user_id AS slot, max(event_id) AS last, arg_max(event_type, event_id) AS state FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1")
def open_view(spark, d):
    """The built half of an index as one row a slot."""
    e = table(spark, d, "events")
    half = e.join(F.broadcast(e.agg(F.expr("max(event_id) div 2").alias("h")))).where("event_id <= h").select(F.col("user_id").alias("slot"), F.col("event_id").alias("last"), F.col("event_type").alias("state"))
    return scans.latest(half, ["slot"], "last")
