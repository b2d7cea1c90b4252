"""Queries over the forms of the access predicate and what decides how a record may be used."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import policy
from ..sources.tables import DOCUMENTS_SQL, documents, table
from .registry import ALLOWED_SQL, BASE_SQL, GRANTED_SQL, LEGACY_SQL, PRINCIPAL, query

_SPACES_SQL = f"{DOCUMENTS_SQL}, spaced AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN ['s' || doc_id % 4] ELSE [] END AS spaces FROM docs)"


def _spaced(spark, d):
    i = F.col("doc_id")
    return documents(spark, d).withColumn("spaces", F.when(i % 3 == 1, F.array(F.concat(F.lit("s"), (i % 4).cast("string")))).otherwise(F.array().cast("array<string>")))


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE {BASE_SQL} AND CASE WHEN len(grants) = 0 THEN {LEGACY_SQL.format(['en', '*', 'team'])} ELSE {GRANTED_SQL.format(['export'])} END")
def service_authorized(spark, d):
    return documents(spark, d).where(policy.allows_service(PRINCIPAL)).select("doc_id")


@query(f"""WITH {_SPACES_SQL} SELECT doc_id FROM spaced WHERE {BASE_SQL} AND len(list_filter(compartments, lambda c: c <> 'src1')) = 0 AND list_contains(purposes, 'export') AND (len(spaces) = 0 OR list_has_any(spaces, ['s1', 's2']))
    AND len(list_filter(list_append(grants, {{'audience': 'space:s1', 'purposes': ['export']}}), lambda g: list_contains(g.purposes, 'export') AND (list_contains(['public', 'en', 'group:team', 'space:s1', 'space:s2'], g.audience) OR (g.audience = 'owner' AND list_contains(owners, 'en'))))) > 0""")
def graph_authorized(spark, d):
    more = F.array_append("grants", F.struct(F.lit("space:s1").alias("audience"), F.array(F.lit("export")).alias("purposes")))
    return _spaced(spark, d).withColumn("grants", more).where(policy.allows_graph(PRINCIPAL, ("s1", "s2"))).select("doc_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE {BASE_SQL} AND len(list_filter(compartments, lambda c: c NOT IN ('src1', 'src2', 'src3', 'src10'))) = 0 AND {GRANTED_SQL.format(['export', '*'])}")
def recall_authorized(spark, d):
    return documents(spark, d).where(policy.allows_recall(PRINCIPAL)).select("doc_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, list_sort(list_distinct(list_concat(['en', '*', 'team'], CASE WHEN list_contains(owners, 'en') THEN ['@owner'] ELSE [] END))) AS keys FROM docs")
def audience_keys(spark, d):
    keys = F.when(policy.is_owner(PRINCIPAL), policy._strings(PRINCIPAL.keys(owner=True))).otherwise(policy._strings(PRINCIPAL.keys()))
    return documents(spark, d).select("doc_id", F.array_sort(keys).alias("keys"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id, workspace, array_to_string(scopes, ',') AS scopes, array_to_string(list_transform(grants, lambda g: g.audience || '=' || array_to_string(g.purposes, '+')), ';') AS grants, sensitivity, consent AND retrievable AS open FROM docs""")
def policy_build(spark, d):
    flat = F.array_join(F.transform("grants", lambda g: F.concat(g["audience"], F.lit("="), F.array_join(g["purposes"], "+"))), ";")
    return documents(spark, d).select("doc_id", "workspace", F.array_join("scopes", ",").alias("scopes"), flat.alias("grants"), "sensitivity", (F.col("consent") & F.col("retrievable")).alias("open"))


@query(f"WITH {DOCUMENTS_SQL} SELECT source, count(*) AS n, min(doc_id) AS first FROM docs WHERE {ALLOWED_SQL} GROUP BY source")
def authorized_universe(spark, d):
    """Ids are admitted by metadata alone; contents are never read."""
    return documents(spark, d).where(policy.allows(PRINCIPAL)).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, s AS scope FROM (SELECT doc_id, unnest(scopes) AS s, workspace, owners FROM docs) WHERE workspace = 1 AND s IN ('src1', 'src2')")
def policy_index_lookup(spark, d):
    return documents(spark, d).where("workspace = 1").select("doc_id", F.explode("scopes").alias("scope")).where(F.col("scope").isin("src1", "src2"))


_EDGE_SQL = "links AS (SELECT doc_id AS source_id, doc_id + 3 AS target_id FROM documents UNION ALL SELECT doc_id, doc_id + 6 FROM documents WHERE doc_id % 2 = 0)"


def _links(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + 3).alias("target_id")).unionByName(docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + 6).alias("target_id")))


@query(f"WITH {DOCUMENTS_SQL}, {_EDGE_SQL}, ok AS (SELECT doc_id FROM docs WHERE {ALLOWED_SQL}) SELECT source_id, target_id FROM links WHERE source_id IN (SELECT doc_id FROM ok) AND target_id IN (SELECT doc_id FROM ok)")
def corpus_authorize(spark, d):
    """Relations stay if both ends are admitted."""
    ok = documents(spark, d).where(policy.allows(PRINCIPAL)).select("doc_id")
    links = _links(spark, d)
    return links.join(ok.withColumnRenamed("doc_id", "source_id"), "source_id", "left_semi").join(ok.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE {ALLOWED_SQL} AND doc_id <= (SELECT max(doc_id) * 2 // 3 FROM documents) AND (deleted_at IS NULL OR deleted_at > (SELECT max(doc_id) * 2 // 3 FROM documents))")
def lexical_authorize(spark, d):
    """Projected by the snapshot, not yet deleted then, and admitted."""
    at = F.broadcast(table(spark, d, "documents").agg(F.expr("max(doc_id) * 2 div 3").alias("at")))
    return documents(spark, d).join(at).where(policy.allows(PRINCIPAL) & (F.col("doc_id") <= F.col("at")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("at")))).select("doc_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT vec_id, label FROM embeddings JOIN docs ON doc_id = vec_id WHERE {ALLOWED_SQL}")
def vector_authorize(spark, d):
    ok = documents(spark, d).where(policy.allows(PRINCIPAL)).select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(ok, "vec_id", "left_semi")


@query(f"WITH {DOCUMENTS_SQL} SELECT page_id, strlen(html) AS bytes FROM pages JOIN docs ON doc_id = page_id WHERE {ALLOWED_SQL}")
def artifact_authorize(spark, d):
    ok = documents(spark, d).where(policy.allows(PRINCIPAL)).select(F.col("doc_id").alias("page_id"))
    return table(spark, d, "pages").join(ok, "page_id", "left_semi").select("page_id", F.octet_length("html").alias("bytes"))


# Policies that change: the revision at the snapshot must admit, and the head's, too.

POLICIES_SQL = """policies AS (SELECT user_id AS id, event_id AS tx_from, lead(event_id) OVER w AS tx_to, event_id % 4 AS sensitivity, CASE WHEN event_type = 'error' THEN 'suppressed' WHEN event_type = 'signup' THEN 'retracted' ELSE 'active' END AS lifecycle
    FROM events WHERE event_id % 5 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
_MID = "(SELECT max(event_id) * 2 // 3 FROM events)"


def policies(spark, d):
    """Revisions of a policy for each user, with the snapshot's commit as `mid`."""
    e = table(spark, d, "events")
    w = Window.partitionBy("id").orderBy("tx_from")
    state = F.when(F.col("event_type") == "error", "suppressed").when(F.col("event_type") == "signup", "retracted").otherwise("active")
    rows = e.where("event_id % 5 <> 0").select(F.col("user_id").alias("id"), F.col("event_id").alias("tx_from"), (F.col("event_id") % 4).alias("sensitivity"), state.alias("lifecycle"))
    return rows.withColumn("tx_to", F.lead("tx_from").over(w)).join(F.broadcast(e.agg(F.expr("max(event_id) * 2 div 3").alias("mid"))))


@query(f"WITH {POLICIES_SQL} SELECT id, sensitivity, lifecycle FROM policies WHERE tx_from <= {_MID} AND (tx_to IS NULL OR {_MID} < tx_to)")
def asof_policy(spark, d):
    return policies(spark, d).where("tx_from <= mid and (tx_to is null or mid < tx_to)").select("id", "sensitivity", "lifecycle")


@query(f"""WITH {POLICIES_SQL}, head AS (SELECT id FROM policies WHERE tx_to IS NULL AND lifecycle = 'active' AND sensitivity <= 2)
    SELECT p.id, p.tx_from, p.sensitivity FROM policies p WHERE p.tx_from <= {_MID} AND p.id IN (SELECT id FROM head)""")
def current_use_overlay(spark, d):
    """A read of history asks the head's policy first: suppressed, retracted or now secret records give nothing, whatever they were."""
    p = policies(spark, d)
    head = p.where("tx_to is null and lifecycle = 'active' and sensitivity <= 2").select("id")
    return p.where("tx_from <= mid").join(head, "id", "left_semi").select("id", "tx_from", "sensitivity")


@query(f"""WITH {POLICIES_SQL}, head AS (SELECT id FROM policies WHERE tx_to IS NULL AND lifecycle NOT IN ('suppressed', 'retracted') AND sensitivity <= 2)
    SELECT p.id, p.tx_from FROM policies p WHERE p.tx_from <= {_MID} AND (p.tx_to IS NULL OR {_MID} < p.tx_to) AND p.lifecycle = 'active' AND p.sensitivity <= 2 AND p.id IN (SELECT id FROM head)""")
def current_authorized_metadata(spark, d):
    p = policies(spark, d)
    head = p.where("tx_to is null and lifecycle not in ('suppressed', 'retracted') and sensitivity <= 2").select("id")
    seen = p.where("tx_from <= mid and (tx_to is null or mid < tx_to) and lifecycle = 'active' and sensitivity <= 2")
    return seen.join(head, "id", "left_semi").select("id", "tx_from")


# Recall's own tests.

_TEMPORAL_SQL = """facts AS (SELECT event_id AS id, event_id AS tx_from, event_id + 400 AS tx_to, epoch_us(ts) AS valid_from, CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) + 864000000000 END AS valid_to,
    CASE event_id % 6 WHEN 0 THEN 'superseded' WHEN 1 THEN 'resolved_loser' WHEN 2 THEN 'unresolved' ELSE 'none' END AS conflict FROM events)"""


def _facts(spark, d):
    from ..sources.tables import micros

    i = F.col("event_id")
    conflict = F.when(i % 6 == 0, "superseded").when(i % 6 == 1, "resolved_loser").when(i % 6 == 2, "unresolved").otherwise("none")
    return table(spark, d, "events").select(i.alias("id"), i.alias("tx_from"), (i + 400).alias("tx_to"), micros("ts").alias("valid_from"), F.when(i % 4 > 0, micros("ts") + 864_000_000_000).alias("valid_to"), conflict.alias("conflict"))


_NOW, _THEN = 1_705_000_000_000_000, 1_704_500_000_000_000


@query(f"""WITH {_TEMPORAL_SQL}, m AS (SELECT max(event_id) AS top FROM events)
    SELECT 'current' AS mode, id FROM facts, m WHERE tx_from <= top AND top < tx_to AND valid_from <= {_NOW} AND (valid_to IS NULL OR {_NOW} < valid_to) AND conflict NOT IN ('superseded', 'resolved_loser')
    UNION ALL SELECT 'valid_during', id FROM facts, m WHERE tx_from <= top AND top < tx_to AND valid_from < {_NOW} AND (valid_to IS NULL OR {_THEN} < valid_to) AND conflict NOT IN ('superseded', 'resolved_loser')
    UNION ALL SELECT 'known_at', id FROM facts, m WHERE tx_from <= top // 2 AND top // 2 < tx_to
    UNION ALL SELECT 'bitemporal', id FROM facts, m WHERE tx_from <= top // 2 AND top // 2 < tx_to AND valid_from < {_NOW} AND (valid_to IS NULL OR {_THEN} < valid_to)""")
def temporal_visibility(spark, d):
    """Four ways to ask for time; losers of resolved conflicts show in reads of history only (here known_at and bitemporal)."""
    from ..operators import recall

    f = _facts(spark, d).join(F.broadcast(table(spark, d, "events").agg(F.max("event_id").alias("top"))))
    top, half = F.col("top"), F.expr("top div 2")
    seen = [recall.visible("current", top, now=F.lit(_NOW)), recall.visible("valid_during", top, during=(_THEN, _NOW)), recall.visible("known_at", half, history=True), recall.visible("bitemporal", half, during=(_THEN, _NOW), history=True)]
    names = ("current", "valid_during", "known_at", "bitemporal")
    each = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in zip(names, seen))))).alias("mode")
    return f.select("id", each).select("mode", "id")


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE len(owners) = 0 OR list_has_any(owners, ['o1', 'en']) OR contains('notes of src1 and src12', lower(source))""")
def perspective_filter(spark, d):
    """A document shows if it has no subject, one of the participants, or a name that the query says."""
    from ..operators import recall

    return documents(spark, d).where(recall.perspective(F.col("owners"), F.array("source"), ("o1", "en"), "Notes of src1, and src12!")).select("doc_id")


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id, CASE WHEN sensitivity >= 3 OR doc_id % 10 = 0 THEN 'withhold_privacy' WHEN doc_id % 10 = 1 THEN 'withhold_uncertainty' WHEN doc_id % 10 = 2 AND NOT list_contains(owners, 'en') THEN 'withhold_privacy'
    WHEN doc_id % 10 = 3 THEN 'only_constraint' WHEN doc_id % 10 = 4 THEN 'only_style' ELSE 'silently' END AS use FROM docs""")
def memory_use(spark, d):
    from ..operators import recall

    k = F.col("doc_id") % 10
    profile = {"influence": F.when((F.col("sensitivity") >= 3) | (k == 0), "deny").when(k == 1, "conditional").otherwise("allow"), "personal": k == 2, "shared": F.array_contains("owners", "en"), "constraint_only": k == 3, "style_only": k == 4, "mention": k > 6}
    return documents(spark, d).select("doc_id", recall.use_decision(**profile, explicit=False).alias("use"))


@query("""SELECT doc_id, CASE WHEN primary_n = 0 AND need THEN false ELSE primary_n + derived > 0 OR NOT need END AS supported FROM (SELECT doc_id, doc_id % 3 AS primary_n, doc_id % 2 AS derived, doc_id % 5 < 3 AS need FROM documents)""")
def evidence_satisfied(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when((i % 3 == 0) & (i % 5 < 3), False).otherwise((i % 3 + i % 2 > 0) | (i % 5 >= 3)).alias("supported"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE trust >= 500000 OR NOT list_has_any([source], ['src1', 'src2'])""")
def facet_confidence(spark, d):
    """A facet counts if the document's trust reaches the least that any demand for it names."""
    demands = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("least")) for n, t in (("src1", 500_000), ("src2", 400_000))))
    return documents(spark, d).where(F.forall(F.filter(demands, lambda q: q["name"] == F.col("source")), lambda q: F.col("trust") >= q["least"])).select("doc_id")


@query(f"""WITH {DOCUMENTS_SQL} SELECT a.doc_id, len(list_filter(b.scopes, lambda s: NOT list_contains(a.scopes, s))) = 0 AND len(list_filter(b.purposes, lambda s: NOT list_contains(a.purposes, s))) = 0
    AND len(list_filter(b.grants, lambda g: len(list_filter(a.grants, lambda h: h.audience = g.audience AND len(list_filter(g.purposes, lambda p: NOT list_contains(h.purposes, p))) = 0)) = 0)) = 0
    AND list_sort(a.owners) = list_sort(b.owners) AND len(list_filter(a.compartments, lambda s: NOT list_contains(b.compartments, s))) = 0 AND b.sensitivity >= a.sensitivity AS narrows FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 4 * 5""")
def derived_policy(spark, d):
    of = lambda tag: F.struct("scopes", "purposes", "grants", "owners", "compartments", "sensitivity").alias(tag)
    docs = documents(spark, d)
    child = docs.select((F.col("doc_id") - 20).alias("doc_id"), of("child"))
    return docs.select("doc_id", of("parent")).join(child, "doc_id").select("doc_id", policy.narrows("parent", "child").alias("narrows"))


@query(f"WITH {DOCUMENTS_SQL}, deny AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id FROM docs WHERE {ALLOWED_SQL} AND doc_id NOT IN (SELECT doc_id FROM deny)")
def live_deny(spark, d):
    deny = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return documents(spark, d).where(policy.allows(PRINCIPAL)).join(deny, "doc_id", "left_anti").select("doc_id")


@query("WITH grants(family, stance) AS (VALUES (0, 'view'), (0, 'click'), (2, 'purchase'), (3, 'view')) SELECT event_id FROM events JOIN grants ON family = event_id % 4 AND stance = event_type")
def assertion_grants(spark, d):
    grants = spark.createDataFrame([(0, "view"), (0, "click"), (2, "purchase"), (3, "view")], "family long, event_type string")
    return table(spark, d, "events").withColumn("family", F.col("event_id") % 4).join(F.broadcast(grants), ["family", "event_type"], "left_semi").select("event_id")


@query("SELECT event_type AS projection, max(event_id) AS watermark FROM events GROUP BY 1 HAVING max(event_id) < (SELECT max(event_id) FROM events)")
def projection_freshness(spark, d):
    marks = table(spark, d, "events").groupBy(F.col("event_type").alias("projection")).agg(F.max("event_id").alias("watermark"))
    return marks.join(F.broadcast(table(spark, d, "events").agg(F.max("event_id").alias("top")))).where("watermark < top").drop("top")


@query("SELECT c_custkey, least(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 7 END, 4096), 4096) AS tokens, least(c_custkey % 50, 32) AS hops FROM customer")
def budget_clamp(spark, d):
    i = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.least(F.coalesce(F.when(i % 3 == 0, i * 7), F.lit(4096)), F.lit(4096)).alias("tokens"), F.least(i % 50, F.lit(32)).alias("hops"))


@query(f"WITH {DOCUMENTS_SQL} SELECT CASE WHEN doc_id % 3 = 0 THEN 'any' WHEN doc_id % 3 = 1 THEN 'source' ELSE 'family' END AS form, count(*) AS n FROM docs WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND source = 'src3') OR (doc_id % 3 = 2 AND lang = 'de') GROUP BY 1")
def source_constraint(spark, d):
    k = F.col("doc_id") % 3
    form = F.when(k == 0, "any").when(k == 1, "source").otherwise("family")
    return documents(spark, d).where((k == 0) | ((k == 1) & (F.col("source") == "src3")) | ((k == 2) & (F.col("lang") == "de"))).groupBy(form.alias("form")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_nationkey, s_suppkey) AS place FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 5 <> 2 AND s_suppkey % 7 < 5 ORDER BY 2 LIMIT 20""")
def model_route_filter(spark, d):
    """Routes that can do the task, are fast enough and within the budget, best first."""
    ok = table(spark, d, "supplier").where("s_acctbal > 0 and s_nationkey % 5 <> 2 and s_suppkey % 7 < 5").orderBy(F.desc("s_acctbal"), "s_nationkey", "s_suppkey").limit(20)
    return ok.select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_nationkey", "s_suppkey")).alias("place"))


@query("""WITH m AS (SELECT s_suppkey, s_name, lower(s_name) AS n FROM supplier) SELECT n_name, min(s_suppkey) AS symbol FROM nation JOIN m ON n = lower('supplier#' || n_nationkey) OR ends_with(n, lower('#' || n_nationkey)) GROUP BY n_name HAVING count(*) = 1""")
def symbol_match(spark, d):
    """A name stands for a symbol if exactly one has it, or ends with it. Candidates meet on the part after the last sign, so this is an equi-join."""
    last = F.lower(F.regexp_extract("s_name", r"#([^#]*)$", 1))
    symbols = table(spark, d, "supplier").select("s_suppkey", last.alias("tail"))
    wanted = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("tail"))
    return wanted.join(symbols, "tail").groupBy("n_name").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("symbol")).where("n = 1").select("n_name", "symbol")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'purchase') AND user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_id % 6 <> 0")
def raw_metadata_filter(spark, d):
    """Kinds, source and a half-open time range, all pushed to the scan; echoes of requests are left out."""
    e = table(spark, d, "events")
    return e.where("event_type in ('view', 'purchase') and user_id % 4 = 1 and ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20' and event_id % 6 <> 0").select("event_id", "event_type", "user_id")


@query("SELECT doc_id FROM documents WHERE len(list_filter(['and', 'the', 'it'], lambda w: NOT list_contains(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: lower(t)), w))) = 0")
def all_terms_match(spark, d):
    from ..functions import text

    want = F.array(*map(F.lit, ("and", "the", "it")))
    return table(spark, d, "documents").where(F.size(F.array_except(want, text.wordish("text"))) == 0).select("doc_id")


_GATE_TURNS = "(SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS q FROM conversations)"


@query(f"""WITH s AS (SELECT conv_id, turn, regexp_matches(q, 'remember|recall|memory|помнишь|вспомни|раньше|тогда') AS memory, regexp_matches(q, 'это|этот|эта|там|он|она|they|it|that') OR len(string_split(q, ' ')) <= 3 AS vague,
        regexp_matches(q, 'when|before|after|когда|раньше|прошл') AS time, regexp_matches(q, 'we|us|our|together|мы|нам|наш|вместе') AS relation, role = 'user' AS referent FROM {_GATE_TURNS})
    SELECT conv_id, turn, memory OR vague OR time OR relation OR referent AS run, CASE WHEN NOT (memory OR vague OR time OR relation OR referent) THEN 'none' WHEN vague AND referent THEN 'standard' ELSE 'hot' END AS depth,
        CAST(memory AS INTEGER) + CAST(vague AS INTEGER) + CAST(time AS INTEGER) + CAST(relation AS INTEGER) + CAST(referent AS INTEGER) AS n_reasons FROM s""")
def memory_gate(spark, d):
    from ..operators import recall

    gate = recall.gate(F.col("text"), referent=F.col("role") == "user")
    return table(spark, d, "conversations").select("conv_id", "turn", gate["run"].alias("run"), gate["depth"].alias("depth"), F.size(gate["reasons"]).alias("n_reasons"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20 AND (l_returnflag <> 'R' OR l_tax > 0.02) AND l_linestatus = 'O' AND l_discount < 0.08")
def block_satisfies(spark, d):
    """Confidence reached, evidence where it is asked for, accepted and not in conflict."""
    return table(spark, d, "lineitem").where("l_quantity >= 20 and (l_returnflag <> 'R' or l_tax > 0.02) and l_linestatus = 'O' and l_discount < 0.08").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, length(trim(source)) > 0 AND strlen(source) <= 64 AND NOT contains(source, '..') AND NOT starts_with(source, '/') AS valid FROM documents")
def path_validation(spark, d):
    from ..functions import values

    return table(spark, d, "documents").select("doc_id", (values.text_valid("source", 64) & ~F.contains("source", F.lit("..")) & ~F.startswith("source", F.lit("/"))).alias("valid"))


@query(f"WITH {DOCUMENTS_SQL} SELECT scopes, owners, sensitivity, count(*) AS n FROM docs GROUP BY ALL")
def policy_signature_groups(spark, d):
    docs = documents(spark, d)
    groups = docs.groupBy(policy.signature("scopes", "owners", "sensitivity").alias("signature")).agg(F.any_value("scopes").alias("scopes"), F.any_value("owners").alias("owners"), F.any_value("sensitivity").alias("sensitivity"), F.count("*").alias("n"))
    return groups.drop("signature")
