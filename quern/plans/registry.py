"""Registered queries over the operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import capture, graph, measures, policy, retrieval, temporal, truth
from ..sources.steps import settle
from ..sources.tables import CLAIMS_SQL, DOCUMENTS_SQL, EDGES_SQL, claims, documents, edges, micros, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PRINCIPAL = policy.Principal(workspace=1, subject="en", purpose="export", clearance=1, scopes=("src1", "src2", "src3", "src10"), audiences=("team",), compartments=("src1",))
BASE_SQL = "workspace = 1 AND consent AND retrievable AND sensitivity <= 1 AND (len(scopes) = 0 OR list_has_any(scopes, ['src1', 'src2', 'src3', 'src10']))"
GRANTED_SQL = "len(list_filter(grants, lambda g: (list_contains(['en', '*', 'team'], g.audience) OR (g.audience = '@owner' AND list_contains(owners, 'en'))) AND list_has_any(g.purposes, {0}))) > 0"
LEGACY_SQL = "((list_contains(owners, 'en') OR list_has_any(audience, {0})) AND (len(purposes) = 0 OR list_contains(purposes, 'export')))"
ALLOWED_SQL = f"({BASE_SQL} AND CASE WHEN len(grants) = 0 THEN {LEGACY_SQL.format(['en', '*'])} ELSE {GRANTED_SQL.format(['export'])} END)"
WORDS = ["the", "thand", "onthe", "of"]
TOKENS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
AT = 1_705_000_000_000_000
#: Modules of queries beside this one.
MODULES = ("scalar_queries", "policy_queries", "scan_queries", "time_queries", "measure_queries", "graph_queries", "write_queries", "recall_queries", "stream_queries", "more_queries")


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


# Policy and text.


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE {ALLOWED_SQL}")
def authorized_documents(spark, d):
    return documents(spark, d).where(policy.allows(PRINCIPAL)).select("doc_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE workspace = 1 AND len(list_filter(scopes, lambda x: x NOT IN ('src1', 'src2', 'src3', 'src10'))) = 0 AND len(list_filter(compartments, lambda x: x <> 'src1')) = 0 AND (deleted_at IS NULL OR deleted_at > (SELECT max(doc_id) // 2 FROM documents))")
def index_authorized(spark, d):
    upto = table(spark, d, "documents").agg(F.expr("max(doc_id) div 2").alias("upto"))
    return documents(spark, d).join(F.broadcast(upto)).where(policy.allows_index(PRINCIPAL, F.col("upto"))).select("doc_id")


@query(f"""WITH {DOCUMENTS_SQL}, s AS (SELECT doc_id, len(list_intersect(list_distinct({TOKENS_SQL}), ['the', 'thand', 'onthe', 'of'])) / 4.0 AS score FROM docs WHERE {ALLOWED_SQL})
    SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def authorized_lexical_topk(spark, d):
    hits = documents(spark, d).where(policy.allows(PRINCIPAL)).select("doc_id", retrieval.overlap("text", WORDS).alias("score"))
    return hits.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(25)


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), s AS (
    SELECT doc_id, CAST(len(list_filter(t, lambda x: x = 'the')) + len(list_filter(t, lambda x: x = 'thand')) + len(list_filter(t, lambda x: x = 'onthe')) + len(list_filter(t, lambda x: x = 'of')) AS DOUBLE) / sqrt(len(t)) AS score FROM t WHERE len(t) > 0)
    SELECT doc_id, round(score, 9) AS score FROM s WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 50""")
def tf_norm_topk(spark, d):
    s = retrieval.tf_norm(table(spark, d, "documents"), WORDS).withColumn("score", F.round("score", 9))
    return s.orderBy(F.desc("score"), "doc_id").limit(50)


_BM25_SQL = f"""bt AS (SELECT doc_id, {TOKENS_SQL} AS t FROM docs WHERE {ALLOWED_SQL}),
    bq AS (SELECT unnest(['thand', 'onthe', 'of']) AS q), bc AS (SELECT doc_id, q, len(t) AS n, len(list_filter(t, lambda x: x = q)) AS tf FROM bt CROSS JOIN bq),
    bg AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM bt), bf AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM bc GROUP BY q),
    bm AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM bc JOIN bf USING (q) CROSS JOIN bg GROUP BY doc_id)"""


@query(f"WITH {DOCUMENTS_SQL}, {_BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 25")
def bm25_topk(spark, d):
    s = retrieval.bm25(documents(spark, d).where(policy.allows(PRINCIPAL)), WORDS[1:]).withColumn("score", F.round("score", 6))
    return s.orderBy(F.desc("score"), "doc_id").limit(25)


@query("SELECT doc_id, strpos(text, 'and the') AS first_at FROM documents WHERE contains(text, 'and the')")
def phrase_match(spark, d):
    t = table(spark, d, "documents")
    return t.where(F.contains("text", F.lit("and the"))).select("doc_id", F.instr("text", "and the").cast("long").alias("first_at"))


@query("""SELECT i.item_id, n.n_name AS name, CAST(CASE WHEN lower(i.t) = lower(n.n_name) THEN 1.0 WHEN contains(lower(i.t), lower(n.n_name)) THEN 0.9 ELSE 0.7 END AS DOUBLE) AS score
    FROM (SELECT DISTINCT p_partkey AS item_id, p_type || ' ' || n_name AS t FROM part JOIN nation ON p_partkey % 25 = n_nationkey) i JOIN nation n ON contains(lower(i.t), lower(n.n_name)) OR contains(lower(n.n_name), lower(i.t))""")
def alias_match(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey")
    items = table(spark, d, "part").join(F.broadcast(n), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("p_partkey").alias("item_id"), F.concat("p_type", F.lit(" "), "n_name").alias("t")).distinct()
    names = F.broadcast(n.select(F.col("n_name").alias("name")))  # of a fixed number of nations
    t, name = F.lower("t"), F.lower("name")
    return items.join(names, F.contains(t, name) | F.contains(name, t)).select("item_id", "name", F.when(t == name, 1.0).when(F.contains(t, name), 0.9).otherwise(0.7).alias("score"))


# Time.


#: Two thirds of the commits: a snapshot that moves with the table.
MID_SQL = "(SELECT max(event_id) * 2 // 3 FROM events)"


def at_mid(spark, d) -> DataFrame:
    """Claims, each with the snapshot's commit as `mid`."""
    return claims(spark, d).join(F.broadcast(table(spark, d, "events").agg(F.expr("max(event_id) * 2 div 3").alias("mid"))))


@query(f"WITH {CLAIMS_SQL} SELECT subject, predicate, revision, object FROM claims WHERE tx_from <= {MID_SQL} AND (tx_to IS NULL OR {MID_SQL} < tx_to)")
def asof_revision(spark, d):
    return temporal.as_of(at_mid(spark, d), F.col("mid")).select("subject", "predicate", "revision", "object")


@query(f"""WITH {CLAIMS_SQL} SELECT subject, predicate, claim_id, object FROM claims WHERE tx_from <= {MID_SQL} AND (tx_to IS NULL OR {MID_SQL} < tx_to) AND valid_from <= {AT} AND (valid_to IS NULL OR {AT} < valid_to)
    QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY tx_from DESC) = 1""")
def bitemporal_state(spark, d):
    return temporal.bitemporal(at_mid(spark, d), ["subject", "predicate"], F.col("mid"), AT).select("subject", "predicate", "claim_id", "object")


@query(f"WITH {CLAIMS_SQL} SELECT subject, predicate, revision, object, valid_from, CASE WHEN tx_to <= {MID_SQL} THEN valid_to END AS valid_to FROM claims WHERE tx_from <= {MID_SQL}")
def timeline_revisions(spark, d):
    known = at_mid(spark, d).where("tx_from <= mid")
    return known.select("subject", "predicate", "revision", "object", "valid_from", F.when(F.expr("tx_to <= mid"), F.col("valid_to")).alias("valid_to"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + 7200000000 AS e FROM events)
    SELECT a.user_id, a.event_id AS l_id, b.event_id AS r_id, greatest(a.s, b.s) AS both_from, least(a.e, b.e) AS both_to
    FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND a.s < b.e AND b.s < a.e""")
def valid_overlap_join(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("id"), micros("ts").alias("start"), (micros("ts") + 7_200_000_000).alias("end"))
    pairs = temporal.overlap_join(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], 14_400_000_000)
    return pairs.select("user_id", "l_id", "r_id", F.greatest("l_start", "r_start").alias("both_from"), F.least("l_end", "r_end").alias("both_to"))


@query("""SELECT user_id, event_id + 1 AS gap_from, nx - 1 AS gap_to FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx
    FROM (SELECT user_id, event_id FROM events WHERE event_id % 7 <> 0)) WHERE nx > event_id + 1""")
def producer_gaps(spark, d):
    e = table(spark, d, "events").where("event_id % 7 <> 0").select("user_id", "event_id")
    return temporal.gaps(e, ["user_id"], "event_id")


@query("""SELECT user_id, event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w * 10000 // count(*) OVER w AS ratio_bps FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def rolling_ratio(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    e = table(spark, d, "events").withColumn("hits", F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w)).withColumn("n", F.count("*").over(w))
    return e.select("user_id", "event_id", F.expr("hits * 10000 div n").alias("ratio_bps"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e)
    SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("t")).withColumn("p", F.lag("t").over(order))
    s = e.withColumn("k", F.sum(F.when(F.col("p").isNull() | (F.col("t") - F.col("p") > 21_600_000_000), 1).otherwise(0)).over(order))
    return s.groupBy("user_id", "k").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count("*").alias("n")).drop("k")


@query("SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    hour = F.floor(micros("ts") / 3_600_000_000).alias("hour")
    return table(spark, d, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Truth.


@query(f"""WITH {CLAIMS_SQL}, v AS (SELECT subject, predicate, count(DISTINCT CASE WHEN NOT negative THEN object END) AS n_values FROM claims GROUP BY 1, 2)
    SELECT subject, predicate, CASE n_values WHEN 0 THEN 'unknown' WHEN 1 THEN 'known' ELSE 'conflict' END AS state, n_values FROM v""")
def truth_state(spark, d):
    return truth.truth_state(claims(spark, d))


@query(f"""WITH RECURSIVE {CLAIMS_SQL}, b AS (SELECT subject, predicate, object, family, max(confidence) AS best, count(*) AS n, max(valid_from) AS vf, min(valid_to) AS vt FROM claims WHERE NOT negative GROUP BY 1, 2, 3, 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY family) AS i FROM b),
    f AS (SELECT subject, predicate, object, 0 AS i, CAST(1000000 AS BIGINT) AS l FROM (SELECT DISTINCT subject, predicate, object FROM b) UNION ALL
          SELECT f.subject, f.predicate, f.object, f.i + 1, f.l * (1000000 - best) // 1000000 FROM f JOIN k ON k.subject = f.subject AND k.predicate = f.predicate AND k.object = f.object AND k.i = f.i + 1),
    g AS (SELECT subject, predicate, object, arg_max(l, i) AS l FROM f GROUP BY 1, 2, 3)
    SELECT b.subject, b.predicate, b.object, CAST(sum(n) AS BIGINT) AS n_claims, CAST(count(*) AS INTEGER) AS n_families, least(1000000 - any_value(g.l), 999999) AS support, max(vf) AS valid_from, min(vt) AS valid_to
    FROM b JOIN g ON g.subject = b.subject AND g.predicate = b.predicate AND g.object = b.object GROUP BY 1, 2, 3""")
def knowledge_alternatives(spark, d):
    return truth.alternatives(claims(spark, d))


@query(f"""WITH {CLAIMS_SQL} SELECT a.subject, a.predicate, a.claim_id AS claim_a, b.claim_id AS claim_b FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id < b.claim_id
    WHERE a.object <> b.object AND NOT a.negative AND NOT b.negative AND a.valid_from < b.valid_from + 86400000000 AND b.valid_from < a.valid_from + 86400000000""")
def slot_conflicts(spark, d):
    c = claims(spark, d).withColumn("valid_to", F.col("valid_from") + 86_400_000_000)
    return truth.conflicts(c, 172_800_000_000).select("subject", "predicate", F.col("claim_id_a").alias("claim_a"), F.col("claim_id_b").alias("claim_b"))


@query(f"""WITH {CLAIMS_SQL} SELECT n.claim_id, CASE WHEN c.claim_id IS NULL THEN 'new' WHEN n.negative THEN 'retract' WHEN n.object = c.object THEN 'confirm' ELSE 'supersede' END AS change, count(*) OVER (PARTITION BY n.subject) AS n_subject
    FROM claims n LEFT JOIN claims c ON c.subject = n.subject AND c.predicate = n.predicate AND c.revision = n.revision - 1""")
def change_classification(spark, d):
    slot = Window.partitionBy("subject", "predicate").orderBy("revision")
    c = claims(spark, d).withColumn("before", F.lag("object").over(slot)).withColumn("first", F.lag("claim_id").over(slot).isNull())
    kind = F.when(F.col("first"), "new").when(F.col("negative"), "retract").when(F.col("object") == F.col("before"), "confirm").otherwise("supersede")
    return c.select("claim_id", kind.alias("change"), F.count("*").over(Window.partitionBy("subject")).alias("n_subject"))


@query(f"WITH {CLAIMS_SQL}, r AS (SELECT DISTINCT subject, predicate, object FROM claims WHERE negative) SELECT c.claim_id FROM claims c ANTI JOIN r ON r.subject = c.subject AND r.predicate = c.predicate AND r.object = c.object WHERE NOT c.negative")
def retired_anti_join(spark, d):
    c = claims(spark, d)
    return c.where(~F.col("negative")).join(c.where("negative").select("subject", "predicate", "object"), ["subject", "predicate", "object"], "left_anti").select("claim_id")


# The same reads at commits taken from the table: every revision takes part, however many there are.

_LAST_SQL = "(SELECT max(event_id) FROM events)"


def _at_last(spark, d) -> DataFrame:
    """Claims, each with the last commit of the table as `last`."""
    return claims(spark, d).join(F.broadcast(table(spark, d, "events").agg(F.max("event_id").alias("last"))))


@query(f"WITH {CLAIMS_SQL} SELECT subject, predicate, revision, object FROM claims WHERE tx_from <= {_LAST_SQL} AND (tx_to IS NULL OR {_LAST_SQL} < tx_to)")
def asof_revision_whole(spark, d):
    return temporal.as_of(_at_last(spark, d), F.col("last")).select("subject", "predicate", "revision", "object")


@query(f"""WITH {CLAIMS_SQL} SELECT subject, predicate, claim_id, object FROM claims WHERE tx_from <= {_LAST_SQL} AND (tx_to IS NULL OR {_LAST_SQL} < tx_to) AND valid_from <= {AT} AND (valid_to IS NULL OR {AT} < valid_to)
    QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY tx_from DESC) = 1""")
def bitemporal_state_whole(spark, d):
    return temporal.bitemporal(_at_last(spark, d), ["subject", "predicate"], F.col("last"), AT).select("subject", "predicate", "claim_id", "object")


@query(f"WITH {CLAIMS_SQL} SELECT subject, predicate, revision, object, valid_from, CASE WHEN tx_to <= {_LAST_SQL} THEN valid_to END AS valid_to FROM claims WHERE tx_from <= {_LAST_SQL}")
def timeline_revisions_whole(spark, d):
    known = _at_last(spark, d).where("tx_from <= last")
    return known.select("subject", "predicate", "revision", "object", "valid_from", F.when(F.expr("tx_to <= last"), F.col("valid_to")).alias("valid_to"))


@query("""SELECT event_id <= (SELECT max(event_id) * 3 // 5 FROM events) AS indexed, event_type, count(*) AS n FROM events GROUP BY ALL""")
def pending_tail_whole(spark, d):
    """Three fifths of the commits are indexed, and the tail runs to the end of the table."""
    e = table(spark, d, "events")
    upto = F.broadcast(e.agg(F.expr("max(event_id) * 3 div 5").alias("upto")))
    return e.join(upto).groupBy(F.expr("event_id <= upto").alias("indexed"), "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {CLAIMS_SQL} SELECT subject, max(tx_from) AS watermark, min(valid_to) FILTER (valid_to > {AT}) AS next_boundary FROM claims GROUP BY subject")
def slot_watermark(spark, d):
    return claims(spark, d).groupBy("subject").agg(F.max("tx_from").alias("watermark"), F.min(F.when(F.col("valid_to") > AT, F.col("valid_to"))).alias("next_boundary"))


_KINDS = {"signup": "boundary", "purchase": "claim", "view": "preference", "click": "summary", "error": "reflection"}


@query(f"""WITH {CLAIMS_SQL}, s AS (SELECT subject, predicate, count(*) FILTER (NOT negative) AS n_primary, count(DISTINCT family) AS families, max(confidence) / 1000000.0 AS trust, count(DISTINCT object) > 1 AS unclear, max(revision) > 5 AS asserted FROM claims GROUP BY 1, 2)
    SELECT subject, predicate, n_primary, families, round(least(1, greatest(0, 0.3 * CASE WHEN asserted THEN 1 WHEN n_primary > 0 THEN 0.65 ELSE 0.15 END
        + 0.2 * CASE predicate WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0.8 WHEN 'view' THEN 0.72 WHEN 'click' THEN 0.65 ELSE 0.55 END + 0.3 * trust + 0.2 * CASE families WHEN 0 THEN 0 WHEN 1 THEN 0.35 WHEN 2 THEN 0.75 ELSE 1 END
        - 0.2 * CASE WHEN unclear THEN 0.5 ELSE 0 END - 0.1 * CASE subject % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.05 WHEN 2 THEN 0.15 ELSE 0.3 END)), 6) AS score FROM s""")
def promotion_score(spark, d):
    s = claims(spark, d).groupBy("subject", "predicate").agg(F.count_if(~F.col("negative")).alias("n_primary"), F.count_distinct("family").alias("families"), (F.max("confidence") / 1_000_000).alias("trust"), (F.count_distinct("object") > 1).alias("unclear"), (F.max("revision") > 5).alias("asserted"))
    kind = F.create_map(*(F.lit(v) for kv in _KINDS.items() for v in kv))[F.col("predicate")]
    score = truth.promotion(kind, F.col("asserted"), F.col("n_primary"), F.col("families"), F.col("trust"), F.when(F.col("unclear"), 0.5).otherwise(0.0), F.col("subject") % 4)
    return s.select("subject", "predicate", "n_primary", "families", F.round(score, 6).alias("score"))


# Aggregates.


@query("""SELECT l_returnflag, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag""")
def nearest_rank_percentiles(spark, d):
    lines = table(spark, d, "lineitem")
    found = measures.percentiles(lines, ["l_returnflag"], "l_quantity", (50, 95)).join(measures.percentiles(lines, ["l_returnflag"], "l_extendedprice", (99,)).select("l_returnflag", "p99"), "l_returnflag")
    return found.select("l_returnflag", "n", "p50", "p95", "p99")


@query("SELECT user_id, CASE WHEN n = 0 THEN 'zero' WHEN n = 1 THEN 'one' WHEN n <= 4 THEN 'few' WHEN n <= 16 THEN 'several' ELSE 'many' END AS bucket FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY user_id)")
def count_buckets(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).select("user_id", numbers.count_bucket("n").alias("bucket"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'F' GROUP BY n_name""")
def nation_revenue(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"))


@query("""WITH t AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2) SELECT conv_id, role, n, CAST(chars AS BIGINT) AS chars FROM t""")
def conversation_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# Order, budgets, pages.


@query("""SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 600""")
def token_budget_prefix(spark, d):
    t = table(spark, d, "conversations").withColumn("cost", F.length("text").cast("long"))
    return retrieval.budget_prefix(t, ["conv_id"], ["turn"], "cost", 600).select("conv_id", "turn", "used")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (200000.0, 500) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 40")
def keyset_page(spark, d):
    after = (F.col("o_totalprice") < 200000.0) | ((F.col("o_totalprice") == 200000.0) & (F.col("o_orderkey") < 500))
    return table(spark, d, "orders").where(after).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(40)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20)


@query("SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rk FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rk")).where("rk <= 3")


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR) || coalesce(event_type, '')) AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT user_id, event_id, k, sha256(own) AS link FROM h WHERE k = 1
          UNION ALL SELECT h.user_id, h.event_id, h.k, sha256(c.link || h.own) FROM c JOIN h ON h.user_id IS NOT DISTINCT FROM c.user_id AND h.k = c.k + 1)
    SELECT user_id, event_id, link FROM c""")
def record_digest_chain(spark, d):
    return capture.digest_chain(table(spark, d, "events").select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), F.coalesce("event_type", F.lit(""))).alias("record")))


# Vectors and fusion.

_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _vector_hits(spark, d, k: int) -> DataFrame:
    """The k rows of the largest cosine with vector 0: one pass, the query's vector is one row."""
    v = table(spark, d, "embeddings")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return v.where("vec_id <> 0").join(q).select(F.col("vec_id").alias("id"), F.round(retrieval.cosine("embedding", "q"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


@query(f"SELECT v.vec_id AS id, round({_COS}, 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 AND v.vec_id <> 0 ORDER BY round({_COS}, 9) DESC, v.vec_id LIMIT 20")
def vector_cosine_topk(spark, d):
    return _vector_hits(spark, d, 20)


_DOT = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT v.vec_id AS id, round({_DOT}, 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 1 AND v.vec_id <> 1 AND v.label = q.label ORDER BY round({_DOT}, 9) DESC, v.vec_id LIMIT 20")
def vector_dot_filtered(spark, d):
    v = table(spark, d, "embeddings")
    q = F.broadcast(v.where("vec_id = 1").select(F.col("embedding").alias("q"), "label"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return v.where("vec_id <> 1").join(q, "label").select(F.col("vec_id").alias("id"), F.round(dot, 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


_FUSION_SQL = f"""WITH {DOCUMENTS_SQL}, {_BM25_SQL},
    a AS (SELECT doc_id AS id, 'lexical' AS route, 1000000 * 1000000 AS w, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm WHERE score > 0),
    o AS (SELECT doc_id AS id, len(list_intersect(list_distinct({TOKENS_SQL}), ['the', 'thand', 'onthe', 'of'])) / 4.0 AS score FROM docs WHERE {ALLOWED_SQL}),
    b AS (SELECT id, 'overlap' AS route, CAST(1300000 AS BIGINT) * 1000000 AS w, row_number() OVER (ORDER BY score DESC, id) AS r FROM o WHERE score > 0),
    v AS (SELECT v.vec_id AS id, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 AND v.vec_id <> 0 AND v.vec_id IN (SELECT doc_id FROM docs WHERE {ALLOWED_SQL})),
    c AS (SELECT id, 'vector' AS route, CAST(1150000 AS BIGINT) * 1000000 AS w, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM v),
    u AS (SELECT * FROM a WHERE r <= 30 UNION ALL SELECT * FROM b WHERE r <= 30 UNION ALL SELECT * FROM c WHERE r <= 30)
    SELECT id, CAST(sum(w // (60 + r)) AS BIGINT) AS rrf, count(*) AS n_routes, CAST(sum(w // (60 + r)) AS BIGINT) + any_value(trust) // 2 AS score
    FROM u JOIN docs ON docs.doc_id = u.id GROUP BY id ORDER BY score DESC, id LIMIT 20"""


@query(_FUSION_SQL.replace("1000000 * 1000000 AS w", "CAST(1000000 AS BIGINT) * 1000000 AS w"))
def recall_fusion(spark, d):
    """The flagship: authorized documents only, three routes, fusion in whole numbers, a trust modifier, the best twenty."""
    # The admitted rows are made once; every route reads them.
    docs = settle(documents(spark, d).where(policy.allows(PRINCIPAL)).select("doc_id", "text", "trust"), "recall")
    lexical = retrieval.bm25(docs, WORDS[1:]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    over = docs.select(F.col("doc_id").alias("id"), retrieval.overlap("text", WORDS).alias("score")).where("score > 0")
    v = table(spark, d, "embeddings")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    vector = v.where("vec_id <> 0").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").join(q).select(F.col("vec_id").alias("id"), F.round(retrieval.cosine("embedding", "q"), 9).alias("score"))
    fused = retrieval.fuse([("lexical", 1_000_000, lexical), ("overlap", 1_300_000, over), ("vector", 1_150_000, vector)], 30)
    scored = fused.join(docs.select(F.col("doc_id").alias("id"), "trust"), "id")
    return scored.select("id", "rrf", F.size("routes").cast("long").alias("n_routes"), (F.col("rrf") + F.expr("trust div 2")).alias("score")).orderBy(F.desc("score"), "id").limit(20)


# Graphs.

_BOTH = "s AS (SELECT parent AS a, child AS b FROM edges UNION SELECT child, parent FROM edges)"


@query(f"""WITH RECURSIVE {EDGES_SQL}, w(node, hop) AS (SELECT 'r1', 0 UNION SELECT child, hop + 1 FROM w JOIN edges ON parent = node WHERE hop < 3) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node HAVING min(hop) > 0""")
def bfs_reach_out(spark, d):
    return graph.reach(edges(spark, d), spark.createDataFrame([("r1",)], "node string"), 3, "out")


@query(f"""WITH RECURSIVE {EDGES_SQL}, w(node, hop) AS (SELECT 'c7', 0 UNION SELECT parent, hop + 1 FROM w JOIN edges ON child = node WHERE hop < 3) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node HAVING min(hop) > 0""")
def bfs_reach_in(spark, d):
    return graph.reach(edges(spark, d), spark.createDataFrame([("c7",)], "node string"), 3, "in")


@query(f"""WITH RECURSIVE {EDGES_SQL}, {_BOTH}, w(node, hop) AS (SELECT 'c7', 0 UNION SELECT b, hop + 1 FROM w JOIN s ON a = node WHERE hop < 3) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node""")
def bfs_reach_both(spark, d):
    return graph.reach(edges(spark, d), spark.createDataFrame([("c7",)], "node string"), 3, "both", include_starts=True)


@query(f"""WITH RECURSIVE {EDGES_SQL}, p(node, below, d) AS (SELECT parent, child, 1 FROM edges UNION SELECT p.node, e.child, d + 1 FROM p JOIN edges e ON e.parent = p.below WHERE d < 3),
    m AS (SELECT node, below, min(d) AS near, max(d) AS d FROM p GROUP BY 1, 2) SELECT node, count(*) FILTER (near = 1) AS children, count(*) AS descendants, count(*) FILTER (below NOT IN (SELECT parent FROM edges)) AS leaves, CAST(max(d) AS INTEGER) AS depth FROM m GROUP BY node""")
def dag_branch_stats(spark, d):
    return graph.branches(edges(spark, d), 3)


RELATIONS_SQL = f"""{EDGES_SQL}, relations AS (SELECT CASE left(child, 1) WHEN 'n' THEN 'calls' WHEN 'c' THEN 'uses_type' ELSE 'contains' END AS kind, child AS source, parent AS target FROM edges
    UNION ALL SELECT 'tested_by', 'c' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def relations(spark, d) -> DataFrame:
    """kind, source, target: nations call their region, customers use their nation and are tested by urgent orders."""
    kind = F.when(F.startswith("child", F.lit("n")), "calls").when(F.startswith("child", F.lit("c")), "uses_type").otherwise("contains")
    tests = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("tested_by").alias("kind"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target"))
    return edges(spark, d).select(kind.alias("kind"), F.col("child").alias("source"), F.col("parent").alias("target")).unionByName(tests)


@query(f"""WITH RECURSIVE {RELATIONS_SQL}, w(node) AS (SELECT 'r1' UNION SELECT CASE WHEN kind = 'tested_by' THEN target ELSE source END FROM w JOIN relations ON (kind IN ('calls', 'imports', 'uses_type') AND target = node) OR (kind = 'tested_by' AND source = node))
    SELECT node AS symbol, node IN (SELECT target FROM relations WHERE kind = 'tested_by' AND source IN (SELECT node FROM w)) AS test FROM w WHERE node <> 'r1'""")
def impact_closure(spark, d):
    return graph.impact(relations(spark, d), "r1", 4)


@query("""WITH t AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) SELECT count(*) AS n_other, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM t WHERE o_orderpriority = '1-URGENT')) AS n_in_both FROM (SELECT DISTINCT o_custkey FROM t WHERE o_orderpriority <> '1-URGENT')""")
def set_operations(spark, d):
    t = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    urgent = t.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct().withColumn("u", F.lit(1))
    other = t.where("o_orderpriority <> '1-URGENT'").select("o_custkey").distinct()
    return other.join(urgent, "o_custkey", "left").agg(F.count("*").alias("n_other"), F.count("u").alias("n_in_both"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 20 AS e FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b),
    g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT l_orderkey, min(s) AS range_from, max(e) AS range_to FROM g GROUP BY l_orderkey, k""")
def byte_range_union(spark, d):
    # Nulls come last and fractions are rounded, halves to even, as in the SQL.
    b = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.rint("l_quantity").cast("long") % 20).alias("e"))
    w = Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    o = b.withColumn("m", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = o.withColumn("k", F.sum(F.when(F.col("m").isNull() | (F.col("s") > F.col("m")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("l_orderkey", "k").agg(F.min("s").alias("range_from"), F.max("e").alias("range_to")).drop("k")


# Captured events, summaries and facets.

_SENT_SQL = """numbered AS (SELECT event_id, user_id AS producer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
    sent AS (SELECT producer, sequence FROM numbered WHERE event_id % 6 <> 0 UNION ALL SELECT producer, sequence FROM numbered WHERE event_id % 30 = 1)"""


@query(f"""WITH {_SENT_SQL}, numbers AS (SELECT producer, sequence, count(*) AS times FROM sent GROUP BY ALL),
    g AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY producer ORDER BY sequence), 0) AS before FROM numbers)
    SELECT producer, max(sequence) AS head, coalesce(min(before) FILTER (sequence > before + 1), max(sequence)) AS contiguous_through, count(*) FILTER (sequence > before + 1) AS n_gaps,
           CAST(sum(sequence - before - 1) AS BIGINT) AS n_missing, CAST(sum(times - 1) AS BIGINT) AS n_duplicates FROM g GROUP BY producer""")
def producer_coverage(spark, d):
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    numbered = table(spark, d, "events").select("event_id", F.col("user_id").alias("producer"), number.alias("sequence"))
    # A sixth is lost and a thirtieth is sent twice.
    times = F.when(F.col("event_id") % 6 != 0, 1).otherwise(0) + F.when(F.col("event_id") % 30 == 1, 1).otherwise(0)
    sent = numbered.select("producer", "sequence", F.explode(F.array_repeat(F.lit(1), times)))
    return capture.producer_coverage(sent.select("producer", "sequence"))


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id, CASE WHEN n > 8 THEN min(event_id) OVER (PARTITION BY user_id) END AS dropped_before FROM a WHERE age <= 8""")
def retained_events(spark, d):
    return capture.retained(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 8).select("user_id", "event_id", "dropped_before")


@query("SELECT conv_id, count(*) AS n_frames, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete FROM conversations GROUP BY conv_id")
def snapshot_complete(spark, d):
    return capture.complete(table(spark, d, "conversations"), "conv_id", "turn")


@query("""SELECT source, count(*) AS n_sources, count(*) FILTER (doc_id % 31 = 0) AS n_dirty, CASE WHEN count(*) FILTER (doc_id % 31 = 0) > 0 THEN 'stale' ELSE 'current' END AS status
    FROM documents GROUP BY source""")
def summary_freshness(spark, d):
    return capture.freshness(table(spark, d, "documents").select("source", "doc_id"), "source", F.col("doc_id") % 31 == 0)


@query(f"WITH {DOCUMENTS_SQL} SELECT source, arg_max(doc_id, (trust, length(text), -doc_id)) AS doc_id FROM docs WHERE {ALLOWED_SQL} AND text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def required_facets(spark, d):
    allowed = documents(spark, d).where(policy.allows(PRINCIPAL) & F.col("text").isNotNull() & F.col("source").isNotNull())
    return capture.best_per_facet(allowed.select("source", "doc_id", "trust", F.length("text").alias("n")), "source", "trust", "n", "doc_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT DISTINCT source, 'unknown' AS block FROM documents w WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs WHERE {ALLOWED_SQL} AND docs.source = w.source)")
def missing_facets(spark, d):
    wanted = table(spark, d, "documents").where("source is not null").select("source").distinct()
    return capture.missing_facets(wanted, documents(spark, d).where(policy.allows(PRINCIPAL)).select("source"), "source")


@query("""SELECT event_id <= (SELECT max(event_id) * 2 // 3 FROM events) AS indexed, event_type, count(*) AS n FROM events GROUP BY ALL""")
def pending_tail(spark, d):
    e = table(spark, d, "events")
    e = e.select("event_id", "event_type").join(F.broadcast(e.agg(F.expr("max(event_id) * 2 div 3").alias("mid"))))
    view, tail = e.where("event_id <= mid").withColumn("indexed", F.lit(True)), e.where("event_id > mid").withColumn("indexed", F.lit(False))
    return view.unionByName(tail).groupBy("indexed", "event_type").agg(F.count("*").alias("n"))


# Hierarchies.

_SURE_SQL = f"{EDGES_SQL}, sure AS (SELECT *, 9000 + CAST(substr(child, 2) AS BIGINT) * 37 % 1000 AS confidence FROM edges)"
_COMBINE_SQL = "CAST((a.confidence * e.confidence + 5000) // 10000 AS BIGINT)"


def _sure(spark, d) -> DataFrame:
    return edges(spark, d).withColumn("confidence", F.lit(9000) + F.substring("child", 2, 20).cast("long") * 37 % 1000)


def _roots(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))


@query(f"""WITH {_SURE_SQL}, l1 AS (SELECT child AS node, parent || '>' || child AS path, 1 AS hops, confidence FROM sure WHERE parent LIKE 'r%'),
    l2 AS (SELECT child AS node, path || '>' || child AS path, 2 AS hops, {_COMBINE_SQL} AS confidence FROM l1 a JOIN sure e ON e.parent = a.node)
    SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def hierarchy_routes(spark, d):
    return graph.routes(_sure(spark, d), _roots(spark, d), 3)


@query(f"""WITH {_SURE_SQL}, l1 AS (SELECT child AS node, parent || '>' || child AS path, 1 AS hops, confidence, parent AS start FROM sure WHERE parent LIKE 'r%' QUALIFY row_number() OVER (PARTITION BY parent ORDER BY confidence DESC, path) <= 3),
    l2 AS (SELECT child AS node, path || '>' || child AS path, 2 AS hops, {_COMBINE_SQL} AS confidence, start FROM l1 a JOIN sure e ON e.parent = a.node),
    b2 AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY start ORDER BY confidence DESC, path) <= 3) SELECT * FROM l1 UNION ALL SELECT * FROM b2""")
def hierarchy_beam(spark, d):
    return graph.beam(_sure(spark, d), _roots(spark, d), 2, 3)


@query(f"""WITH {EDGES_SQL}, b AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE parent = 'n3' UNION ALL SELECT 'n4', 'c7' UNION ALL SELECT 'n5', 'n5' UNION ALL SELECT 'n99', 'c8')
    SELECT 'repeated' AS rule, child AS node FROM b GROUP BY parent, child HAVING count(*) > 1 UNION SELECT 'loop', child FROM b WHERE parent = child
    UNION SELECT 'several', child FROM b GROUP BY child HAVING count(DISTINCT parent) > 1 UNION SELECT 'unknown', parent FROM b WHERE parent NOT IN (SELECT child FROM edges UNION SELECT parent FROM edges)""")
def hierarchy_faults(spark, d):
    good = edges(spark, d)
    more = spark.createDataFrame([("n4", "c7"), ("n5", "n5"), ("n99", "c8")], "parent string, child string")
    known = good.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    return graph.faults(good.unionByName(good.where("parent = 'n3'")).unionByName(more), known)


@query(f"WITH {EDGES_SQL} SELECT parent, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM edges GROUP BY parent")
def adjacency_lists(spark, d):
    return graph.adjacency(edges(spark, d))
