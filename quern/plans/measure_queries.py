"""Queries of reports: evidence and pipeline metrics, benchmark tables, distributions, comparisons, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import graph, measures, policy, retrieval
from ..sources.tables import CLAIMS_SQL, DOCUMENTS_SQL, EDGES_SQL, claims, documents, edges, micros, table
from .registry import ALLOWED_SQL, MID_SQL, PRINCIPAL, at_mid, query


@query(f"WITH {CLAIMS_SQL} SELECT subject, count(*) FILTER (NOT negative) AS n_primary, count(DISTINCT family) AS families, max(confidence) AS trust, min(valid_from) AS first_seen FROM claims GROUP BY subject")
def evidence_stats(spark, d):
    return claims(spark, d).groupBy("subject").agg(F.count_if(~F.col("negative")).alias("n_primary"), F.count_distinct("family").alias("families"), F.max("confidence").alias("trust"), F.min("valid_from").alias("first_seen"))


@query("SELECT event_type AS disposition, count(*) AS n, count(*) FILTER (value > 50) AS promoted, count(*) FILTER (value <= 0) AS rejected FROM events GROUP BY 1")
def pipeline_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("disposition")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("promoted"), F.count_if(F.col("value") <= 0).alias("rejected"))


@query("""WITH p AS (SELECT d.lang, l.quality AS want, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS got FROM documents d JOIN labels l USING (doc_id))
    SELECT lang, sum(want * got) AS tp, sum((1 - want) * got) AS fp, sum(want * (1 - got)) AS fn, sum(want * got) * 10000 // nullif(sum(got), 0) AS precision_bps, sum(want * got) * 10000 // nullif(sum(want), 0) AS recall_bps FROM p GROUP BY lang""")
def cognition_evaluation(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("quality").alias("want"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("got"))
    s = p.groupBy("lang").agg(F.sum(F.expr("want * got")).alias("tp"), F.sum(F.expr("(1 - want) * got")).alias("fp"), F.sum(F.expr("want * (1 - got)")).alias("fn"))
    return s.select("*", measures.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_bps"), measures.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_bps"))


@query("""WITH a AS (SELECT event_id, event_type AS v FROM events WHERE event_id % 10 <> 3), b AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'other' ELSE event_type END AS v FROM events WHERE event_id % 10 <> 4)
    SELECT CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b USING (event_id) GROUP BY 1""")
def reprocessing_diff(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_id % 10 <> 3").select("event_id", F.col("event_type").alias("v"))
    b = e.where("event_id % 10 <> 4").select("event_id", F.when(F.col("event_id") % 9 == 0, "other").otherwise(F.col("event_type")).alias("w"))
    change = F.when(F.col("v").isNull(), "added").when(F.col("w").isNull(), "removed").when(F.col("v") != F.col("w"), "changed").otherwise("same")
    return a.join(b, "event_id", "full_outer").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


_BENCH_SQL = "b AS (SELECT o_custkey AS q, list_sort(list(DISTINCT o_orderkey) FILTER (o_orderstatus = 'O')) AS want, list_sort(list(DISTINCT o_orderkey) FILTER (o_orderkey % 3 > 0)) AS got FROM orders GROUP BY 1)"


@query(f"""WITH {_BENCH_SQL}, s AS (SELECT q, len(list_intersect(coalesce(want, []), coalesce(got, []))) AS tp, len(coalesce(got, [])) AS n_got, len(coalesce(want, [])) AS n_want FROM b)
    SELECT q, tp, n_got - tp AS fp, n_want - tp AS fn FROM s""")
def benchmark_answers(spark, d):
    """Expected against observed answers of each query, by set operations."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("want"), F.collect_set(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey"))).alias("got"))
    tp = F.size(F.array_intersect("want", "got"))
    return o.select("q", tp.alias("tp"), (F.size("got") - tp).alias("fp"), (F.size("want") - tp).alias("fn"))


@query("""WITH r AS (SELECT o_orderstatus = 'O' AS want, o_orderkey % 3 > 0 AS got, o_orderpriority = '1-URGENT' AS private FROM orders) SELECT count(*) FILTER (want AND got) * 10000 // count(*) FILTER (got) AS precision_bps, count(*) FILTER (want AND got) * 10000 // count(*) FILTER (want) AS recall_bps, count(*) FILTER (private AND got AND NOT want) * 1000000 // count(*) AS leak_ppm FROM r""")
def bench_a_report(spark, d):
    r = table(spark, d, "orders").select((F.col("o_orderstatus") == "O").alias("want"), (F.col("o_orderkey") % 3 > 0).alias("got"), (F.col("o_orderpriority") == "1-URGENT").alias("private"))
    c = r.agg(F.count_if(F.expr("want and got")).alias("tp"), F.count_if("got").alias("g"), F.count_if("want").alias("w"), F.count_if(F.expr("private and got and not want")).alias("leak"), F.count("*").alias("n"))
    return c.select(measures.ratio(F.col("tp"), F.col("g")).alias("precision_bps"), measures.ratio(F.col("tp"), F.col("w")).alias("recall_bps"), measures.ratio(F.col("leak"), F.col("n"), 1_000_000).alias("leak_ppm"))


@query("SELECT count(*) AS n, count(*) FILTER (want = got) * 10000 // count(*) AS unknown_accuracy_bps, count(*) FILTER (cited AND want = got) * 10000 // count(*) FILTER (cited) AS citation_bps FROM (SELECT user_id % 3 = 0 AS want, event_type = 'error' AS got, event_id % 2 = 0 AS cited FROM events)")
def bench_c_report(spark, d):
    r = table(spark, d, "events").select((F.col("user_id") % 3 == 0).alias("want"), (F.col("event_type") == "error").alias("got"), (F.col("event_id") % 2 == 0).alias("cited"))
    c = r.agg(F.count("*").alias("n"), F.count_if(F.expr("want = got")).alias("hit"), F.count_if("cited").alias("c"), F.count_if(F.expr("cited and want = got")).alias("ch"))
    return c.select("n", measures.ratio(F.col("hit"), F.col("n")).alias("unknown_accuracy_bps"), measures.ratio(F.col("ch"), F.col("c")).alias("citation_bps"))


@query("SELECT c_mktsegment, count(*) AS migrated, count(*) FILTER (c_acctbal < 0) AS lost, count(*) FILTER (c_acctbal < 0) = 0 AS safe FROM customer GROUP BY 1")
def bench_d_report(spark, d):
    lost = F.count_if(F.col("c_acctbal") < 0)
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("migrated"), lost.alias("lost"), (lost == 0).alias("safe"))


@query("SELECT l_linestatus, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 4) AS mean, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def distribution(spark, d):
    li = table(spark, d, "lineitem")
    ends = li.groupBy("l_linestatus").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    return measures.percentiles(li, ["l_linestatus"], "l_extendedprice", (50, 95, 99)).join(ends, "l_linestatus")


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n, sum(CAST(floor(value) AS BIGINT)) AS total, count(*) <= 1000000 AS within FROM events GROUP BY 1, 2")
def telemetry_series(spark, d):
    """Samples by labels; a series count over its budget is told, not cut."""
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"), (F.count("*") <= 1_000_000).alias("within"))


@query("""WITH a AS (SELECT l_suppkey AS metric, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_suppkey AS metric, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber > 1 AND l_suppkey % 9 <> 4 GROUP BY 1)
    SELECT metric, a.v AS baseline, b.v AS candidate, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN b.v > a.v * 1.1 THEN 'worse' WHEN b.v < a.v * 0.9 THEN 'better' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (metric)""")
def regression_compare(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "metric")
    a = li.where("l_linenumber <= 3").groupBy("metric").agg(F.sum("l_quantity").alias("v"))
    b = li.where("l_linenumber > 1 and metric % 9 <> 4").groupBy("metric").agg(F.sum("l_quantity").alias("v"))
    return measures.compare(a, b, "metric", "v", 0.1)


@query(f"""WITH {DOCUMENTS_SQL}, f AS (SELECT workspace, list_sort(list_distinct(list(source) FILTER ({ALLOWED_SQL}))) AS covered, count(*) FILTER (deleted_at IS NOT NULL AND doc_id < 40) AS conflicts, count(*) FILTER ({ALLOWED_SQL}) AS included FROM docs GROUP BY workspace)
    SELECT workspace, len(list_filter(['src1', 'src2', 'src99'], lambda s: NOT list_contains(coalesce(covered, []), s))) AS missing, greatest(len(list_intersect(['src1', 'src2', 'src99'], coalesce(covered, []))) * 1000000 // 3 - CASE WHEN conflicts > 0 THEN 500000 ELSE 0 END, 0) AS confidence FROM f""")
def sufficiency(spark, d):
    from ..operators import recall

    ok = policy.allows(PRINCIPAL)
    f = documents(spark, d).groupBy("workspace").agg(F.collect_set(F.when(ok, F.col("source"))).alias("covered"), F.count_if(F.col("deleted_at").isNotNull() & (F.col("doc_id") < 40)).alias("conflicts"), F.count_if(ok).alias("included"))
    r = recall.sufficiency(F.array(*map(F.lit, ("src1", "src2", "src99"))), F.col("covered"), F.col("conflicts"), F.lit(0), F.col("included"), False)
    return f.select("workspace", F.size(r["missing"]).alias("missing"), r["confidence"].alias("confidence"))


@query("SELECT user_id, string_agg(event_type || ':' || event_id, chr(10) ORDER BY event_id) AS rationale, count(DISTINCT event_type) AS evidence FROM events WHERE value > 40 GROUP BY user_id")
def rationale(spark, d):
    line = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    g = table(spark, d, "events").where("value > 40").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"), F.count_distinct("event_type").alias("evidence"))
    return g.select("user_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("rationale"), "evidence")


@query("SELECT n_name AS path, list_sort(list(s_suppkey) FILTER (s_suppkey IS NOT NULL)) AS symbols FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def repository_hierarchy(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    g = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy(F.col("n_name").alias("path")).agg(F.sort_array(F.collect_set("s_suppkey")).alias("symbols"))
    return g.select("path", F.when(F.size("symbols") > 0, F.col("symbols")).alias("symbols"))


@query("SELECT user_id AS workspace, count(*) AS length, max(event_id) AS head FROM events GROUP BY 1")
def workspace_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("workspace")).agg(F.count("*").alias("length"), F.max("event_id").alias("head"))


@query(f"WITH {CLAIMS_SQL} SELECT predicate AS projection, max(tx_from) AS watermark FROM claims WHERE tx_from <= {MID_SQL} GROUP BY 1")
def watermarks(spark, d):
    return at_mid(spark, d).where("tx_from <= mid").groupBy(F.col("predicate").alias("projection")).agg(F.max("tx_from").alias("watermark"))


@query("SELECT c_mktsegment, sha256(string_agg(c_custkey || '=' || c_name, ';' ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1")
def logical_digest(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("="), "c_name").alias("t")))).alias("rows"))
    return g.select("c_mktsegment", F.sha2(F.array_join(F.transform("rows", lambda r: r["t"]), ";"), 256).alias("digest"))


_ROOT = "WITH RECURSIVE l AS (SELECT s_suppkey, sha256('leaf' || chr(0) || length(CAST(s_suppkey AS VARCHAR)) || ':' || s_suppkey || length(s_name) || ':' || s_name) AS h FROM supplier), t(lv, hs) AS (SELECT 0, list(h ORDER BY s_suppkey) FROM l UNION ALL SELECT lv + 1, list_transform(range((len(hs) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(hs) THEN sha256('node' || chr(0) || hs[2 * i + 1] || hs[2 * i + 2]) ELSE hs[2 * i + 1] END) FROM t WHERE len(hs) > 1)"


@query(f"{_ROOT} SELECT hs[1] AS root FROM t WHERE len(hs) = 1")
def merkle_root(spark, d):
    s = table(spark, d, "supplier")
    return measures.merkle_root(s.select("s_suppkey", numbers.leaf("leaf", F.col("s_suppkey").cast("string"), F.col("s_name")).alias("h")), "s_suppkey", "h")


@query("""SELECT user_id, len(list_filter(['click', 'view', 'purchase', 'error'], lambda k: NOT list_contains(list(DISTINCT event_type), k))) AS missing, count(*) FILTER (value < 0) = 0 AS complete FROM events WHERE event_id % 3 = 0 GROUP BY user_id""")
def deletion_completeness(spark, d):
    g = table(spark, d, "events").where("event_id % 3 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), (F.count_if(F.col("value") < 0) == 0).alias("complete"))
    return g.select("user_id", F.size(F.array_except(F.array(*map(F.lit, ("click", "view", "purchase", "error"))), "kinds")).alias("missing"), "complete")


@query(f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT * FROM edges WHERE child NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)), p(node, below, d) AS (SELECT parent, child, 1 FROM e UNION SELECT p.node, e.child, d + 1 FROM p JOIN e ON e.parent = p.below WHERE d < 3),
    m AS (SELECT node, below, min(d) AS near, max(d) AS d FROM p GROUP BY 1, 2) SELECT node, count(*) FILTER (near = 1) AS children, count(*) AS descendants, count(*) FILTER (below NOT IN (SELECT parent FROM e)) AS leaves, CAST(max(d) AS INTEGER) AS depth FROM m GROUP BY node""")
def authorized_branch_stats(spark, d):
    """Statistics of what the reader may see only: hidden nodes are taken off before anything is counted."""
    hidden = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"))
    return graph.branches(edges(spark, d).join(hidden, "child", "left_anti"), 3)


@query(f"WITH {EDGES_SQL} SELECT child AS node, count(*) AS incoming FROM edges GROUP BY child")
def incoming_counts(spark, d):
    return edges(spark, d).groupBy(F.col("child").alias("node")).agg(F.count("*").alias("incoming"))


_WORDS = "regexp_extract_all(lower(text), '\\w+')"


@query(f"""WITH t AS (SELECT doc_id, {_WORDS} AS t FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), q AS (SELECT unnest(['thand', 'onthe', 'of']) AS q), c AS (SELECT doc_id, q, len(t) AS n, len(list_filter(t, lambda x: x = q)) AS tf FROM t CROSS JOIN q),
    g AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t), f AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM c GROUP BY q),
    b AS (SELECT doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM c JOIN f USING (q) CROSS JOIN g GROUP BY doc_id HAVING score > 0),
    v AS (SELECT v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0),
    u AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM v)
    SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 16""")
def hybrid_baseline(spark, d):
    """BM25 over words and cosine, fused by reciprocal ranks, the best sixteen."""
    v = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").join(v.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    b = retrieval.bm25_words(docs, "text", ["thand", "onthe", "of"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score")).where("score > 0")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    c = v.join(q).select(F.col("vec_id").alias("id"), F.round(retrieval.cosine("embedding", "q"), 9).alias("score"))
    from ..operators import recall

    routes = b.select(F.lit("b").alias("route"), "id", F.col("score").alias("strength")).unionByName(c.select(F.lit("v").alias("route"), "id", F.col("score").alias("strength")))
    return recall.ranked(routes).groupBy("id").agg(F.round(F.sum(1 / (F.col("rank") + 60)), 9).alias("score")).orderBy(F.desc("score"), "id").limit(16)


@query("SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) * 10000 // count(*) AS hit_bps FROM events GROUP BY 1")
def cache_hit_ratio(spark, d):
    day = F.call_function("div", micros("ts"), F.lit(86_400_000_000))
    g = table(spark, d, "events").groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("hits"))
    return g.select("day", "n", measures.ratio(F.col("hits"), F.col("n")).alias("hit_bps"))
