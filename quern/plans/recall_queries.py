"""Queries over recall, context packs, preparation and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, text, values
from ..operators import packing, policy, recall, retrieval, scans, vectors
from ..sources.tables import DOCUMENTS_SQL, documents, table
from .registry import ALLOWED_SQL, PRINCIPAL, query

QUERY, TERMS = "the thand of src1", ["of", "src1", "thand", "the"]
_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_TOK = "list_distinct(list_filter(string_split(" + _NORM.format("text") + ", ' '), lambda t: length(t) >= 2))"
_V = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"

RECALL_SQL = f"""{DOCUMENTS_SQL}, ok AS (SELECT *, doc_id % 4 AS kind, len(list_intersect(list_distinct(list_concat({_TOK}, [{_NORM.format('source')}, lang])), {TERMS})) AS hits FROM docs WHERE {ALLOWED_SQL}),
    vec AS (SELECT v.vec_id AS id, CAST(floor(greatest(round({_V}, 9), 0) * 1000000 + 0.5) AS BIGINT) AS s FROM embeddings v, embeddings q WHERE q.vec_id = 0),
    routes AS (SELECT 'active_context' AS route, doc_id AS id, CAST(CASE WHEN doc_id % 100 = 0 THEN 1000000 ELSE 800000 END AS BIGINT) AS strength FROM ok WHERE doc_id % 50 = 0
    UNION ALL SELECT 'exact_alias', doc_id, CASE WHEN {_NORM.format('source')} = '{QUERY}' THEN 1000000 ELSE 900000 END FROM ok WHERE contains('{QUERY}', {_NORM.format('source')})
    UNION ALL SELECT 'relationship', doc_id, 750000 FROM ok WHERE kind = 0 AND list_has_any(owners, ['o1', 'en'])
    UNION ALL SELECT 'episodic', doc_id, CASE WHEN list_has_any(owners, ['o1', 'en']) AND hits > 0 THEN 1000000 ELSE 700000 END FROM ok WHERE kind IN (1, 2) AND (list_has_any(owners, ['o1', 'en']) OR hits > 0)
    UNION ALL SELECT 'temporal', doc_id, 700000 FROM ok WHERE doc_id % 3 = 1 AND doc_id % 9 <> 4
    UNION ALL SELECT 'structural', doc_id, 625000 FROM ok WHERE lang IN ('en', 'de')
    UNION ALL SELECT 'lexical', doc_id, hits * 1000000 // 4 FROM ok WHERE hits > 0
    UNION ALL SELECT 'supplied_vector', vec.id, s FROM vec JOIN ok ON ok.doc_id = vec.id WHERE s > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY strength DESC, id) AS rank FROM routes),
    fused AS (SELECT id, CAST(sum(CASE route {" ".join(f"WHEN '{r}' THEN {w}" for r, w in numbers.ROUTE_WEIGHTS.items())} END * 1000000 // (60 + rank)) AS BIGINT) AS rrf, max(strength) AS strength, count(*) AS n_routes FROM ranked GROUP BY id),
    scored AS (SELECT id, rrf, n_routes, trust // 2 + (doc_id % 10 * 100000) // 3 + strength // 5 + CASE WHEN {_NORM.format('source')} = '{QUERY}' THEN 500000 ELSE 0 END + CASE WHEN list_has_any(owners, ['o1', 'en']) THEN 300000 ELSE 0 END + CASE WHEN doc_id % 9 <> 4 THEN 150000 ELSE 0 END AS modifier FROM fused JOIN ok ON doc_id = id)"""


def recall_documents(spark, d):
    """The admitted documents with what the routes ask of them; texts are read once, as their token hits."""
    ok = documents(spark, d).where(policy.allows(PRINCIPAL))
    name = text.normalize("source")
    tokens = F.array_union(text.token_set("text", 2), F.array(name, F.col("lang")))
    return ok.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("kind"), name.alias("name"), "lang", "owners", "trust", F.size(F.array_intersect(tokens, F.array(*map(F.lit, TERMS)))).alias("hits"))


def recall_routes(spark, d, docs):
    """route, id, strength: up to eight rows a document, made in one pass over it; the vector route joins its cosines."""
    ours = F.arrays_overlap("owners", F.array(F.lit("o1"), F.lit("en")))
    i, row = F.col("id"), (lambda when, name, s: F.when(when, F.struct(F.lit(name).alias("route"), s.cast("long").alias("strength"))))
    episodic = F.col("kind").isin(1, 2) & (ours | (F.col("hits") > 0))
    alias = recall.alias_strength(F.col("name"), F.lit(QUERY))
    each = F.array_compact(F.array(
        row(i % 50 == 0, "active_context", F.when(i % 100 == 0, 1_000_000).otherwise(800_000)), row((alias > 0) & F.contains(F.lit(QUERY), F.col("name")), "exact_alias", alias), row((F.col("kind") == 0) & ours, "relationship", F.lit(750_000)),
        row(episodic, "episodic", F.when(ours & (F.col("hits") > 0), 1_000_000).otherwise(700_000)), row((i % 3 == 1) & (i % 9 != 4), "temporal", F.lit(700_000)), row(F.col("lang").isin("en", "de"), "structural", F.lit(625_000)),
        row(F.col("hits") > 0, "lexical", numbers.whole(F.col("hits").cast("long") * 1_000_000, 4)),
    ))
    v = table(spark, d, "embeddings")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    cosine = v.join(docs.select(i.alias("vec_id")), "vec_id", "left_semi").join(q).select(F.lit("supplied_vector").alias("route"), F.col("vec_id").alias("id"), numbers.quantize(F.round(retrieval.cosine("embedding", "q"), 9)).alias("strength"))
    return docs.select("id", F.inline(each)).select("route", "id", "strength").unionByName(cosine.where("strength > 0"))


def recall_scored(spark, d):
    from ..sources.steps import settle

    docs = settle(recall_documents(spark, d), "recall")
    fused = recall.fused(recall_routes(spark, d, docs))
    ours = F.arrays_overlap("owners", F.array(F.lit("o1"), F.lit("en")))
    importance = F.col("id") % 10 * 100_000
    modifier = numbers.modifiers(F.col("trust"), importance, F.col("strength"), F.col("name") == QUERY, ours, F.col("id") % 9 != 4)
    return fused.join(docs, "id").select("id", "rrf", "n_routes", modifier.alias("modifier"))


@query(f"WITH {RECALL_SQL} SELECT id, rrf, n_routes, modifier, rrf + modifier AS score FROM scored ORDER BY rrf + modifier DESC, id LIMIT 50")
def deterministic_recall(spark, d):
    """Eight routes over what the reader may see, fusion, modifiers; the fifty best (the request's page)."""
    s = recall_scored(spark, d)
    return s.select("*", (F.col("rrf") + F.col("modifier")).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query(f"WITH {RECALL_SQL} SELECT route, count(*) AS n, CAST(sum(strength) AS BIGINT) AS total, min(CASE WHEN rank = 1 THEN id END) AS first FROM ranked GROUP BY route")
def route_ranks(spark, d):
    from ..sources.steps import settle

    r = recall.ranked(recall_routes(spark, d, settle(recall_documents(spark, d), "recall")))
    return r.groupBy("route").agg(F.count("*").alias("n"), F.sum("strength").alias("total"), F.min(F.when(F.col("rank") == 1, F.col("id"))).alias("first"))


@query("""WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS included, CAST(floor(abs(value)) AS BIGINT) + 5 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events),
    u AS (SELECT *, sum(CASE WHEN included THEN tokens ELSE 0 END) OVER (PARTITION BY user_id ORDER BY place) AS used FROM r), s AS (SELECT *, min(CASE WHEN used > 900 THEN place END) OVER (PARTITION BY user_id) AS stop FROM u)
    SELECT user_id, event_id, place, CAST(used AS BIGINT) AS used FROM s WHERE stop IS NULL OR place < stop""")
def select_context(spark, d):
    """Ranked items are read until one would not fit; withheld ones are told and cost nothing."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    r = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("included"), (F.floor(F.abs("value")).cast("long") + 5).alias("tokens"), place.alias("place"))
    return recall.select_context(r, ["user_id"], 900).select("user_id", "event_id", "place", "used")


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'relationship' WHEN 1 THEN 'episode' WHEN 2 THEN 'observation' ELSE 'entity' END AS kind, source AS name, array_to_string(owners, ',') AS subjects, trust FROM docs")
def reference_documents(spark, d):
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "relationship").when(k == 1, "episode").when(k == 2, "observation").otherwise("entity")
    return documents(spark, d).select(F.col("doc_id").alias("id"), kind.alias("kind"), F.col("source").alias("name"), F.array_join("owners", ",").alias("subjects"), "trust")


@query("SELECT 'r' || l_orderkey || '.' || l_linenumber AS id, 'p' || l_partkey AS source, 's' || l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS kind, CAST(floor(l_discount * 10000000 + 0.5) AS BIGINT) AS weight FROM lineitem WHERE l_linestatus = 'O'")
def reference_relations(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports")
    return table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.concat(name("r", "l_orderkey"), F.lit("."), F.col("l_linenumber").cast("string")).alias("id"), name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target"), kind.alias("kind"), F.floor(F.col("l_discount") * 10_000_000 + 0.5).cast("long").alias("weight"))


def _blocks(spark, d):
    """Blocks of each customer's requests: orders with a utility, a cost, facets."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("utility"), (F.col("o_orderkey") % 90 + 10).alias("tokens"), F.array("o_orderpriority", "o_orderstatus").alias("facets"), (F.col("o_orderpriority") == "1-URGENT").alias("mandatory"))


@query()
def compile_pack(spark, d):
    """Packs of 300 tokens for each request: mandatory blocks, then the greedy order. Order-dependent, so without SQL; tested against a plain loop."""
    return packing.pack(_blocks(spark, d), "request", 300)


@query()
def greedy_density(spark, d):
    """The first block of each request that the greedy order takes, and what a pack without a budget would hold."""
    p = packing.pack(_blocks(spark, d).withColumn("mandatory", F.lit(False)), "request", 1 << 40)
    return p.groupBy("request").agg(F.min_by("id", "place").alias("first"), F.count("*").alias("n"), F.max("used").alias("tokens"))


@query()
def minimal_evidence(spark, d):
    """The fewest best pieces for each order's claims (its parts and suppliers)."""
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_orderkey").alias("block"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"), F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 3 + 10).alias("claims"), (F.col("l_returnflag") == "R").alias("primary"), F.floor(F.col("l_discount") * 1000).cast("long").alias("trust"), F.floor("l_quantity").cast("long").alias("tokens"))
    return packing.cover(e, "block").select("block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderstatus = 'P' AND o_totalprice > 200000)")
def mandatory_ids(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT' or (o_orderstatus = 'P' and o_totalprice > 200000)").select("o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS at, sum(o_orderkey % 90 + 10) OVER w > 250 OR sum(o_orderkey % 3) OVER w > 6 AS past FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), s AS (SELECT *, min(CASE WHEN past THEN at END) OVER (PARTITION BY o_custkey) AS stop FROM n)
    SELECT o_custkey, o_orderkey FROM s WHERE stop IS NULL OR "at" < stop""".replace(" AS at,", ' AS "at",').replace("THEN at END", 'THEN "at" END'))
def fit_pack(spark, d):
    """Blocks in order while tokens and pieces of evidence stay within their budgets."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 90 + 10).alias("tokens"), (F.col("o_orderkey") % 3).alias("pieces"))
    return packing.fit(o, ["o_custkey"], ["o_orderkey"], {"tokens": 250, "pieces": 6}).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS covered, 5 - count(DISTINCT o_orderpriority) AS missing, count(DISTINCT o_orderpriority) = 5 AS sufficient FROM orders GROUP BY o_custkey")
def pack_sufficiency(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("covered"))
    return g.select("o_custkey", "covered", (5 - F.size("covered")).alias("missing"), (F.size("covered") == 5).alias("sufficient"))


@query("SELECT role, count(*) AS blocks, CAST(sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]'))) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def category_tokens(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("blocks"), F.sum(text.token_count("text")).alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN 'whole' WHEN turn % 2 = 0 THEN 'excerpt' ELSE 'summary' END AS variant, CASE WHEN length(text) <= 60 THEN strlen(text) WHEN turn % 2 = 0 THEN strlen(left(text, 60)) ELSE least(strlen(text), 24) END AS bytes FROM conversations")
def choose_variants(spark, d):
    """Of a block's forms the cheapest that its rule admits."""
    short, even = F.length("text") <= 60, F.col("turn") % 2 == 0
    size = F.when(short, F.octet_length("text")).when(even, F.octet_length(F.left("text", F.lit(60)))).otherwise(F.least(F.octet_length("text"), F.lit(24)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(short, "whole").when(even, "excerpt").otherwise("summary").alias("variant"), size.alias("bytes"))


@query(f"WITH {RECALL_SQL}, top AS (SELECT id, rrf + modifier AS score FROM scored ORDER BY rrf + modifier DESC, id LIMIT 50), c AS (SELECT top.id, score, length(text) // 4 + 1 AS tokens, sum(length(text) // 4 + 1) OVER (ORDER BY score DESC, top.id) AS used FROM top JOIN documents ON doc_id = top.id) SELECT id, score, tokens FROM c WHERE used <= 4000")
def compile_from_recall(spark, d):
    """A pack from recall: the best items in order while they fit."""
    top = deterministic_recall(spark, d).select("id", "score")
    sized = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), (numbers.whole(F.length("text").cast("long"), 4) + 1).alias("tokens")), "id")
    return retrieval.budget_prefix(sized.withColumn("one", F.lit(1)), ["one"], [F.desc("score"), "id"], "tokens", 4000).select("id", "score", "tokens")


@query("""SELECT subject, '{"blocks":' || count(*) || ',"tokens":' || CAST(sum(event_id % 90) AS BIGINT) || '}' AS pack FROM (SELECT user_id AS subject, event_id FROM events WHERE event_type = 'purchase') GROUP BY subject""")
def knowledge_pack_json(spark, d):
    g = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("subject")).agg(F.count("*").alias("blocks"), F.sum(F.col("event_id") % 90).alias("tokens"))
    return g.select("subject", values.canonical(blocks="blocks", tokens="tokens").alias("pack"))


@query(f"SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: length(t) >= 4)))[1:5] AS terms, CASE WHEN turn = 0 THEN 'bootstrap' ELSE 'continue' END AS plan FROM conversations WHERE role = 'user'")
def conversation_plan(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'")
    return t.select("conv_id", "turn", F.slice(text.token_set("text", 4), 1, 5).alias("terms"), F.when(F.col("turn") == 0, "bootstrap").otherwise("continue").alias("plan"))


@query("WITH n AS (SELECT conv_id, max(turn) AS last, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, turns, last, CASE WHEN turns > 6 THEN 'pack' ELSE 'degrade' END AS outcome FROM n")
def before_turn(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("turns"))
    return n.withColumn("outcome", F.when(F.col("turns") > 6, "pack").otherwise("degrade"))


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE {ALLOWED_SQL} AND list_has_any(audience, ['de', '*'])")
def handoff(spark, d):
    """What one reader has that the next may see, too."""
    mine = documents(spark, d).where(policy.allows(PRINCIPAL))
    return mine.where(F.arrays_overlap("audience", F.array(F.lit("de"), F.lit("*")))).select("doc_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'deny' WHEN event_type = 'purchase' AND value > 60 THEN 'ask' ELSE 'allow' END AS gate FROM events")
def preflight(spark, d):
    gate = F.when(F.col("event_type") == "error", "deny").when((F.col("event_type") == "purchase") & (F.col("value") > 60), "ask").otherwise("allow")
    return table(spark, d, "events").select("event_id", gate.alias("gate"))


@query("""WITH f AS (SELECT a.s_suppkey AS source, b.s_suppkey AS target, unnest(list_filter([CASE WHEN b.s_nationkey < a.s_nationkey THEN 'context/blocking' END, CASE WHEN b.s_suppkey % 5 < a.s_suppkey % 5 THEN 'schema/blocking' END, CASE WHEN a.s_suppkey % 3 <> b.s_suppkey % 3 THEN 'tokenizer/warning' END,
        CASE WHEN a.s_suppkey % 4 <> b.s_suppkey % 4 THEN 'embedding/warning' END, CASE WHEN a.s_suppkey % 2 <> b.s_suppkey % 2 THEN 'format/informational' END], lambda x: x IS NOT NULL)) AS f FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
    SELECT source, target, split_part(f, '/', 1) AS finding, split_part(f, '/', 2) AS gravity FROM f""")
def compatibility(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    both = s.select(F.col("k").alias("source"), F.col("n").alias("n1"), (F.col("k") + 1).alias("target")).join(s.select(F.col("k").alias("target"), F.col("n").alias("n2")), "target")
    facts = lambda k, n: {"context": n, "schema": k % 5, "tokenizer": k % 3, "embedding": k % 4, "format": k % 2}
    return both.select("source", "target", F.inline(packing.findings(facts(F.col("source"), F.col("n1")), facts(F.col("target"), F.col("n2")))))


@query("SELECT event_id, CASE WHEN list_contains(issues, 'denied') THEN 'rejected' WHEN len(issues) > 0 THEN 'quarantined' ELSE 'accepted' END AS disposition, len(issues) AS n_issues FROM (SELECT event_id, list_filter([CASE WHEN value < 20 THEN 'low_score' END, CASE WHEN event_type = 'error' THEN 'denied' END, CASE WHEN user_id % 7 = 0 AND event_type = 'view' THEN 'needs_support' END], lambda x: x IS NOT NULL) AS issues FROM events)")
def adjudicate(spark, d):
    """Hard rules leave issues; one that rejects rejects, others quarantine."""
    said = lambda when, name: F.when(when, F.lit(name))
    issues = F.array_compact(F.array(said(F.col("value") < 20, "low_score"), said(F.col("event_type") == "error", "denied"), said((F.col("user_id") % 7 == 0) & (F.col("event_type") == "view"), "needs_support")))
    e = table(spark, d, "events").select("event_id", issues.alias("issues"))
    return e.select("event_id", F.when(F.array_contains("issues", "denied"), "rejected").when(F.size("issues") > 0, "quarantined").otherwise("accepted").alias("disposition"), F.size("issues").alias("n_issues"))


@query("SELECT DISTINCT user_id AS root, w AS work FROM (SELECT user_id, unnest(CASE WHEN event_type IN ('purchase', 'signup') THEN ['index', 'vector', 'hierarchy'] ELSE ['index'] END) AS w FROM events WHERE event_type <> 'view')")
def dirty_work(spark, d):
    work = F.when(F.col("event_type").isin("purchase", "signup"), F.array(*map(F.lit, ("index", "vector", "hierarchy")))).otherwise(F.array(F.lit("index")))
    return table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("root"), F.explode(work).alias("work")).distinct()


@query("SELECT user_id AS source, event_id, CASE event_type WHEN 'purchase' THEN 'assert' WHEN 'error' THEN 'retract' ELSE 'open_question' END AS action, event_id = min(event_id) OVER (PARTITION BY user_id, props) AS applied FROM events")
def knowledge_publish(spark, d):
    """Statements of a source's revision; the same revision a second time changes nothing."""
    action = F.when(F.col("event_type") == "purchase", "assert").when(F.col("event_type") == "error", "retract").otherwise("open_question")
    e = table(spark, d, "events")
    first = e.groupBy("user_id", "props").agg(F.min("event_id").alias("first"))
    return e.join(first, ["user_id", "props"]).select(F.col("user_id").alias("source"), "event_id", action.alias("action"), (F.col("event_id") == F.col("first")).alias("applied"))


# Vectors.


@query(f"""WITH {DOCUMENTS_SQL}, v AS (SELECT v.vec_id, CAST(v.embedding AS DOUBLE[]) AS a, CAST(q.embedding AS DOUBLE[]) AS b FROM embeddings v, embeddings q WHERE q.vec_id = 2 AND v.vec_id <> 2 AND v.vec_id IN (SELECT doc_id FROM docs WHERE {ALLOWED_SQL})),
    s AS (SELECT vec_id, unnest(['cosine', 'dot', 'euclidean']) AS metric, unnest([round(list_cosine_similarity(a, b), 8), round(list_dot_product(a, b), 8), round(-list_distance(a, b), 8)]) AS score FROM v)
    SELECT metric, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, vec_id) <= 10""")
def exact_vector_search(spark, d):
    """The ten best by each measure, over vectors that the reader may see."""
    v = table(spark, d, "embeddings")
    ok = documents(spark, d).where(policy.allows(PRINCIPAL)).select(F.col("doc_id").alias("vec_id"))
    q = F.broadcast(v.where("vec_id = 2").select(F.col("embedding").alias("q")))
    s = v.where("vec_id <> 2").join(ok, "vec_id", "left_semi").join(q)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(vectors.score(m, "embedding", "q"), 8).alias("score")) for m in ("cosine", "dot", "euclidean")))).alias("s")
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"), "vec_id"))
    return s.select("vec_id", each).select("s.metric", "vec_id", "s.score").withColumn("p", place).where("p <= 10").drop("p")


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN list_dot_product(embedding, embedding) = 0 THEN 'zero' END AS fault FROM embeddings")
def vector_validation(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vectors.fault("embedding", 64).alias("fault"))


@query("SELECT label AS space, 64 AS dimensions, 'cosine' AS metric, count(*) AS vectors, min(vec_id) AS first FROM embeddings GROUP BY label")
def vector_spaces(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("space")).agg(F.first(F.lit(64)).alias("dimensions"), F.first(F.lit("cosine")).alias("metric"), F.count("*").alias("vectors"), F.min("vec_id").alias("first"))


@query("SELECT vec_id, sha256(label || '/' || CASE WHEN vec_id % 3 = 0 THEN 'open' ELSE 'closed' END) AS partition FROM embeddings")
def policy_partitions(spark, d):
    name = F.concat(F.col("label").cast("string"), F.lit("/"), F.when(F.col("vec_id") % 3 == 0, "open").otherwise("closed"))
    return table(spark, d, "embeddings").select("vec_id", F.sha2(name, 256).alias("partition"))


@query("""WITH v AS (SELECT v.vec_id AS id, CAST(floor(greatest(round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 8), 0) * 1000000 + 0.5) AS BIGINT) AS strength FROM embeddings v, embeddings q WHERE q.vec_id = 3) SELECT id, strength FROM v WHERE strength > 0""")
def supplied_vector_strength(spark, d):
    v = table(spark, d, "embeddings")
    q = F.broadcast(v.where("vec_id = 3").select(F.col("embedding").alias("q")))
    return v.join(q).select(F.col("vec_id").alias("id"), numbers.quantize(F.round(vectors.score("cosine", "embedding", "q"), 8)).alias("strength")).where("strength > 0")


_GEN_SQL = "built AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 <> 3), delta AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 = 3), dead AS (SELECT vec_id FROM embeddings WHERE vec_id % 17 = 5)"


@query(f"""WITH {_GEN_SQL}, live AS (SELECT * FROM built UNION ALL SELECT * FROM delta) SELECT v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 8) AS score FROM live v, embeddings q WHERE q.vec_id = 1 AND v.vec_id <> 1 AND v.vec_id NOT IN (SELECT vec_id FROM dead) ORDER BY 2 DESC, 1 LIMIT 20""")
def vector_delta_overlay(spark, d):
    """A built generation and the delta behind it, without tombstones whatever the snapshot."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    live = v.where("vec_id % 10 <> 3").unionByName(v.where("vec_id % 10 = 3")).join(v.where("vec_id % 17 = 5").select("vec_id"), "vec_id", "left_anti")
    q = F.broadcast(v.where("vec_id = 1").select(F.col("embedding").alias("q")))
    return live.where("vec_id <> 1").join(q).select(F.col("vec_id").alias("id"), F.round(vectors.score("cosine", "embedding", "q"), 8).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query()
def partitioned_vector_search(spark, d):
    """Approximate search by cells: the query visits the nearest cells, exact scores there (many, as these vectors hardly cluster). Recall is tested against all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.search(vectors.build(v, cells=16), v.where("id % 50 = 0"), probes=13, k=10)


@query("SELECT 'published' AS pointer, max(vec_id) // 100 AS generation FROM embeddings WHERE vec_id % 100 < 90 UNION ALL SELECT 'staged', max(vec_id) // 100 + 1 FROM embeddings WHERE vec_id % 100 < 90")
def generation_pointers(spark, d):
    top = table(spark, d, "embeddings").where("vec_id % 100 < 90").agg(F.expr("max(vec_id) div 100").alias("g"))
    return top.select(F.explode(F.array(F.struct(F.lit("published").alias("pointer"), F.col("g").alias("generation")), F.struct(F.lit("staged").alias("pointer"), (F.col("g") + 1).alias("generation")))).alias("p")).select("p.*")


@query("SELECT vec_id % 7 AS generation, count(*) AS vectors, CASE WHEN vec_id % 7 = 5 THEN 'fenced' ELSE 'kept' END AS state FROM embeddings GROUP BY 1, 3")
def ann_recover(spark, d):
    """After a crash only the fenced, unpublished generation goes."""
    g = F.col("vec_id") % 7
    return table(spark, d, "embeddings").groupBy(g.alias("generation"), F.when(g == 5, "fenced").otherwise("kept").alias("state")).agg(F.count("*").alias("vectors"))


@query("SELECT label, sha256(string_agg(sha256(CAST(vec_id AS VARCHAR)), '' ORDER BY vec_id)) AS digest, count(*) AS vectors FROM embeddings GROUP BY label")
def ann_verify(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("h")))).alias("rows"), F.count("*").alias("vectors"))
    return g.select("label", F.sha2(F.array_join(F.transform("rows", lambda r: r["h"]), ""), 256).alias("digest"), "vectors")
