"""Queries over the text, number and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, values
from ..sources.tables import DOCUMENTS_SQL, documents, micros, table
from .registry import query

NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
TOKENS = "list_filter(string_split(" + NORMAL + ", ' '), lambda t: t <> '')"
WORDISH = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: lower(t))"


@query(f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize("text")).alias("normal"))


@query(f"WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2))) AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM t")
def tokens_recall(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.token_set("text", 2).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"WITH t AS (SELECT doc_id, list_sort(list_distinct({TOKENS.format('text')})) AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM t")
def tokens_oracle(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.token_set("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM t")
def tokens_lexical(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.all_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"SELECT page_id, len(list_filter(list_distinct({TOKENS.format('html')}), lambda t: strlen(t) <= 6)) AS n FROM pages")
def lexical_terms_bounded(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(text.bounded_terms("html", 6)).alias("n"))


@query(f"""WITH s AS (SELECT doc_id, text, len(list_intersect(['and', 'the', 'thand'], list_distinct({TOKENS.format('text')}))) AS n FROM documents)
    SELECT doc_id, round(n / 3.0 + CASE WHEN contains(lower(text), 'the thand and') THEN 1.0 ELSE 0.0 END, 9) AS score FROM s WHERE n > 0""")
def lexical_score_phrase(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.overlap_score("the thand and", "text"), 9).alias("score")).where("score is not null")


@query("""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^\\p{L}\\p{N}_]*)([\\p{L}\\p{N}_]+)', 1)) AS gap, unnest(regexp_extract_all(text, '([^\\p{L}\\p{N}_]*)([\\p{L}\\p{N}_]+)', 2)) AS own,
                unnest(range(len(regexp_extract_all(text, '([^\\p{L}\\p{N}_]*)([\\p{L}\\p{N}_]+)', 2)))) AS place FROM documents),
    s AS (SELECT doc_id, place, lower(own) AS term, strlen(own) AS n, sum(strlen(gap) + strlen(own)) OVER (PARTITION BY doc_id ORDER BY place) AS e FROM g)
    SELECT doc_id, min(e - n) AS first_start, max(e) AS last_end, CAST(sum(e - n) AS BIGINT) AS starts, count(*) AS n FROM s GROUP BY doc_id""")
def raw_token_spans(spark, d):
    s = text.spans(table(spark, d, "documents"), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.sum("start").alias("starts"), F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, list_sort(list_distinct({WORDISH.format('text')}))[1:3] AS terms FROM conversations")
def raw_query_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.slice(F.array_sort(F.array_distinct(text.wordish("text"))), 1, 3).alias("terms"))


@query("SELECT conv_id, turn, lower(nullif(regexp_extract(regexp_replace(regexp_replace(text, '^[\\p{L}\\p{N}_]+', ''), '[\\p{L}\\p{N}_]+$', ''), '([\\p{L}\\p{N}_]+)', 1), '')) AS anchor FROM conversations")
def phrase_anchors(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.phrase_anchor("text").alias("anchor"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'remember') OR contains(lower(text), 'onthe') OR contains(lower(text), 'erlyen')")
def contains_any(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").where(F.contains(low, F.lit("remember")) | F.contains(low, F.lit("onthe")) | F.contains(low, F.lit("erlyen"))).select("doc_id")


@query("SELECT event_id, coalesce(nullif(trim(event_type), ''), props) || ' ' || props AS query_text FROM events")
def query_text(spark, d):
    return table(spark, d, "events").select("event_id", F.concat_ws(" ", F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), "props"), "props").alias("query_text"))


@query(f"SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat({TOKENS.format('p_name')}, {TOKENS.format('p_brand')}, {TOKENS.format('p_type')}), lambda t: length(t) >= 2))) AS tokens FROM part")
def document_tokens(spark, d):
    of = lambda c: text.token_set(c, 2)
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_union(F.array_union(of("p_name"), of("p_brand")), of("p_type"))).alias("tokens"))


@query("SELECT c_custkey, lower(trim(regexp_replace(c_name || '  ' || c_mktsegment || ' ', '\\s+', ' ', 'g'))) AS entity FROM customer")
def entity_normalize(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.collapse(F.concat("c_name", F.lit("  "), "c_mktsegment", F.lit(" "))).alias("entity"))


@query("""WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM t)
    SELECT conv_id, turn, strlen(t) > strlen(old) AND contains(t, left(old, 3)) AS refines FROM p WHERE old IS NOT NULL""")
def refinements(spark, d):
    from pyspark.sql import Window

    old = F.lag(text.collapse("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, d, "conversations").withColumn("old", old).where("old is not null")
    longer = F.octet_length(text.collapse("text")) > F.octet_length("old")
    return t.select("conv_id", "turn", (longer & F.contains(text.collapse("text"), F.left("old", F.lit(3)))).alias("refines"))


_CUE_SQL = " ".join(f"WHEN starts_with(lower(t), '{cue.replace(chr(39), chr(39) * 2)}') THEN CASE WHEN trim(substr(t, {len(cue) + 1})) <> '' THEN '{kind}' END" for cue, kind in text.CUES)
_TURNS = "(SELECT conv_id, turn, trim(CASE turn % 5 WHEN 0 THEN 'I prefer ' || text WHEN 1 THEN '  My goal is ' || text WHEN 2 THEN 'Do not mention ' WHEN 3 THEN 'я обещаю ' || text ELSE text END) AS t FROM conversations)"


@query(f"SELECT conv_id, turn, CASE {_CUE_SQL} END AS signal FROM {_TURNS}")
def turn_extraction(spark, d):
    said = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("I prefer "), "text")).when(F.col("turn") % 5 == 1, F.concat(F.lit("  My goal is "), "text")).when(F.col("turn") % 5 == 2, F.lit("Do not mention ")).when(F.col("turn") % 5 == 3, F.concat(F.lit("я обещаю "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.signal(said).alias("signal"))


@query("SELECT conv_id, turn, 'rule-' || left(sha256('turn-v1' || chr(0) || text || chr(0) || turn), 16) AS local_id FROM conversations")
def deterministic_local_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.local_id("turn-v1", "text", F.col("turn")).alias("local_id"))


@query("""WITH q AS (SELECT doc_id, text, strpos(text, 'hation') AS a, length('hation') AS n FROM documents)
    SELECT doc_id, strlen(left(text, a - 1)) AS from_byte, strlen(left(text, a - 1)) + 6 AS to_byte FROM q WHERE a > 0 AND strpos(substr(text, a + n), 'hation') = 0""")
def unique_quote_range(spark, d):
    a, b = text.unique_range("text", F.lit("hation"))
    return table(spark, d, "documents").select("doc_id", a.alias("from_byte"), b.alias("to_byte")).where("from_byte is not null")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, md5(substr(l[1], 4) || chr(10) || left(l[2], 2)) AS part FROM l WHERE len(l) >= 2 AND length(l[1]) >= 3 AND length(l[2]) >= 2""")
def source_ranges(spark, d):
    part = text.source_range("text", F.lit(1), F.lit(3), F.lit(2), F.lit(2))
    return table(spark, d, "documents").select("doc_id", F.md5(part).alias("part")).where("part is not null")


@query("SELECT p_partkey, regexp_matches(replace(lower(p_name), ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+)*$') AS kebab, regexp_matches(p_brand, '^[a-z0-9]+(-[a-z0-9]+)*$') AS brand FROM part")
def kebab_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.is_kebab(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))).alias("kebab"), text.is_kebab("p_brand").alias("brand"))


@query("SELECT s_suppkey, 'candidate:' || sha256('v1' || chr(0) || s_nationkey || chr(0) || lower(s_name)) AS candidate_id FROM supplier")
def candidate_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("candidate:"), F.sha2(F.concat_ws("\u0000", F.lit("v1"), F.col("s_nationkey").cast("string"), F.lower("s_name")), 256)).alias("candidate_id"))


@query("SELECT n_nationkey, lower(hex(encode(n_name))) AS code, n_name AS name FROM nation")
def hex_round_trip(spark, d):
    code = F.lower(F.hex(F.encode("n_name", "UTF-8")))
    return table(spark, d, "nation").select("n_nationkey", code.alias("code"), F.decode(F.unhex(code), "UTF-8").alias("name"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) AS tokens FROM documents")
def reference_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count("text").alias("tokens"))


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(list_distinct(list_filter({WORDISH.format('text')}, lambda t: length(t) >= 3 AND strlen(t) <= 256))) AS t FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(t) DESC, t) AS r FROM t) SELECT conv_id, turn, r AS place, t AS term FROM r WHERE r <= 8""")
def longest_terms(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.longest_terms("text")).alias("place", "term"))
    return t.withColumn("place", F.col("place") + 1)


@query("SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def sectioned_render(spark, d):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("rendered"))


# Numbers.


@query("""SELECT event_id, CASE WHEN e <= 1705000000000000 THEN 'historical' WHEN e IS NOT NULL THEN CASE WHEN s <= 1705000000000000 THEN 'bounded_current' ELSE 'future' END
    WHEN s > 1705000000000000 THEN 'future' ELSE 'current' END AS class FROM (SELECT event_id, epoch_us(ts) AS s, CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) + event_id % 9 * 86400000000 END AS e FROM events)""")
def temporal_classes(spark, d):
    start = micros("ts")
    end = F.when(F.col("event_id") % 3 > 0, start + F.col("event_id") % 9 * F.lit(86_400_000_000))
    return table(spark, d, "events").select("event_id", numbers.temporal_class(start, end, F.lit(1_705_000_000_000_000)).alias("class"))


@query("SELECT event_id, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 1000000 AS end_us FROM events WHERE CAST(floor(abs(value)) AS BIGINT) > 0")
def bounded_times(spark, d):
    span = F.floor(F.abs("value")).cast("long")
    return table(spark, d, "events").where(span > 0).select("event_id", micros("ts").alias("start_us"), (micros("ts") + span * 1_000_000).alias("end_us"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(least(greatest(l_discount * 12, 0.0), 1.0) * 1000000 + 0.5) AS BIGINT) AS micros FROM lineitem")
def quantized_units(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.quantize(F.col("l_discount") * 12).alias("micros"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(numbers.norm("embedding"), 6).alias("norm"))


@query("""WITH z AS (SELECT vec_id, CAST('0x' || left(sha256(CAST(vec_id AS VARCHAR)), 2) AS INTEGER) AS b FROM embeddings)
    SELECT vec_id, least(CASE WHEN b = 0 THEN 8 WHEN b < 2 THEN 7 WHEN b < 4 THEN 6 WHEN b < 8 THEN 5 WHEN b < 16 THEN 4 WHEN b < 32 THEN 3 WHEN b < 64 THEN 2 WHEN b < 128 THEN 1 ELSE 0 END // 2, 4) AS level FROM z""")
def deterministic_levels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", numbers.level(F.col("vec_id").cast("string")).alias("level"))


_JSON = "'{\"id\":' || o_orderkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}'"


@query(f"SELECT o_orderkey, {_JSON} AS json FROM orders")
def canonical_json(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.canonical(status="o_orderstatus", id="o_orderkey", priority="o_orderpriority").alias("json"))


@query(f"SELECT o_orderkey, sha256({_JSON}) AS digest FROM orders")
def canonical_digest(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.digest(status="o_orderstatus", id="o_orderkey", priority="o_orderpriority").alias("digest"))


@query("SELECT event_id, sha256('put' || chr(0) || user_id || chr(0) || event_type || chr(0) || props) AS digest FROM events")
def operation_digests(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("\u0000", F.lit("put"), F.col("user_id").cast("string"), "event_type", "props"), 256).alias("digest"))


@query("SELECT doc_id, sha256('k1' || chr(0) || sha256('k1' || chr(0) || source || chr(0) || lang)) AS digest FROM documents")
def keyed_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", values.keyed("k1", F.col("source"), F.col("lang")).alias("digest"))


@query("SELECT page_id, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] AS uuid FROM (SELECT page_id, sha256('page' || chr(0) || url) AS h FROM pages)")
def deterministic_uuids(spark, d):
    return table(spark, d, "pages").select("page_id", numbers.name_uuid(F.lit("page"), F.col("url")).alias("uuid"))


@query("SELECT s_suppkey, sha256('leaf' || chr(0) || length(CAST(s_suppkey AS VARCHAR)) || ':' || s_suppkey || length(s_name) || ':' || s_name) AS leaf FROM supplier")
def merkle_leaves(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", numbers.leaf("leaf", F.col("s_suppkey").cast("string"), F.col("s_name")).alias("leaf"))


@query("SELECT event_id, CAST(least(250.0 * pow(2, least(greatest(event_id % 12 - 1, 0), 31)), 30000) AS BIGINT) AS wait_ms, least(CASE WHEN event_id % 5 = 0 THEN event_id % 50000 ELSE CAST(least(250.0 * pow(2, least(greatest(event_id % 12 - 1, 0), 31)), 30000) AS BIGINT) END, 30000) AS told_ms FROM events")
def backoff_delays(spark, d):
    n = F.col("event_id") % 12
    return table(spark, d, "events").select("event_id", numbers.backoff(n, 250, 30_000).alias("wait_ms"), numbers.backoff(n, 250, 30_000, F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 50_000)).alias("told_ms"))


@query("SELECT doc_id, 500 + (n_chars * 300 + 999999) // 1000000 + (n_chars % 97 * 1500 + 999999) // 1000000 AS cost, (n_chars * 300 + n_chars % 97 * 1500 + n_chars % 13 * 30 + 999999) // 1000000 + 500 AS charge FROM documents")
def token_costs(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", numbers.cost(n, n % 97, 500, 300, 1500).alias("cost"), numbers.charge([(n, 300), (n % 97, 1500), (n % 13, 30)], 500).alias("charge"))


@query("""SELECT doc_id, doc_id * CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 * (doc_id % 4) + 1 END AS marginal,
    CASE WHEN doc_id * (least(doc_id % 11, 8) + 1) // greatest(n_chars // 40, 1) >= 100 THEN doc_id * (least(doc_id % 11, 8) + 1) END AS r0 FROM documents""")
def marginal_scores(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", numbers.marginal_value(i, i % 4).alias("marginal"), numbers.r0_score(i, i % 11, numbers.whole(F.col("n_chars"), 40)).alias("r0"))


@query("""WITH c AS (SELECT p_partkey, p_size, CAST(floor(p_retailprice) AS BIGINT) AS utility, p_partkey % 5 AS fresh, p_size + 1 AS cost FROM part),
    v AS (SELECT p_partkey, p_size, CAST(utility * CASE WHEN fresh = 0 THEN 1 ELSE 2 * fresh + 1 END AS HUGEINT) AS v, cost FROM c)
    SELECT a.p_partkey, b.p_partkey AS other, a.v * b.cost > b.v * a.cost AS denser FROM v a JOIN v b ON a.p_partkey + 1 = b.p_partkey""")
def density_compare(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 1).alias("cost"), numbers.marginal_value(F.floor("p_retailprice").cast("long"), F.col("p_partkey") % 5).cast("decimal(19,0)").alias("v"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("other"), F.col("cost").cast("decimal(10,0)").alias("other_cost"), F.col("v").alias("other_v"))
    return p.join(b, "p_partkey").select("p_partkey", "other", (F.col("v") * F.col("other_cost") > F.col("other_v") * F.col("cost").cast("decimal(10,0)")).alias("denser"))


@query("""SELECT l_orderkey, arg_max(l_linenumber, row(l_returnflag = 'R', l_quantity, l_discount, -l_extendedprice, -l_linenumber)) AS best FROM lineitem GROUP BY l_orderkey""")
def evidence_better(spark, d):
    order = F.struct((F.col("l_returnflag") == "R").alias("primary"), "l_quantity", "l_discount", (-F.col("l_extendedprice")).alias("cost"), (-F.col("l_linenumber")).alias("line"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", order).alias("best"))


@query("SELECT user_id, CASE WHEN n <= 1 THEN 'constant' WHEN n <= 32 THEN 'small' WHEN n <= 256 THEN 'medium' ELSE 'large' END AS work FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id)")
def work_buckets(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n")).select("user_id", numbers.work_bucket("n").alias("work"))


# Tagged values, JSON and selectors.


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'object' ELSE 'string' END AS kind FROM events")
def value_types(spark, d):
    i = F.col("event_id")
    v = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, F.col("props")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    return table(spark, d, "events").select("event_id", values.value_type(v).alias("kind"))


@query("SELECT event_id, '{\"type\":\"string\",\"value\":\"' || event_type || '\"}' AS object_key, user_id || chr(0) || event_type AS slot_key FROM events")
def object_and_slot_keys(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", values.object_key(F.lit("string"), F.col("event_type")).alias("object_key"), values.slot_key(F.col("user_id"), F.col("event_type")).alias("slot_key"))


@query("SELECT event_id, 1 + event_id % 3 AS depth, strlen(props) + 2 * (event_id % 3) <= 11 AS bounded FROM events")
def json_checks(spark, d):
    n = F.col("event_id") % 3
    j = F.concat(F.repeat(F.lit("["), n.cast("int")), "props", F.repeat(F.lit("]"), n.cast("int")))
    return table(spark, d, "events").select("event_id", values.json_depth(j).alias("depth"), values.json_bounded(j, 11).alias("bounded"))


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, len(scopes) <= 1 AND len(list_filter(scopes, lambda x: strlen(x) > 4)) = 0 AS scopes_valid, strlen(source) <= 4 AND trim(source) <> '' AS source_valid FROM docs")
def string_sets(spark, d):
    return documents(spark, d).select("doc_id", values.string_set_valid("scopes", 1, 4).alias("scopes_valid"), values.text_valid("source", 4).alias("source_valid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_selectors(spark, d):
    return table(spark, d, "events").select("event_id", values.select("json", "props", "$.k").cast("long").alias("k"), values.select("tool_field", "props", "$.none").alias("none"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 12 THEN text[5:12] END AS chars, CASE WHEN strlen(text) >= 9 THEN upper(hex(encode(text)))[7:18] END AS bytes,
    CASE WHEN len(string_split(text, chr(10))) >= 3 THEN md5(array_to_string(string_split(text, chr(10))[2:3], chr(10))) END AS lines FROM documents""")
def evidence_selectors(spark, d):
    return table(spark, d, "documents").select("doc_id", values.select("characters", "text", 4, 12).alias("chars"), values.select("bytes", "text", 3, 9).alias("bytes"), F.md5(values.select("lines", "text", 2, 3)).alias("lines"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), '') AS heading FROM pages")
def heading_selectors(spark, d):
    return table(spark, d, "pages").select("page_id", values.select("heading", "html", "title").alias("heading"))


@query("SELECT p_partkey, sha256('part' || chr(0) || p_brand || chr(0) || p_type) AS section FROM part")
def section_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("\u0000", F.lit("part"), "p_brand", "p_type"), 256).alias("section"))


@query("SELECT event_id, concat_ws(' ', 'user ' || user_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR)) AS projection FROM events")
def lexical_projection(spark, d):
    return table(spark, d, "events").select("event_id", F.concat_ws(" ", F.concat(F.lit("user "), F.col("user_id").cast("string")), "event_type", F.get_json_object("props", "$.k")).alias("projection"))


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, workspace, sensitivity, array_to_string(scopes, ',') AS scopes, array_to_string(list_sort(purposes), ',') AS purposes, consent AND retrievable AS open FROM docs")
def access_projection(spark, d):
    return documents(spark, d).select("doc_id", "workspace", "sensitivity", F.array_join("scopes", ",").alias("scopes"), F.array_join(F.array_sort("purposes"), ",").alias("purposes"), (F.col("consent") & F.col("retrievable")).alias("open"))


@query("SELECT event_id, 'put' AS op, 0 AS ordinal, event_type AS target FROM events UNION ALL SELECT event_id, 'link', 1, CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase'")
def mutation_rows(spark, d):
    link = F.when(F.col("event_type") == "purchase", F.struct(F.lit("link").alias("op"), F.col("user_id").cast("string").alias("target")))
    each = F.posexplode(F.array_compact(F.array(F.struct(F.lit("put").alias("op"), F.col("event_type").alias("target")), link))).alias("ordinal", "m")
    return table(spark, d, "events").select("event_id", each).select("event_id", "m.op", "ordinal", "m.target")
