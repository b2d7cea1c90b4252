"""Queries over keyed reads, pages, orders and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import policy, scans
from ..sources.tables import DOCUMENTS_SQL, documents, edges, micros, table
from .registry import ALLOWED_SQL, EDGES_SQL, PRINCIPAL, at_mid, query
from .registry import CLAIMS_SQL, MID_SQL

_KV = "kv AS (SELECT o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, o_totalprice AS v, length(o_orderpriority) + o_orderkey % 50 AS size FROM orders)"


def _kv(spark, d):
    key = F.concat("o_orderpriority", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return table(spark, d, "orders").select(key.alias("key"), F.col("o_totalprice").alias("v"), (F.length("o_orderpriority") + F.col("o_orderkey") % 50).alias("size"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) // 2 FROM orders)")
def point_get(spark, d):
    o = table(spark, d, "orders")
    key = o.agg(F.expr("max(o_orderkey) div 2 as k")).first().k
    return o.where(F.col("o_orderkey") == key).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def prefix_scan(spark, d):
    return table(spark, d, "documents").where(F.startswith("source", F.lit("src1"))).select("doc_id", "source")


@query(f"""WITH {_KV}, p AS (SELECT *, row_number() OVER (ORDER BY key) AS n, sum(size) OVER (ORDER BY key) AS b FROM kv WHERE key > '2-HIGH/00000100' ORDER BY key LIMIT 101)
    SELECT key, v, (SELECT count(*) FROM p WHERE n > 100 OR (n > 1 AND b > 1500)) > 0 AS has_more FROM p WHERE n <= 100 AND (n = 1 OR b <= 1500)""")
def bounded_page(spark, d):
    return scans.page(_kv(spark, d), ["key"], F.col("key") > "2-HIGH/00000100", 100, "size", 1500).select("key", "v", "has_more")


@query("""WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events), q AS (SELECT * FROM p WHERE (user_id, ordinal) > (3, 5) ORDER BY user_id, ordinal LIMIT 51)
    SELECT user_id, ordinal, event_id, (SELECT count(*) FROM q) > 50 AS has_more FROM q ORDER BY user_id, ordinal LIMIT 50""")
def workspace_event_page(spark, d):
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("event_id", "user_id", ordinal.alias("ordinal"))
    after = F.struct("user_id", "ordinal") > F.struct(F.lit(3).cast("long").alias("user_id"), F.lit(5).alias("ordinal"))
    return scans.page(rows, ["user_id", "ordinal"], after, 50).select("user_id", "ordinal", "event_id", "has_more")


@query("""WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'delete' ELSE 'put' END AS op, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, 'put', c_acctbal FROM customer WHERE c_custkey % 10 = 0)
    SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN op IS NULL THEN c_acctbal ELSE v END AS c_acctbal FROM customer FULL JOIN s ON k = c_custkey WHERE op IS NULL OR op = 'put'""")
def staged_overlay(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    staged = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "delete").otherwise("put").alias("op"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    fresh = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("put").alias("op"), "c_acctbal")
    return scans.overlay(c, staged.unionByName(fresh), "c_custkey", ["c_acctbal"])


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, lang FROM docs WHERE {ALLOWED_SQL} AND lang = 'en' AND (deleted_at IS NULL OR deleted_at > (SELECT max(doc_id) // 2 FROM documents))")
def scan_by_kind(spark, d):
    """All admitted active records of one kind at a snapshot."""
    at = F.broadcast(table(spark, d, "documents").agg(F.expr("max(doc_id) div 2").alias("at")))
    return documents(spark, d).where(policy.allows(PRINCIPAL) & (F.col("lang") == "en")).join(at).where("deleted_at is null or deleted_at > at").select("doc_id", "lang")


@query(f"WITH {CLAIMS_SQL} SELECT claim_id, revision, object FROM claims WHERE subject = 7 AND predicate = 'view' AND tx_from <= {MID_SQL} AND (tx_to IS NULL OR {MID_SQL} < tx_to)")
def get_record(spark, d):
    return at_mid(spark, d).where("subject = 7 and predicate = 'view' and tx_from <= mid and (tx_to is null or mid < tx_to)").select("claim_id", "revision", "object")


@query("SELECT event_id, props FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND user_id % 10 = 3")
def get_observation(spark, d):
    """Raw observations whose digest holds and that no tombstone covers."""
    e = table(spark, d, "events")
    stored = e.select("event_id", "props", "user_id", F.sha2("props", 256).alias("digest"))
    return stored.where((F.col("user_id") % 10 == 3) & (F.sha2("props", 256) == F.col("digest"))).join(e.where("event_type = 'error'").select("event_id"), "event_id", "left_anti").select("event_id", "props")


@query(f"WITH {CLAIMS_SQL} SELECT subject, predicate, revision, tx_from, CASE WHEN tx_to <= {MID_SQL} THEN tx_to END AS tx_to FROM claims c WHERE tx_from <= {MID_SQL} AND subject IN (SELECT subject FROM claims WHERE tx_to IS NULL AND family < 2)")
def history(spark, d):
    """All revisions up to the snapshot of the subjects whose present head still admits it; later ends are not told."""
    c = at_mid(spark, d)
    head = c.where("tx_to is null and family < 2").select("subject")
    return c.where("tx_from <= mid").join(head, "subject", "left_semi").select("subject", "predicate", "revision", "tx_from", F.when(F.expr("tx_to <= mid"), F.col("tx_to")).alias("tx_to"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT event_type) = 1 AS sound FROM events GROUP BY user_id")
def typed_history(spark, d):
    """A record's kind must never change: which identities hold one kind only."""
    n = F.count_distinct("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(n.alias("kinds"), (n == 1).alias("sound"))


@query("SELECT event_id, epoch_us(ts) AS at, event_type FROM events")
def journal_scan(spark, d):
    return table(spark, d, "events").select("event_id", micros("ts").alias("at"), "event_type").orderBy("event_id")


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS line FROM events""")
def logical_export(spark, d):
    return table(spark, d, "events").select("event_id", values.canonical(user_id="user_id", event_type="event_type", event_id="event_id").alias("line"))


@query("SELECT event_id, user_id, event_type FROM events")
def logical_import(spark, d):
    """The lines of the export, read by a schema that admits nothing else."""
    lines = table(spark, d, "events").select(values.canonical(user_id="user_id", event_type="event_type", event_id="event_id").alias("line"))
    return lines.select(F.from_json("line", "event_id long, user_id long, event_type string", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("""SELECT 'gap' AS rule, (SELECT max(event_id) - min(event_id) + 1 - count(*) FROM events) AS faults UNION ALL SELECT 'orphan', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 'digest', (SELECT count(*) FROM events WHERE props IS NULL)""")
def export_validation(spark, d):
    """Contiguous numbers, references that exist, contents that are there: faults by rule."""
    e, o, c = (table(spark, d, t) for t in ("events", "orders", "customer"))
    gap = e.agg((F.max("event_id") - F.min("event_id") + 1 - F.count("*")).alias("faults")).select(F.lit("gap").alias("rule"), "faults")
    orphan = o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").agg(F.count("*").alias("faults")).select(F.lit("orphan").alias("rule"), "faults")
    digest = e.agg(F.count_if(F.col("props").isNull()).alias("faults")).select(F.lit("digest").alias("rule"), "faults")
    return gap.unionByName(orphan).unionByName(digest)


@query("SELECT c_mktsegment AS space, count(*) AS subjects, min(c_custkey) AS first FROM customer GROUP BY 1")
def subjects_in_space(spark, d):
    spaces = table(spark, d, "customer").select("c_custkey", F.explode(F.array("c_mktsegment")).alias("space"))
    return spaces.groupBy("space").agg(F.count("*").alias("subjects"), F.min("c_custkey").alias("first"))


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id FROM docs WHERE list_contains(owners, 'o2')")
def spaces_owned_by(spark, d):
    return documents(spark, d).where(F.array_contains("owners", "o2")).select("doc_id")


@query("SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS number FROM (SELECT DISTINCT p_name FROM part)")
def id_mapping(spark, d):
    return scans.ids_to_numbers(table(spark, d, "part").select(F.col("p_name").alias("name")), "name")


@query("SELECT page_id, url, CASE WHEN strlen(html) >= 64 THEN upper(hex(encode(html)))[33:128] END AS part, sha256(html) AS digest FROM pages")
def original_byte_range(spark, d):
    raw = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select("page_id", "url", F.hex(scans.byte_range(raw, 16, 64)).alias("part"), F.sha2(raw, 256).alias("digest"))


@query("SELECT p.page_id, strlen(html) AS bytes, source FROM pages p JOIN documents ON doc_id = page_id")
def captured_originals(spark, d):
    return table(spark, d, "pages").join(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "source"), "page_id").select("page_id", F.octet_length("html").alias("bytes"), "source")


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ordinal FROM s)
    SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, sha256(doc_id || '/' || ordinal) AS section, strlen(line) AS bytes FROM u WHERE trim(line) <> ''""")
def document_sections(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    name = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("ordinal").cast("string")), 256)
    return each.where(F.trim("line") != "").select("doc_id", "ordinal", name.alias("section"), F.octet_length("line").alias("bytes"))


@query("""SELECT s_suppkey, 'M' AS status, s_name AS path, CAST(NULL AS VARCHAR) AS old_path FROM supplier UNION ALL SELECT s_suppkey, 'R100', s_name || '.new', s_name FROM supplier UNION ALL SELECT s_suppkey, 'D', s_name || '.old', NULL FROM supplier""")
def name_status(spark, d):
    nul = F.lit("\u0000")
    blob = F.concat(F.lit("M"), nul, "s_name", nul, F.lit("R100"), nul, "s_name", nul, F.concat("s_name", F.lit(".new")), nul, F.lit("D"), nul, F.concat("s_name", F.lit(".old")), nul)
    return table(spark, d, "supplier").select("s_suppkey", F.inline(scans.name_status(blob)))


@query("SELECT event_id, event_type || ' ' || props AS payload, CASE WHEN event_id % 7 = 0 THEN 'checksum' WHEN event_id % 11 = 0 THEN 'kind' END AS fault FROM events")
def record_envelopes(spark, d):
    """Records in envelopes, some spoilt, read back: payloads whose envelope holds, faults for the rest (their payload told beside)."""
    said = F.concat_ws(" ", "event_type", "props")
    e = table(spark, d, "events").select("event_id", said.alias("said"))
    records = scans.framed(e, "event_id", F.col("said"), "event")
    spoilt = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("record", r"\|[0-9]+\|([a-z])", "|1|$1")).when(F.col("event_id") % 11 == 0, F.regexp_replace("record", r"^QR\|event", "QR|other")).otherwise(F.col("record"))
    read = scans.unframed(records.withColumn("record", spoilt), "event_id", "event")
    return read.join(e, "event_id").select("event_id", F.coalesce("payload", "said").alias("payload"), "fault")


@query("SELECT event_id, user_id FROM events WHERE event_id <= (SELECT max(event_id) * 2 // 3 FROM events) AND event_type <> 'error'")
def backup_restore(spark, d):
    """The rows of a snapshot written, read again, and held against what is suppressed by now."""
    from ..sources.steps import settle

    e = table(spark, d, "events")
    dump = settle(e.join(F.broadcast(e.agg(F.expr("max(event_id) * 2 div 3").alias("mid")))).where("event_id <= mid").select("event_id", "user_id"), "backup")
    return dump.join(e.where("event_type = 'error'").select("event_id"), "event_id", "left_anti")


# Orders and limits.


@query("SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT (SELECT count(*) // 2 FROM embeddings)) WHERE label < 5 ORDER BY label, vec_id LIMIT 30")
def max_scored_cap(spark, d):
    """Exact scores over the first half of the ids only (the feature is the cap)."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    half = v.count() // 2
    return v.orderBy("vec_id").limit(half).where("label < 5").orderBy("label", "vec_id").limit(30)


@query(f"WITH {DOCUMENTS_SQL}, s AS (SELECT doc_id, round(len(list_intersect(['and', 'the', 'it'], list_distinct(string_split(lower(text), ' ')))) / 3.0 + CASE WHEN contains(lower(text), 'and the') THEN 1 ELSE 0 END, 9) AS score FROM docs WHERE {ALLOWED_SQL}) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def recall_page(spark, d):
    want = F.array(*map(F.lit, ("and", "the", "it")))
    score = F.round(F.size(F.array_intersect(want, F.split(F.lower("text"), " "))) / 3 + F.when(F.contains(F.lower("text"), F.lit("and the")), 1).otherwise(0), 9)
    hits = documents(spark, d).where(policy.allows(PRINCIPAL)).select("doc_id", score.alias("score")).where("score > 0")
    return hits.orderBy(F.desc("score"), "doc_id").offset(10).limit(10)


@query("SELECT event_id, spread FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS spread, strlen(props) AS n FROM events) ORDER BY coalesce(spread, 9223372036854775807), n, event_id LIMIT 200")
def indexed_rank_key(spark, d):
    spread = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 100)
    return table(spark, d, "events").select("event_id", spread.alias("spread"), F.octet_length("props").alias("n")).orderBy(F.asc_nulls_last("spread"), "n", "event_id").limit(200).select("event_id", "spread")


@query("SELECT user_id, event_type AS role, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, value DESC, event_id) AS place FROM events")
def membership_sort(spark, d):
    role = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(role, F.desc("value"), "event_id"))
    return table(spark, d, "events").select("user_id", F.col("event_type").alias("role"), "event_id", place.alias("place"))


@query("SELECT l_orderkey, l_linenumber AS best FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_discount DESC, l_quantity, l_linenumber) = 1")
def evidence_choice(spark, d):
    """One best piece for each: primary first, then trust, then few tokens; one aggregation, no sort of groups."""
    order = F.struct((F.col("l_returnflag") == "R").alias("p"), F.col("l_discount").alias("t"), (-F.col("l_quantity")).alias("c"), (-F.col("l_linenumber")).alias("i"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", order).alias("best"))


@query("SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) // 16 AS BIGINT) AS batch FROM orders WHERE o_orderstatus = 'O'")
def priority_batches(spark, d):
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", F.call_function("div", n, F.lit(16)).alias("batch"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def generation_page(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(50).limit(25)


# Sets.


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, len(list_filter(['src1', 'src2', 'src3'], lambda f: NOT list_contains(scopes, f))) AS missing, len(list_filter(scopes, lambda f: f NOT IN ('src1', 'src2', 'src3'))) = 0 AS covered FROM docs")
def facet_sets(spark, d):
    want = F.array(*map(F.lit, ("src1", "src2", "src3")))
    return documents(spark, d).select("doc_id", F.size(F.array_except(want, "scopes")).alias("missing"), (F.size(F.array_except("scopes", want)) == 0).alias("covered"))


@query("""WITH t AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS a, string_split(lower(p_type || ' ' || p_brand), ' ') AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(list_distinct(a), list_distinct(b))) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 9) AS jaccard FROM t""")
def jaccard(spark, d):
    of = lambda *c: F.array_distinct(F.split(F.lower(F.concat_ws(" ", *c)), " "))
    p = table(spark, d, "part").select("p_partkey", of("p_name", "p_type").alias("a"), of("p_type", "p_brand").alias("b"))
    return p.select("p_partkey", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 9).alias("jaccard"))


@query("SELECT o_orderkey, least(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + 10 END, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey + 7 END) AS until FROM orders")
def intersect_until(spark, d):
    i = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.least(F.when(i % 3 > 0, i + 10), F.when(i % 5 > 0, i + 7)).alias("until"))


@query(f"WITH {DOCUMENTS_SQL} SELECT a.doc_id, list_sort(a.scopes) = list_sort(b.scopes) AS same FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1")
def scope_equality(spark, d):
    docs = documents(spark, d).select("doc_id", F.array_sort("scopes").alias("s"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return docs.join(after, "doc_id").select("doc_id", (F.col("s") == F.col("t")).alias("same"))


@query(f"WITH RECURSIVE {EDGES_SQL}, up(node, above) AS (SELECT child, parent FROM edges UNION SELECT up.node, parent FROM up JOIN edges ON child = above) SELECT node, count(DISTINCT above) AS ancestors, min(above) AS first FROM up GROUP BY node")
def ancestor_sets(spark, d):
    """Ancestors by doubling: each round joins what is known with itself, so a chain of n takes log n rounds."""
    from ..operators import graph

    pairs = graph.closure(edges(spark, d).select(F.col("child").alias("node"), F.col("parent").alias("above")))
    return pairs.groupBy("node").agg(F.count("*").alias("ancestors"), F.min("above").alias("first"))


@query("SELECT DISTINCT claim FROM (SELECT event_id + 1 AS claim FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE event_type = 'error')")
def retired_union(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'click'").select((F.col("event_id") + 1).alias("claim")).unionByName(e.where("event_type = 'error'").select(F.col("event_id").alias("claim"))).distinct()


@query("SELECT user_id, max(seq) AS watermark FROM (SELECT user_id, event_id AS seq FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id + 3 FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id * 2 FROM events WHERE event_type = 'signup') GROUP BY user_id")
def watermark_union(spark, d):
    e = table(spark, d, "events")
    of = lambda kind, at: e.where(F.col("event_type") == kind).select("user_id", at.alias("at"))
    i = F.col("event_id")
    return of("view", i).unionByName(of("click", i + 3)).unionByName(of("signup", i * 2)).groupBy("user_id").agg(F.max("at").alias("watermark"))


@query("SELECT event_id, min(origin) AS origin FROM (SELECT event_id, 'journal' AS origin FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT event_id, 'service' FROM events WHERE event_id % 3 <> 0) GROUP BY event_id ORDER BY event_id DESC LIMIT 500")
def event_merge(spark, d):
    e = table(spark, d, "events").select("event_id")
    both = e.where("event_id % 3 <> 1").withColumn("origin", F.lit("journal")).unionByName(e.where("event_id % 3 <> 0").withColumn("origin", F.lit("service")))
    return both.groupBy("event_id").agg(F.min("origin").alias("origin")).orderBy(F.desc("event_id")).limit(500)


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'view'")
def work_dedupe(spark, d):
    return table(spark, d, "events").where("event_type <> 'view'").select("user_id", "event_type").distinct()


@query("SELECT DISTINCT n_nationkey AS artifact, 'c' || c_custkey AS part FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT n_nationkey, 'o' || o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 2")
def artifact_closure(spark, d):
    """An artifact's representations and what is stored for them, each once."""
    n, c, o = table(spark, d, "nation").where("n_regionkey = 2"), table(spark, d, "customer"), table(spark, d, "orders")
    reps = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_nationkey").alias("artifact"), "c_custkey")
    blobs = o.join(reps, o["o_custkey"] == reps["c_custkey"]).select("artifact", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("part"))
    return reps.select("artifact", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("part")).unionByName(blobs).distinct()


@query("SELECT l_orderkey, list_sort(list_distinct(list_concat(list(l_partkey), list(l_suppkey + 1000000)))) AS evidence FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 1")
def evidence_union(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set(F.col("l_suppkey") + 1_000_000).alias("b"))
    return g.select("l_orderkey", F.array_sort(F.array_union("a", "b")).alias("evidence")).where(F.size("evidence") >= 1)
