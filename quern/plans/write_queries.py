"""Queries over the write path: revisions from mutations, deletions, journals, receipts, projections, maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import policy, revisions, scans
from ..sources.tables import DOCUMENTS_SQL, documents, micros, table
from .registry import query

MUTATIONS_SQL = """mutations AS (SELECT event_id AS commit, 0 AS ordinal, CASE event_id % 6 WHEN 4 THEN 'correct' WHEN 5 THEN 'retract' ELSE 'put' END AS op, user_id AS id, user_id + 1000 AS successor, event_type AS value FROM events)"""
CHANGES_SQL = f"""{MUTATIONS_SQL}, changes AS (SELECT commit, ordinal, 0 AS part, id, CASE op WHEN 'put' THEN 'active' WHEN 'correct' THEN 'superseded' ELSE 'retracted' END AS lifecycle, CASE WHEN op = 'put' THEN value END AS value FROM mutations
    UNION ALL SELECT commit, ordinal, 1, successor, 'active', value FROM mutations WHERE op = 'correct')"""
REVISIONS_SQL = f"""{CHANGES_SQL}, revisions AS (SELECT id, CAST(row_number() OVER w AS INTEGER) AS revision, commit AS tx_from, lead(commit) OVER w AS tx_to, lifecycle, last_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY commit, ordinal, part ROWS UNBOUNDED PRECEDING) AS value
    FROM changes WINDOW w AS (PARTITION BY id ORDER BY commit, ordinal, part))"""


def mutations(spark, d):
    k = F.col("event_id") % 6
    return table(spark, d, "events").select(F.col("event_id").alias("commit"), F.lit(0).alias("ordinal"), F.when(k == 4, "correct").when(k == 5, "retract").otherwise("put").alias("op"), F.col("user_id").alias("id"), (F.col("user_id") + 1000).alias("successor"), F.col("event_type").alias("value"))


@query(f"WITH {REVISIONS_SQL} SELECT * FROM revisions")
def apply_mutations(spark, d):
    return revisions.fold(mutations(spark, d))


@query(f"WITH {REVISIONS_SQL} SELECT id, revision, value FROM revisions WHERE tx_to IS NULL AND lifecycle = 'active'")
def current_heads(spark, d):
    return revisions.fold(mutations(spark, d)).where("tx_to is null and lifecycle = 'active'").select("id", "revision", "value")


@query(f"WITH {REVISIONS_SQL} SELECT id, count(*) FILTER (lifecycle = 'superseded') AS corrected, count(*) FILTER (lifecycle = 'retracted') AS retracted, max(revision) AS revisions FROM revisions GROUP BY id")
def correct_and_forget(spark, d):
    r = revisions.fold(mutations(spark, d))
    return r.groupBy("id").agg(F.count_if(F.col("lifecycle") == "superseded").alias("corrected"), F.count_if(F.col("lifecycle") == "retracted").alias("retracted"), F.max("revision").alias("revisions"))


@query("SELECT event_id, CASE WHEN event_id = min(event_id) OVER w THEN 'applied' WHEN event_type = first_value(event_type) OVER (PARTITION BY user_id, event_id // 50 ORDER BY event_id) THEN 'replay' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_id // 50)")
def observe_idempotent(spark, d):
    """Observations with a key each: the first is written, others replay it or conflict."""
    e = table(spark, d, "events").withColumn("slot", F.expr("event_id div 50"))
    return revisions.receipts(e, ["user_id", "slot"], "event_id", "event_type").select("event_id", "outcome")


_DEPENDS_SQL = "links AS (SELECT event_id AS id, event_id - (event_id % 9 + 1) * 5 AS depends_on FROM events WHERE event_id % 3 > 0 AND event_id % 500 >= 110)"


def _depends(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").where("event_id % 3 > 0 and event_id % 500 >= 110").select(i.alias("id"), (i - (i % 9 + 1) * 5).alias("depends_on"))


@query(f"""WITH RECURSIVE {_DEPENDS_SQL}, w(id, root) AS (SELECT event_id, event_id FROM events WHERE event_id % 500 = 100 UNION SELECT l.id, w.root FROM w JOIN links l ON l.depends_on = w.id), m AS (SELECT id, min(root) AS root FROM w GROUP BY id)
    SELECT id, CASE WHEN id = root THEN 'requested' ELSE 'dependency_of:' || root END AS reason FROM m""")
def hard_delete(spark, d):
    targets = table(spark, d, "events").where("event_id % 500 = 100").select(F.col("event_id").alias("id"))
    return revisions.deletion_closure(_depends(spark, d), targets)


@query(f"""WITH RECURSIVE {_DEPENDS_SQL}, w(id) AS (SELECT event_id FROM events WHERE event_id % 500 = 100 UNION SELECT l.id FROM w JOIN links l ON l.depends_on = w.id) SELECT user_id, count(*) AS kept FROM events WHERE event_id NOT IN (SELECT id FROM w) GROUP BY user_id""")
def erased_reads(spark, d):
    """After a deletion no snapshot, past ones included, shows what its closure names."""
    e = table(spark, d, "events")
    gone = revisions.deletion_closure(_depends(spark, d), e.where("event_id % 500 = 100").select(F.col("event_id").alias("id")))
    return revisions.erase(e.withColumnRenamed("event_id", "id"), gone).groupBy("user_id").agg(F.count("*").alias("kept"))


@query(f"""WITH {REVISIONS_SQL} SELECT 'open_heads' AS rule, (SELECT count(*) FROM (SELECT id FROM revisions WHERE tx_to IS NULL GROUP BY id HAVING count(*) <> 1)) AS faults UNION ALL SELECT 'reversed', (SELECT count(*) FROM revisions WHERE tx_to <= tx_from) UNION ALL SELECT 'no_value', (SELECT count(*) FROM revisions WHERE value IS NULL)""")
def complete_state(spark, d):
    """What must hold for all revisions: one open head each, ends behind beginnings, a value."""
    r = revisions.fold(mutations(spark, d))
    heads = r.where("tx_to is null").groupBy("id").agg(F.count("*").alias("n")).where("n <> 1").agg(F.count("*").alias("faults")).select(F.lit("open_heads").alias("rule"), "faults")
    other = r.agg(F.count_if(F.expr("tx_to <= tx_from")).alias("reversed"), F.count_if(F.col("value").isNull()).alias("no_value"))
    return heads.unionByName(other.select(F.lit("reversed").alias("rule"), F.col("reversed").alias("faults"))).unionByName(other.select(F.lit("no_value").alias("rule"), F.col("no_value").alias("faults")))


@query("SELECT event_id, 0 AS part, 'frame' AS kind, sha256(props) AS body FROM events UNION ALL SELECT event_id, 1, 'index', event_type FROM events UNION ALL SELECT event_id, 2, 'receipt', 'r' || event_id FROM events")
def journal_accept(spark, d):
    """An accepted observation is a frame, an index row and a receipt, written together."""
    row = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    parts = F.array(row("frame", F.sha2("props", 256)), row("index", F.col("event_type")), row("receipt", F.concat(F.lit("r"), F.col("event_id").cast("string"))))
    return table(spark, d, "events").select("event_id", F.posexplode(parts).alias("part", "p")).select("event_id", "part", "p.*")


@query("SELECT event_id AS commit, event_type AS mutation, 'index:' || user_id AS work FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT event_id, event_type, 'vector:' || user_id FROM events WHERE event_type = 'purchase'")
def publish_outbox(spark, d):
    """A publication and the work that it leaves for others, one row for each."""
    name = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    work = F.array_compact(F.array(name("index:"), F.when(F.col("event_type") == "purchase", name("vector:"))))
    return table(spark, d, "events").where("event_type in ('purchase', 'signup')").select(F.col("event_id").alias("commit"), F.col("event_type").alias("mutation"), F.explode(work).alias("work"))


@query("SELECT user_id, count(*) AS replayed, max(event_id) AS head FROM events WHERE event_id <= (SELECT max(event_id) - 10 FROM events) GROUP BY user_id")
def replay_to_head(spark, d):
    """Replay up to the published head; the tail behind it is dropped."""
    e = table(spark, d, "events")
    kept = revisions.recover(e.join(F.broadcast(e.agg((F.max("event_id") - 10).alias("head")))), "event_id", F.col("head"))
    return kept.groupBy("user_id").agg(F.count("*").alias("replayed"), F.max("event_id").alias("head"))


@query("SELECT 'gap' AS rule, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS faults FROM events WHERE event_id % 97 <> 5 UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'digest', count(*) FROM events WHERE event_id % 97 <> 5 AND event_id % 101 = 3")
def verify_journal(spark, d):
    e = table(spark, d, "events").where("event_id % 97 <> 5").withColumn("stored", F.sha2(F.when(F.col("event_id") % 101 == 3, "spoilt").otherwise(F.col("props")), 256))
    return revisions.journal_faults(e, "event_id", F.sha2("props", 256), "stored")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS state, count(*) AS applied FROM events GROUP BY 1")
def project_publication(spark, d):
    """The journal projected onto one row an identity; the same journal gives the same rows however often it is read."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("applied"))


@query("SELECT conv_id, turn, 'candidate:' || left(sha256(conv_id || '/' || turn), 16) AS candidate, CASE WHEN turn > 0 THEN 'candidate:' || left(sha256(conv_id || '/' || (turn - 1)), 16) END AS parent FROM conversations")
def propose_candidates(spark, d):
    name = lambda t: F.concat(F.lit("candidate:"), F.left(F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string")), 256), F.lit(16)))
    return table(spark, d, "conversations").select("conv_id", "turn", name(F.col("turn")).alias("candidate"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unsupported' WHEN 1 THEN CASE WHEN len(list_filter(['recall'], lambda p: len(list_filter(grants, lambda g: g.audience = 'team' AND list_contains(g.purposes, p))) = 0)) > 0 THEN 'revised' ELSE 'unchanged' END WHEN 2 THEN 'suppressed' ELSE 'rejected' END AS outcome FROM docs""")
def control_intents(spark, d):
    """Publication to a shared audience revises an exact policy only; suppression always does; widening the audience is refused."""
    k = F.col("doc_id") % 4
    has = F.exists("grants", lambda g: (g["audience"] == "team") & F.array_contains(g["purposes"], "recall"))
    outcome = F.when(k == 0, "unsupported").when(k == 1, F.when(has, "unchanged").otherwise("revised")).when(k == 2, "suppressed").otherwise("rejected")
    return documents(spark, d).select("doc_id", outcome.alias("outcome"))


@query("SELECT count(*) AS rows, count(DISTINCT sha256(props)) AS digests, bool_and(props IS NOT NULL) AS sound FROM events")
def verify_deep(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("rows"), F.count_distinct(F.sha2("props", 256)).alias("digests"), F.every(F.col("props").isNotNull()).alias("sound"))


@query("SELECT user_id, count(*) AS n, sum(event_id) AS total FROM events GROUP BY user_id")
def compact(spark, d):
    """Compaction rewrites files and no rows: read back after the rewrite."""
    from ..sources.steps import settle

    e = table(spark, d, "events")
    again = settle(e.repartition("user_id").sortWithinPartitions("user_id", "event_id"), "compact")
    return again.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT user_id AS slot, min(event_id) AS first_commit, arg_max(event_type, event_id) AS version FROM events GROUP BY 1")
def state_catalog(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("slot")).agg(F.min("event_id").alias("first_commit"), F.max_by("event_type", "event_id").alias("version"))


@query("SELECT user_id || chr(0) || event_type AS slot, count(*) AS n FROM events WHERE user_id % 5 = 2 GROUP BY 1")
def scoped_state_keys(spark, d):
    return table(spark, d, "events").where("user_id % 5 = 2").groupBy(values.slot_key(F.col("user_id"), F.col("event_type")).alias("slot")).agg(F.count("*").alias("n"))


@query("SELECT 'assertion' AS row, event_id, event_type AS body FROM events WHERE event_type <> 'error' UNION ALL SELECT 'retraction', event_id, CAST(event_id - 1 AS VARCHAR) FROM events WHERE event_type = 'error' UNION ALL SELECT 'coverage', event_id, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 10 = 0")
def accepted_rows(spark, d):
    row = lambda kind, body: F.struct(F.lit(kind).alias("row"), body.cast("string").alias("body"))
    error = F.col("event_type") == "error"
    parts = F.array_compact(F.array(F.when(~error, row("assertion", F.col("event_type"))), F.when(error, row("retraction", F.col("event_id") - 1)), F.when(F.col("event_id") % 10 == 0, row("coverage", F.col("user_id")))))
    return table(spark, d, "events").select("event_id", F.explode(parts).alias("p")).select("p.row", "event_id", "p.body")


@query("WITH t AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: lower(t))) AS term FROM conversations) SELECT term, count(DISTINCT conv_id * 1000 + turn) AS documents, count(*) AS occurrences FROM t GROUP BY term")
def project_originals(spark, d):
    """Term postings of originals, and how many documents each term has."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    p = revisions.postings(rows, "doc", text.wordish("text"))
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


@query("SELECT event_id, r AS route FROM (SELECT event_id, unnest(['source:' || user_id, 'kind:' || event_type, 'day:' || epoch_us(ts) // 86400000000]) AS r FROM events)")
def document_rows(spark, d):
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    routes = F.array(name("source:", F.col("user_id")), name("kind:", F.col("event_type")), name("day:", F.call_function("div", micros("ts"), F.lit(86_400_000_000))))
    return table(spark, d, "events").select("event_id", F.explode(routes).alias("route"))


@query("SELECT user_id, max(event_id) AS epoch, count(*) AS revoked FROM events WHERE event_type = 'error' GROUP BY user_id")
def revoke_originals(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("epoch"), F.count("*").alias("revoked"))


@query("SELECT event_id // 2000 AS generation, least(count(*), 1024) AS reclaimed FROM events WHERE event_id // 2000 < (SELECT max(event_id) // 2000 FROM events) GROUP BY 1 ORDER BY 1 LIMIT 1")
def reclaim_generation(spark, d):
    """At most 1,024 rows of the oldest generation in a call (the feature); the active one is never touched."""
    e = table(spark, d, "events").withColumn("generation", F.expr("event_id div 2000"))
    top = F.broadcast(e.agg(F.max("generation").alias("top")))
    return e.join(top).where("generation < top").groupBy("generation").agg(F.least(F.count("*"), F.lit(1024)).alias("reclaimed")).orderBy("generation").limit(1)


@query(f"""WITH RECURSIVE {_DEPENDS_SQL}, w(id, src) AS (SELECT event_id, event_id FROM events UNION SELECT w.id, l.depends_on FROM w JOIN links l ON l.id = w.src)
    SELECT w.id, list_sort(list(DISTINCT e.event_type)) AS policies FROM w JOIN events e ON e.event_id = w.src GROUP BY w.id""")
def custody(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    links = _depends(spark, d).join(e.select(F.col("id").alias("depends_on")), "depends_on", "left_semi")
    return revisions.custody(e, links, "event_type")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def suppression_maintain(spark, d):
    deny = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(deny, "user_id", "left_anti").select("event_id")


@query(f"""WITH RECURSIVE {_DEPENDS_SQL}, w(id) AS (SELECT event_id FROM events WHERE event_id IN (100, 205) UNION SELECT l.id FROM w JOIN links l ON l.depends_on = w.id) SELECT event_type, count(*) AS affected FROM events WHERE event_id IN (SELECT id FROM w) GROUP BY 1""")
def deletion_inspect(spark, d):
    e = table(spark, d, "events")
    found = revisions.deletion_closure(_depends(spark, d), e.where("event_id in (100, 205)").select(F.col("event_id").alias("id")))
    return e.join(found.select(F.col("id").alias("event_id")), "event_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("affected"))


@query("SELECT user_id, event_id, CASE WHEN event_id % 100 = lag(event_id % 100, 1, 0) OVER w + 1 THEN 'published' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def checkpoint_publish(spark, d):
    """A run's head moves only if the writer names the revision that it found."""
    before = F.lag(F.col("event_id") % 100, 1, 0).over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 100 == before + 1, "published").otherwise("conflict").alias("outcome"))


@query("SELECT label, count(*) AS total, count(*) FILTER (vec_id % 3 = 0) AS done, CASE WHEN count(*) FILTER (vec_id % 3 = 0) = count(*) THEN 'complete' WHEN count(*) FILTER (vec_id % 3 = 0) = 0 THEN 'pending' ELSE 'running' END AS state FROM embeddings GROUP BY label")
def reembedding_job(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("vec_id") % 3 == 0).alias("done"))
    return g.withColumn("state", F.when(F.col("done") == F.col("total"), "complete").when(F.col("done") == 0, "pending").otherwise("running"))


@query("SELECT conv_id, turn, sha256(role || chr(0) || text) AS receipt, strlen(text) AS bytes FROM conversations")
def chat_capture(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("\u0000", "role", "text"), 256).alias("receipt"), F.octet_length("text").alias("bytes"))


@query("SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'blank' WHEN strlen(p_name) > 30 THEN 'long' WHEN p_size < 1 THEN 'size' END AS fault FROM part")
def snapshot_ingest(spark, d):
    fault = F.when(F.trim("p_name") == "", "blank").when(F.octet_length("p_name") > 30, "long").when(F.col("p_size") < 1, "size")
    return table(spark, d, "part").select("p_partkey", fault.alias("fault"))


@query("SELECT * FROM (VALUES (0, 'v1-v2'), (1, 'v2-v5')) t(step, reader)")
def plan_migration(spark, d):
    chain = {(1, 2): "v1-v2", (2, 3): "v2-v3", (3, 4): "v3-v4", (4, 5): "v4-v5", (2, 5): "v2-v5"}
    return spark.createDataFrame(list(enumerate(revisions.migrate(chain, 1, 5))), "step int, reader string")
