"""Queries over events that the streaming machines take, here at rest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import policy
from ..sources.tables import DOCUMENTS_SQL, documents, micros, table
from ..streaming import frames
from .registry import ALLOWED_SQL, PRINCIPAL, query


@query("""WITH f AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations), g AS (SELECT *, min(CASE WHEN turn <> place THEN place END) OVER (PARTITION BY conv_id) AS broken FROM f)
    SELECT conv_id, turn AS position, CASE WHEN broken = 0 THEN 'no_manifest' WHEN broken IS NOT NULL AND place >= broken THEN 'skipped' WHEN place = total - 1 THEN 'complete' ELSE 'accepted' END AS outcome FROM g""")
def ingest_frames(spark, d):
    """Turns as frames: the first is the manifest, which names the total; a position that is skipped stops the rest."""
    t = table(spark, d, "conversations")
    total = F.count("*").over(Window.partitionBy("conv_id"))
    rows = t.select("conv_id", F.col("turn").alias("position"), F.sha2("text", 256).alias("digest"), total.alias("total"))
    return frames.fold(frames.Frames, rows, "conv_id", ["position", "digest", "total"], ["position"])


@query()
def circuit_breaker(spark, d):
    """Calls of each user: errors in a row open the breaker for a day."""
    result = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "neutral").otherwise("ok")
    rows = table(spark, d, "events").select("user_id", micros("ts").alias("at"), result.alias("result"), "event_id")
    return frames.fold(frames.Breaker, rows, "user_id", ["at", "result"], ["at", "event_id"])


@query("SELECT user_id, event_id, event_id AS low, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS kept FROM events WHERE false UNION ALL SELECT user_id, event_id, CASE WHEN n > 1000 THEN lag(event_id, 1000) OVER w + 1 ELSE 0 END, least(n, 1000) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def event_retention(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id")
    return frames.fold(frames.Ring, rows, "user_id", ["event_id"], ["event_id"]).withColumnRenamed("dropped_before", "low")


@query()
def work_scheduler(spark, d):
    priority = F.when(F.col("event_type") == "error", "urgent").when(F.col("event_type") == "view", "bulk").otherwise("normal")
    rows = table(spark, d, "events").select("user_id", F.concat(F.lit("w"), (F.col("event_id") % 97).cast("string")).alias("work"), F.col("event_type").alias("kind"), priority.alias("priority"), "event_id")
    return frames.fold(frames.Queue, rows, "user_id", ["work", "kind", "priority"], ["event_id"])


@query()
def lease_ticks(spark, d):
    rows = table(spark, d, "events").select("event_type", micros("ts").alias("at"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("holder"), "event_id")
    return frames.fold(frames.Lease, rows, "event_type", ["at", "holder"], ["at", "event_id"])


@query(f"WITH {DOCUMENTS_SQL}, ok AS (SELECT doc_id FROM docs WHERE {ALLOWED_SQL}) SELECT event_id, event_type FROM events WHERE user_id IN (SELECT doc_id FROM ok) AND event_id > (SELECT max(event_id) // 2 FROM events) ORDER BY event_id LIMIT 200")
def subscribe_page(spark, d):
    """The next events behind a cursor that the reader may see."""
    e = table(spark, d, "events")
    ok = documents(spark, d).where(policy.allows(PRINCIPAL)).select(F.col("doc_id").alias("user_id"))
    after = F.broadcast(e.agg(F.expr("max(event_id) div 2").alias("after")))
    return e.join(after).where("event_id > after").join(ok, "user_id", "left_semi").select("event_id", "event_type").orderBy("event_id").limit(200)


@query(f"WITH {DOCUMENTS_SQL}, ok AS (SELECT doc_id FROM docs WHERE {ALLOWED_SQL}), c AS (SELECT event_id // 10 AS commit, count(*) FILTER (user_id IN (SELECT doc_id FROM ok)) AS seen, max(event_id) AS mark FROM events GROUP BY 1) SELECT commit, seen, CASE WHEN seen > 0 THEN mark END AS watermark FROM c WHERE seen > 0")
def authorized_events(spark, d):
    """A commit tells its watermark only if the reader may see a change of it."""
    ok = documents(spark, d).where(policy.allows(PRINCIPAL)).select(F.col("doc_id").alias("user_id"), F.lit(1).alias("ok"))
    c = table(spark, d, "events").join(ok, "user_id", "left").groupBy(F.expr("event_id div 10").alias("commit")).agg(F.count("ok").alias("seen"), F.max("event_id").alias("watermark"))
    return c.where("seen > 0").select("commit", "seen", "watermark")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS asked, count(*) FILTER (event_type = 'purchase') AS answered, greatest(count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'purchase'), 0) AS pending FROM events GROUP BY user_id")
def pending_jobs(spark, d):
    asked, answered = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "purchase")
    return table(spark, d, "events").groupBy("user_id").agg(asked.alias("asked"), answered.alias("answered"), F.greatest(asked - answered, F.lit(0)).alias("pending"))


@query("SELECT user_id, event_id, CASE WHEN lead(event_type) OVER w = 'purchase' THEN 'done' ELSE 'unknown' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY event_type = 'view'")
def run_resume(spark, d):
    """A request whose result isn't the next event is unknown, and never sent again."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("after", after).where("event_type = 'view'").select("user_id", "event_id", F.when(F.col("after") == "purchase", "done").otherwise("unknown").alias("state"))


@query("SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS head, count(*) AS turns FROM conversations GROUP BY conv_id")
def chat_resume(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("head"), F.count("*").alias("turns"))


@query("SELECT user_id AS workspace, count(*) AS asked, least(count(*) FILTER (event_type = 'view'), 8) AS interactive, least(count(*) FILTER (event_type = 'click'), 4) AS bulk, least(count(*) FILTER (event_type = 'error'), 1) AS maintenance FROM events GROUP BY 1")
def admission_classes(spark, d):
    """How much of each class a workspace may run at once."""
    of = lambda kind, most: F.least(F.count_if(F.col("event_type") == kind), F.lit(most))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("workspace")).agg(F.count("*").alias("asked"), of("view", 8).alias("interactive"), of("click", 4).alias("bulk"), of("error", 1).alias("maintenance"))


@query("SELECT conv_id, turn, role || ': ' || text AS message FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def rehydrate(spark, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("p", place).where("p <= 4").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("message"))
