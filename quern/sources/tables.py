"""Domain tables derived from the Parquet fixtures: policy-carrying documents, claim revisions, graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _grants() -> Column:
    """No grants for every fourth document (its audience and purposes hold); else purposes by audience."""
    grant = lambda audience, *purposes: F.struct(audience.alias("audience"), F.array(*map(F.lit, purposes)).alias("purposes"))
    i = F.col("doc_id") % 4
    none = F.array().cast("array<struct<audience:string,purposes:array<string>>>")
    return F.when(i == 0, none).when(i == 1, F.array(grant(F.col("lang"), "recall", "export"))).when(i == 2, F.array(grant(F.lit("*"), "audit"), grant(F.lit("@owner"), "export"))).otherwise(F.array(grant(F.lit("team"), "export", "*"), grant(F.col("lang"), "recall")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a policy each: workspace, consent, retrievable, sensitivity, scopes, compartments, owners, audience, purposes, grants (audience, purposes), deleted_at."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id", "text", "lang", "source", (F.col("doc_id") % 3).alias("workspace"), (F.col("doc_id") % 7 != 0).alias("consent"), (F.col("doc_id") % 11 != 0).alias("retrievable"),
        (F.coalesce("toxic", F.lit(0)) * 2 + F.col("doc_id") % 2).cast("int").alias("sensitivity"), F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("scopes"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("*"))).otherwise(F.array("lang")).alias("audience"), F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("recall"), F.when(F.col("doc_id") % 4 == 0, "audit").otherwise("export"))).alias("purposes"),
        F.when(F.col("doc_id") % 17 == 0, F.array(F.lit("en"))).otherwise(F.array(F.concat(F.lit("o"), (F.col("doc_id") % 5).cast("string")))).alias("owners"), F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("src1"))).otherwise(F.array().cast("array<string>")).alias("compartments"), _grants().alias("grants"),
        (F.coalesce("quality", F.lit(0)) * 500_000 + 250_000).cast("long").alias("trust"), F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 50).alias("deleted_at"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of slots (subject, predicate): object, commit, tx interval, valid interval; negative ones retract."""
    slot = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("claim_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.pmod(F.floor("value"), F.lit(5)).cast("int").alias("object"),
        F.row_number().over(slot).alias("revision"), F.col("event_id").alias("tx_from"), F.lead("event_id").over(slot).alias("tx_to"), micros("ts").alias("valid_from"), micros(F.lead("ts").over(slot)).alias("valid_to"),
        (F.col("event_id") % 9 == 0).alias("negative"), (F.col("event_id") % 4).alias("family"), (F.pmod(F.floor(F.col("value") * 1000), F.lit(900_000)) + 50_000).cast("long").alias("confidence"),
    )


CLAIMS_SQL = """claims AS (
    SELECT event_id AS claim_id, user_id AS subject, event_type AS predicate, CAST(((CAST(floor(value) AS BIGINT) % 5) + 5) % 5 AS INTEGER) AS object,
           CAST(row_number() OVER w AS INTEGER) AS revision, event_id AS tx_from, lead(event_id) OVER w AS tx_to, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER w) AS valid_to,
           event_id % 9 = 0 AS negative, event_id % 4 AS family, CAST(((CAST(floor(value * 1000) AS BIGINT) % 900000) + 900000) % 900000 + 50000 AS BIGINT) AS confidence
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""
DOCUMENTS_SQL = """docs AS (
    SELECT d.doc_id, text, lang, source, d.doc_id % 3 AS workspace, d.doc_id % 7 <> 0 AS consent, d.doc_id % 11 <> 0 AS retrievable, coalesce(toxic, 0) * 2 + d.doc_id % 2 AS sensitivity,
           CASE WHEN d.doc_id % 5 = 0 THEN [] ELSE [source] END AS scopes, CASE WHEN d.doc_id % 2 = 0 THEN ['*'] ELSE [lang] END AS audience,
           CASE WHEN d.doc_id % 6 = 0 THEN [] ELSE ['recall', CASE WHEN d.doc_id % 4 = 0 THEN 'audit' ELSE 'export' END] END AS purposes,
           CASE WHEN d.doc_id % 17 = 0 THEN ['en'] ELSE ['o' || d.doc_id % 5] END AS owners, CASE WHEN d.doc_id % 9 = 0 THEN ['src1'] ELSE [] END AS compartments,
           CASE d.doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [{'audience': lang, 'purposes': ['recall', 'export']}] WHEN 2 THEN [{'audience': '*', 'purposes': ['audit']}, {'audience': '@owner', 'purposes': ['export']}]
               ELSE [{'audience': 'team', 'purposes': ['export', '*']}, {'audience': lang, 'purposes': ['recall']}] END AS grants, coalesce(quality, 0) * 500000 + 250000 AS trust, CASE WHEN d.doc_id % 13 = 0 THEN d.doc_id + 50 END AS deleted_at
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and child keys of region > nation > customer and supplier, as strings."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    parts = [n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child")), c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child")), s.select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EDGES_SQL = """edges AS (
    SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL
    SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""
