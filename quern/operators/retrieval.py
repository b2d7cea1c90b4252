"""Lexical scores, vector scores, rank fusion, budgets and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def overlap(text: Column | str, query: list[str]) -> Column:
    """The share of the distinct query tokens that the text has."""
    q = sorted(set(query))
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, q)))) / float(len(q))


def frequency(terms: Column | str, term: str) -> Column:
    """How often a term is in an array of terms."""
    return F.size(F.filter(terms, lambda x: x == term))


def tf_norm(docs: DataFrame, query: list[str]) -> DataFrame:
    """doc_id, score: term frequencies of the query's terms over the root of the document's length."""
    t = docs.select("doc_id", tokens("text").alias("t")).where(F.size("t") > 0)
    hits = sum((frequency("t", q) for q in query), F.lit(0))
    return t.select("doc_id", (hits / F.sqrt(F.size("t"))).alias("score")).where("score > 0")


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score over the given documents only: statistics are of what may be seen.

    One pass makes each document's length and frequencies; the corpus statistics are one row.
    """
    t = docs.select("doc_id", tokens("text").alias("t"))
    tf = [frequency("t", q).alias(f"tf{i}") for i, q in enumerate(query)]
    rows = t.select("doc_id", F.size("t").alias("n"), *tf)
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    parts = [F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean"))) for i in range(len(query))]
    return rows.join(F.broadcast(stats)).select("doc_id", sum(parts[1:], parts[0]).alias("score")).where("score > 0")


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fuse(routes: list[tuple[str, int, DataFrame]], limit: int) -> DataFrame:
    """Reciprocal-rank fusion in whole numbers: the sum of weight * 10**6 div (60 + rank) over the routes (id, score)."""
    ranked = []
    for name, weight, hits in routes:
        top = hits.orderBy(F.desc("score"), "id").limit(limit)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # of `limit` rows at most
        ranked.append(top.select("id", F.lit(name).alias("route"), F.expr(f"{weight * 1_000_000} div 1").alias("w"), rank.alias("rank")))
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    part = F.expr("w div (60 + rank)")
    return rows.groupBy("id").agg(F.sum(part).alias("rrf"), F.sort_array(F.collect_set("route")).alias("routes"))


def budget_prefix(rows: DataFrame, group: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while the running cost is within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def bm25_words(rows: DataFrame, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score: as bm25, over words of letters, digits and `_` of the text as it is lower-cased."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9_]+)"), 1)
    equals = lambda t: lambda x: x == t
    counted = rows.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n"), *(F.size(F.filter("w", equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    facts = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = sum((F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean"))) for i in range(len(terms))), F.lit(0.0))
    return counted.join(F.broadcast(facts)).select("doc_id", score.alias("score"))
