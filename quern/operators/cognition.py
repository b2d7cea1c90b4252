"""From proposals to decisions: entities found by scores and a margin, changes classified against what is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Scores that link without asking, that link where something is sensitive, and the least lead over the second.
AUTO, SENSITIVE, MARGIN = 0.9, 0.98, 0.03


def _near_names(mentions: DataFrame, records: DataFrame, least: float) -> DataFrame:
    """name, r_name: distinct names of both sides that share a word and at least the share `least` of their words; further pairs may come.

    Two such names share one of their rarest words, if each counts as many as can be without the share (a prefix filter). So a word that all
    names have joins nothing, unless names may have as little in common.
    """
    side = lambda df, own: df.select("name").where("name is not null").distinct().select(F.lit(own).alias("own"), "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    words = side(mentions, True).unionByName(side(records, False))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("many")), "word").groupBy("own", "name").agg(F.array_sort(F.collect_list(F.struct("many", "word"))).alias("words"))
    n = F.size("words")
    rare = ranked.select("own", "name", F.explode(F.slice("words", F.lit(1), n - F.greatest(F.ceil(n * least - 1e-9), F.lit(1)).cast("int") + 1)).alias("w")).select("own", "name", "w.word")
    return rare.where("own").select("word", "name").join(rare.where("not own").select("word", F.col("name").alias("r_name")), "word").select("name", "r_name").distinct()


def resolve(mentions: DataFrame, records: DataFrame, keep: float = 0.5) -> DataFrame:
    """mention, result (existing, ambiguous, new), node, score of mentions (mention, name, scope, sensitive) among records (node, name, scope, active, sensitive).

    Candidates share a word of the name; an equal name scores 0.7, else 0.35 times the overlap of words. The same scope, the type (asked before)
    and active context add 0.15, 0.1 and 0.05. Only the two best candidates of a mention count, and all that a score depends on is name, scope and
    active: so distinct names meet, and of records equal in these the two least nodes.
    """
    top = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("node"))).where("_r <= 2").drop("_r")
    of_scope = top(records.select("node", F.col("name").alias("r_name"), F.col("scope").alias("r_scope"), F.coalesce("active", F.lit(False)).alias("active"), F.col("sensitive").alias("r_sensitive")), "r_name", "r_scope", "active")
    # What no other score may lack of 0.35: the sum of the rest.
    pairs = _near_names(mentions, records, min(1.0, (keep - 0.3) / 0.35 - 1e-6))
    asked = mentions.select("name", "scope").distinct().join(pairs, "name")
    same = F.coalesce(F.col("scope") == F.col("r_scope"), F.lit(False))
    # A record of another scope comes after two of the same: so it is enough to ask the two least nodes of any scope.
    met = asked.join(of_scope.withColumn("scope", F.col("r_scope")), ["r_name", "scope"]).withColumn("same", F.lit(True))
    met = met.unionByName(asked.join(top(of_scope, "r_name", "active"), "r_name").where(~same).withColumn("same", F.lit(False)))
    a, b = F.split("name", " "), F.split("r_name", " ")
    overlap = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    score = F.when(F.col("name") == F.col("r_name"), 0.7).otherwise(0.35 * overlap) + F.when(F.col("same"), 0.15).otherwise(0.0) + 0.1 + F.when(F.col("active"), 0.05).otherwise(0.0)
    scored = met.withColumn("score", F.round(F.least(score, F.lit(1.0)), 9)).where(F.col("score") >= keep)
    two = scored.withColumn("_r", F.row_number().over(Window.partitionBy("name", "scope").orderBy(F.desc("score"), "node"))).where("_r <= 2")
    two = two.select(F.col("name").alias("m_name"), F.col("scope").alias("m_scope"), "node", "r_sensitive", "score")
    both = mentions.join(two, (F.col("name") == F.col("m_name")) & F.col("scope").eqNullSafe(F.col("m_scope")))
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "node")
    best = both.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("place = 1")
    enough = F.col("score") >= F.when(F.col("sensitive") | F.col("r_sensitive"), SENSITIVE).otherwise(AUTO)
    clear = F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 9) >= MARGIN)
    found = best.select("mention", F.when(enough & clear, "existing").otherwise("ambiguous").alias("result"), "node", "score")
    return mentions.select("mention").join(found, "mention", "left").withColumn("result", F.coalesce("result", F.lit("new")))


def classify(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """`proposals` (subject, predicate, object, valid_from, valid_to, scope, explicit, many) with compared and change, against the first current claim of the slot.

    New, scoped_coexistence, duplicate, temporal_transition, refinement, independent_evidence (the predicate takes many values) or contradiction.
    """
    first = current.groupBy("subject", "predicate").agg(F.min_by(F.struct("claim_id", F.col("object").alias("o"), F.col("valid_from").alias("vf"), F.col("valid_to").alias("vt"), F.col("scope").alias("s")), "claim_id").alias("c"))
    both = proposals.join(first, ["subject", "predicate"], "left")
    c = lambda name: F.col(f"c.{name}")
    meet = (c("vt").isNull() | (F.col("valid_from") < c("vt"))) & (F.col("valid_to").isNull() | (c("vf") < F.col("valid_to")))
    moved = F.col("explicit") & (F.col("valid_from") > c("vf")) & (c("o") != F.col("object"))
    change = F.when(F.col("c").isNull(), "new").when(c("s") != F.col("scope"), "scoped_coexistence").when((c("o") == F.col("object")) & meet, "duplicate").when(~meet | moved, "temporal_transition").when(text.is_refinement(c("o"), F.col("object")), "refinement").when(F.col("many"), "independent_evidence").otherwise("contradiction")
    return both.select(*proposals.columns, c("claim_id").alias("compared"), change.alias("change"))
