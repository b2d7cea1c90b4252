"""The write path: mutations folded into revisions, deletion closures, journals, receipts; each commit is a set of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import settle


def fold(mutations: DataFrame) -> DataFrame:
    """id, revision, tx_from, tx_to, lifecycle, value of mutations (commit, ordinal, op, id, successor, value).

    put opens a revision, correct closes its target as superseded and opens the successor's, retract closes one as retracted. Each change of an id is a
    revision; it ends where the next begins. A correct is two changes, so mutations are exploded first; no group is gathered.
    """
    change = lambda i, life, v: F.struct(i.alias("id"), F.lit(life).alias("lifecycle"), v.alias("value"))
    none = F.lit(None).cast("string")
    of = F.when(F.col("op") == "put", F.array(change(F.col("id"), "active", F.col("value")))).when(F.col("op") == "correct", F.array(change(F.col("id"), "superseded", none), change(F.col("successor"), "active", F.col("value")))).otherwise(F.array(change(F.col("id"), "retracted", none)))
    rows = mutations.select("commit", "ordinal", F.posexplode(of).alias("part", "c")).select("commit", "ordinal", "part", "c.*")
    w = Window.partitionBy("id").orderBy("commit", "ordinal", "part")
    # A closing revision keeps the value that the id had.
    kept = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", F.row_number().over(w).alias("revision"), F.col("commit").alias("tx_from"), F.lead("commit").over(w).alias("tx_to"), "lifecycle", kept.alias("value"))


def receipts(requests: DataFrame, key: list[str], order: str, digest: str) -> DataFrame:
    """`requests` with outcome: the first of a key is applied; later ones replay if their digest is the same, else conflict."""
    first = requests.groupBy(*key).agg(F.min_by(F.struct(F.col(order).alias("_at"), F.col(digest).alias("_digest")), order).alias("_f"))
    outcome = F.when(F.col(order) == F.col("_f._at"), "applied").when(F.col(digest) == F.col("_f._digest"), "replay").otherwise("conflict")
    return requests.join(first, key).withColumn("outcome", outcome).drop("_f")


def deletion_closure(links: DataFrame, targets: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, reason: a target (column id) and all that depends on it by links (id, depends_on), however far; each once, with the least target that reaches it."""
    found = settle(targets.select("id", F.col("id").alias("root")), "deleted")
    front = found
    for _ in range(rounds):
        more = links.join(front.select(F.col("id").alias("depends_on"), "root"), "depends_on").groupBy("id").agg(F.min("root").alias("root"))
        # A node goes on if it is new or its root fell.
        known = found.select("id", F.col("root").alias("_had"))
        front = settle(more.join(known, "id", "left").where("_had is null or root < _had").select("id", "root"), "deleted")
        if not front.limit(1).count():
            reason = F.when(F.col("id") == F.col("root"), "requested").otherwise(F.concat(F.lit("dependency_of:"), F.col("root").cast("string")))
            return found.select("id", reason.alias("reason"))
        found = settle(found.unionByName(front).groupBy("id").agg(F.min("root").alias("root")), "deleted")
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")


def erase(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """`records` without what tombstones name, in every snapshot: no commit is asked."""
    return records.join(tombstones.select("id"), "id", "left_anti")


def journal_faults(journal: DataFrame, seq: str, digest: Column, stored: str) -> DataFrame:
    """rule, faults: numbers that are missing or there twice, records whose digest isn't the stored one. One pass of aggregates, no sort."""
    counted = journal.agg((F.max(seq) - F.min(seq) + 1 - F.count_distinct(seq)).alias("gap"), (F.count("*") - F.count_distinct(seq)).alias("repeated"), F.count_if(digest != F.col(stored)).alias("digest"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("faults")) for r in ("gap", "repeated", "digest")))
    return counted.select(F.explode(rules).alias("r")).select("r.*")


def recover(journal: DataFrame, seq: str, head: Column | int) -> DataFrame:
    """The journal up to its published head: what was written behind it, and isn't published, goes."""
    return journal.where(F.col(seq) <= head)


def custody(events: DataFrame, links: DataFrame, policy: str) -> DataFrame:
    """id, policies: the policies of an event and of all that it is derived from (links: id, depends_on), in order; a read needs each of them."""
    from .graph import closure

    above = closure(links.select(F.col("id").alias("node"), F.col("depends_on").alias("above"))).select(F.col("node").alias("id"), F.col("above").alias("of"))
    of = above.unionByName(events.select("id", F.col("id").alias("of"))).distinct()
    return of.join(events.select(F.col("id").alias("of"), policy), "of").groupBy("id").agg(F.array_sort(F.collect_set(policy)).alias("policies"))


def postings(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """term, key, n: one row for each term of a row, with how often it has it."""
    return rows.select(key, F.explode(terms).alias("term")).groupBy("term", key).agg(F.count("*").alias("n"))


def migrate(chain: dict[tuple[int, int], str], start: int, goal: int) -> list[str]:
    """The shortest chain of readers from one version to another; an empty list if there is none to take, ValueError if none leads there."""
    paths, seen = [(start, [])], {start}
    while paths:
        at, names = paths.pop(0)
        if at == goal:
            return names
        for (a, b), name in sorted(chain.items()):
            if a == at and b not in seen:
                seen.add(b)
                paths.append((b, [*names, name]))
    raise ValueError(f"no readers lead from {start} to {goal}")
