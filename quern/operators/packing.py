"""Context packs: mandatory blocks and facets, a greedy order by value for its cost, minimal evidence, budgets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a request that a pack is made from at most; what a request offers beyond goes to its continuation.
CANDIDATES = 512


def offered(blocks: DataFrame, request: str, most: int = CANDIDATES) -> DataFrame:
    """The blocks (id, utility, tokens) of each request that a pack is made from: the most useful for their cost, so that a request's group is bounded."""
    density = F.col("utility") / F.greatest("tokens", F.lit(1))
    return blocks.withColumn("_r", F.row_number().over(Window.partitionBy(request).orderBy(F.desc(density), "id"))).where(F.col("_r") <= most).drop("_r")


def greedy(blocks: pd.DataFrame) -> list[int]:
    """Rows in the order in which they are taken: each time the greatest value for its tokens, ties to the smaller id.

    Value is utility times 2n + 1 for n facets that nothing taken before has (1 where there are none).
    """
    left, covered, order = list(range(len(blocks))), set(), []
    utility, cost, ids = ([int(v) for v in blocks["utility"]], [max(int(v), 1) for v in blocks["tokens"]], list(blocks["id"]))
    facets = [set(f) for f in blocks["facets"]]
    while left:
        value = {i: utility[i] * (2 * n + 1 if (n := len(facets[i] - covered)) else 1) for i in left}
        best = left[0]
        for i in left[1:]:
            a, b = value[i] * cost[best], value[best] * cost[i]
            if a > b or (a == b and ids[i] < ids[best]):
                best = i
        left.remove(best)
        covered |= facets[best]
        order.append(best)
    return order


def pack(blocks: DataFrame, request: str, budget: int) -> DataFrame:
    """request, id, place, used: mandatory blocks first, then by the greedy order, those that still fit into the tokens (smaller ones behind may fill up)."""
    kind = dict(blocks.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        order = [i for m in (True, False) for i in _ordered(group, m)]
        rows, used = [], 0
        for i in order:
            cost = int(group["tokens"][i])
            if used + cost <= budget:
                used += cost
                rows.append((group[request][i], group["id"][i], len(rows) + 1, used))
        return pd.DataFrame(rows, columns=[request, "id", "place", "used"])

    return offered(blocks, request).groupBy(request).applyInPandas(run, f"{request} {kind[request]}, id {kind['id']}, place long, used long")


def _ordered(group: pd.DataFrame, mandatory: bool) -> list[int]:
    part = group[group["mandatory"] == mandatory]
    return [part.index[i] for i in greedy(part)]


def minimal_evidence(evidence: pd.DataFrame, claims: list, primary: bool = False) -> list:
    """Ids of the pieces that cover all claims: each time primary ones first, then most uncovered claims, trust, few tokens, the smaller id. None if they can't."""
    return _least([(bool(r.primary), set(r.claims), int(r.trust), max(int(r.tokens), 1), r.id) for r in evidence.itertuples()], set(claims), primary)


def _least(rows: list[tuple], left: set, primary: bool) -> list:
    """minimal_evidence of rows (primary, set of claims, trust, tokens, id)."""
    taken = []
    while left:
        best = order = None
        for p, c, t, n, i in rows:
            if (gain := len(c & left)) and i not in taken:
                o = (p, gain, t, -n)
                if best is None or o > order or (o == order and i < best[0]):
                    best, order = (i, c), o
        if best is None:
            return []
        taken.append(best[0])
        left = left - best[1]
    if primary and not any(p for p, _, _, _, i in rows if i in taken):
        more = None
        for p, _, t, _, i in rows:
            if p and i not in taken and (more is None or t > more[0] or (t == more[0] and i < more[1])):
                more = (t, i)
        if more is None:
            return []
        taken.append(more[1])
    return sorted(taken)


def _values(a: pa.Array) -> list:
    """What to_pylist gives; numbers and lists of numbers without nulls faster."""
    if a.null_count == 0 and pa.types.is_list(a.type):
        flat, at = _values(a.values), a.offsets.to_numpy().tolist()
        return [flat[i:j] for i, j in pairwise(at)]
    plain = a.null_count == 0 and (pa.types.is_integer(a.type) or pa.types.is_boolean(a.type))
    return a.to_numpy(zero_copy_only=False).tolist() if plain else a.to_pylist()


def cover(evidence: DataFrame, block: str, primary: bool = False) -> DataFrame:
    """block, ids: the minimal evidence of each block (rows block, id, claims, primary, trust, tokens), null if its claims can't be covered.

    Blocks are many and small: they are read in order from one stream a partition, as a call for each would cost more than its rows.
    """
    kind = dict(evidence.dtypes)
    schema = f"{block} {kind[block]}, ids array<{kind['id']}>"
    columns = [block, "primary", "claims", "trust", "tokens", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, types = None, [], None
        ids = lambda: _least(rows, set().union(*(r[1] for r in rows)), primary) or None
        made = lambda done: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), types, strict=True)], names=[block, "ids"])
        for batch in batches:
            types, done = (batch.schema.field(block).type, pa.list_(batch.schema.field("id").type)), []
            for at, p, claims, trust, tokens, i in zip(*(_values(batch.column(c)) for c in columns), strict=True):
                if rows and at != own:
                    done.append((own, ids()))
                    rows = []
                own = at
                rows.append((bool(p), set(claims), int(trust), max(int(tokens), 1), i))
            if done:
                yield made(done)
        if rows:
            yield made([(own, ids())])

    return evidence.select(*columns).repartition(block).sortWithinPartitions(block).mapInArrow(run, schema)


def fit(rows: DataFrame, group: list[str], order: list, limits: dict[str, int]) -> DataFrame:
    """Rows of each group, in order, while the running sums of all columns in `limits` stay within them."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = F.lit(False)
    for column, most in limits.items():
        over = over | (F.sum(column).over(w) > most)
    first = F.min(F.when(F.col("_over"), F.col("_at"))).over(Window.partitionBy(*group))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("_over", over)
    return numbered.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop"))).drop("_at", "_over", "_stop")


def findings(source: dict[str, Column], target: dict[str, Column]) -> Column:
    """What a move to another model breaks, as (finding, gravity): a smaller context blocks, another tokenizer or embedding warns, other differences inform."""
    said = lambda when, name, gravity: F.when(when, F.struct(F.lit(name).alias("finding"), F.lit(gravity).alias("gravity")))
    return F.array_compact(F.array(
        said(target["context"] < source["context"], "context", "blocking"), said(target["schema"] < source["schema"], "schema", "blocking"), said(target["tokenizer"] != source["tokenizer"], "tokenizer", "warning"),
        said(target["embedding"] != source["embedding"], "embedding", "warning"), said(target["format"] != source["format"], "format", "informational"),
    ))
