"""Operator 5: near-duplicates of vectors by spherical k-means cells and blocked cosine products.

Centres are fitted by spherical k-means on a bounded sample. A vector's home is the cell of the centre with the largest
cosine. A link may cross a border: u can have a partner in another cell only if u is no farther from the plane between the
two centres than the chord of the threshold, so u also visits each lower-numbered cell for which this holds, and no link is
lost. Within a cell (and label) rows are dealt to blocks of bounded size and pairs of blocks are multiplied; a task
returns each row's number of links and one edge to the least row of its local group, never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .components import components
from .vectors import matrix, sound, usable

#: Vectors that centres are fitted on, distinct vectors in a block, and in a cell on average.
SAMPLE, BLOCK, CELL = 20_000, 1024, 2048


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(u: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of spherical k-means."""
    cells = max(1, min(cells, len(u)))
    c = u[np.random.default_rng(5).choice(len(u), cells, replace=False)]
    for _ in range(rounds):
        home = np.argmax(u @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, u)
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def visits(u: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home?) for the home cell of each row and the lower cells that it may have a link to."""
    s = u @ c.T
    home = np.argmax(s, axis=1)
    apart = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0)) if len(c) <= 512 else None
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    gap = apart[home] if apart is not None else np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
    near = (s[np.arange(len(u)), home][:, None] - s) <= chord * gap
    near &= np.arange(len(c))[None, :] < home[:, None]
    row, cell = np.nonzero(near)
    return np.concatenate([np.arange(len(u)), row]), np.concatenate([home, cell]), np.concatenate([np.ones(len(u), bool), np.zeros(len(row), bool)])


def _block_links(p: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Partial link counts and local roots of the rows of a pair of blocks."""
    first, second = p["block"].to_numpy() == p["i"].to_numpy(), p["block"].to_numpy() == p["j"].to_numpy()
    u, home = matrix(p["u"]), p["home"].to_numpy()
    ids, many = p["id"].to_numpy(), p["many"].to_numpy()
    same = bool(first.all() and second.all())
    a = np.arange(len(p)) if same else np.nonzero(first)[0]
    b = a if same else np.nonzero(second)[0]
    links, parent = np.zeros(len(p), dtype=np.int64), np.arange(len(p))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(a), 256):
        r = a[at : at + 256]
        ok = (u[r] @ u[b].T) >= threshold
        ok &= home[r][:, None] | home[b][None, :]
        if same:
            ok &= r[:, None] != b[None, :]
        links[r] += ok @ many[b]
        if not same:
            links[b] += many[r] @ ok
        for k, i in enumerate(r):
            group = {root(j) for j in b[ok[k]]} | {root(i)}
            if len(group) > 1:
                least = min(group, key=lambda j: ids[j])
                for j in group:
                    parent[j] = least
    hit = np.nonzero(links)[0]
    return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[[root(i) for i in hit]] if len(hit) else ids[:0]})


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two rows link if their labels are equal and not null and their cosine, in double precision, is `threshold` or more.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, their own
    component, kept; so do vectors of another length than the most. component_id is the smallest vec_id reachable.
    A null vec_id stays (its component is null, kept false). Rows that repeat a vec_id with a vector link with each other.
    An empty table gives an empty result. Equal vectors are compared once; no cap is set on links.
    """
    ship(rows.sparkSession)
    ready = usable(rows).where("label is not null and vec_id is not null").withColumn("size", F.size("vector"))
    top = ready.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    ids = rows.select(F.col("vec_id").cast("long"))
    if not top:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    size, n = top[0].size, top[0].n
    ready = ready.where(F.col("size") == size)
    # Rows of one label and vector are a class; its smallest id stands for it.
    classes = cut(ready.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "classes")
    sample = classes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toPandas()
    per_label = max(1, math.ceil(n / CELL / max(1, classes.select("label").distinct().count())))
    centres = fit(unit(matrix(sample["vector"])), min(per_label, 1024))

    def deal(frames):
        for p in frames:
            if len(p):
                u = unit(matrix(p["vector"]))
                row, cell, home = visits(u, centres, threshold)
                q = p.iloc[row]
                yield pd.DataFrame({"label": q["label"].to_numpy(), "cell": cell, "home": home, "id": q["id"].to_numpy(), "many": q["many"].to_numpy(), "u": list(u[row])})

    dealt = cut(classes.mapInPandas(deal, "label long, cell int, home boolean, id long, many long, u array<double>"), "cells")
    sizes = dealt.groupBy("label", "cell").agg(F.count("*").alias("n")).select("label", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocked = dealt.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = blocked.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    found = cut(paired.groupBy("label", "cell", "i", "j").applyInPandas(lambda p: _block_links(p, threshold), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    known = classes.select("id", "label", "vector", "many").join(links, "id", "left").join(grouped.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = ready.select("vec_id", "label", "vector").join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    takes_part = F.coalesce(sound("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") == size), F.lit(False))
    rest = rows.where(~takes_part).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

