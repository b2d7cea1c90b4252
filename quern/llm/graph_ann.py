"""Operator 2: approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size by a hash. In each shard a directed graph is built: vectors come in
batches that grow with the graph, a greedy beam search from the medoid proposes neighbours, relaxed distance pruning
(a candidate goes if a chosen neighbour is closer to it, by the factor `alpha`, than the new vector is) keeps diverse edges, and
edges are also added backwards, pruned where a list is full. Queries run a beam search in every shard, in blocks, and the
shards' nearest are merged. Scores are exact distances in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship
from .vectors import matrix, usable

#: Distinct vectors in a shard at most (twice that, at worst, as hashes fall), and queries that a shard's task takes at once.
SHARD, BLOCK = 4096, 20_000


class Graph:
    """A robust-pruned graph over the rows of `x`."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        # Steps go in single precision, around the middle and at most 1 in size, so that neither large components nor an offset hurt.
        low, high = x.min(axis=0), x.max(axis=0)
        self.middle = low / 2 + high / 2
        self.scale = float(np.abs(x / 2 - self.middle / 2).max() * 2) or 1.0
        self.f = self._small(x)
        n = len(x)
        self.edges = np.full((n, degree), -1, dtype=np.int64)
        self.fill = np.zeros(n, dtype=np.int64)
        self.start = int(np.argmin(((self.f - self.f.mean(axis=0)) ** 2).sum(axis=1)))
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done, 256))]
            self._insert(batch)
            done += len(batch)

    def _small(self, q: np.ndarray) -> np.ndarray:
        return np.clip(q / self.scale - self.middle / self.scale, -1e9, 1e9).astype(np.float32)

    def search(self, q: np.ndarray, beam: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances in the beams of the queries, nearest first; -1 where there are fewer.

        All queries take a step at a time: each expands the nearest row of its beam that isn't expanded yet.
        """
        m, n = len(q), len(self.x)
        q = self._small(q)
        ids = np.full((m, beam), -1, dtype=np.int64)
        dist = np.full((m, beam), np.inf, dtype=np.float32)
        open_ = np.zeros((m, beam), dtype=bool)
        seen = np.zeros((m, n), dtype=bool)
        ids[:, 0], open_[:, 0] = self.start, True
        dist[:, 0] = ((q - self.f[self.start]) ** 2).sum(axis=1)
        seen[:, self.start] = True
        live = np.arange(m)
        while len(live):
            at = np.argmax(open_[live], axis=1)  # beams are sorted
            has = open_[live, at]
            live, at = live[has], at[has]
            if not len(live):
                break
            open_[live, at] = False
            near = self.edges[ids[live, at]]
            rows = np.broadcast_to(live[:, None], near.shape)
            new = (near >= 0) & ~seen[rows, near]
            seen[rows[new], near[new]] = True
            d = np.full(near.shape, np.inf, dtype=np.float32)
            diff = self.f[near[new]] - q[rows[new]]
            d[new] = np.einsum("ij,ij->i", diff, diff)
            all_d = np.concatenate([dist[live], d], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, near, -1)], axis=1), keep, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new], axis=1), keep, 1)
        return ids, dist

    def _prune(self, row: int, candidates: np.ndarray) -> np.ndarray:
        """The diverse ones of the candidates, nearest first."""
        c = np.unique(candidates[(candidates >= 0) & (candidates != row)])
        v = self.f[c]
        d = ((v - self.f[row]) ** 2).sum(axis=1)
        order = np.lexsort((c, d))
        c, v, d = c[order], v[order], d[order]
        norms = np.einsum("ij,ij->i", v, v)
        apart = norms[:, None] + norms[None, :] - 2 * (v @ v.T)
        alive, kept = np.ones(len(c), dtype=bool), []
        for i in range(len(c)):
            if alive[i]:
                kept.append(i)
                if len(kept) == self.degree:
                    break
                alive &= self.alpha**2 * apart[i] > d
        return c[kept]

    def _insert(self, batch: np.ndarray) -> None:
        found, _ = self.search(self.x[batch], self.beam)
        back: dict[int, list[int]] = {}
        for row, near in zip(batch, found):
            kept = self._prune(row, np.concatenate([near, self.edges[row]]))
            self.edges[row, : len(kept)], self.edges[row, len(kept) :], self.fill[row] = kept, -1, len(kept)
            for k in kept:
                back.setdefault(int(k), []).append(int(row))
        for k, rows in back.items():
            have = self.edges[k, : self.fill[k]]
            rows = [r for r in rows if r not in have]
            if len(have) + len(rows) > self.degree:
                kept = self._prune(k, np.concatenate([have, np.array(rows, dtype=np.int64)]))
            else:
                kept = np.concatenate([have, np.array(rows, dtype=np.int64)])
            self.edges[k, : len(kept)], self.edges[k, len(kept) :], self.fill[k] = kept, -1, len(kept)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from v in double precision, also where squares would overflow."""
    gap = x - v
    plain = np.sqrt((gap**2).sum(axis=1))
    if np.isfinite(plain).all():
        return plain
    most = np.abs(gap).max(axis=1, keepdims=True)
    return np.where(np.isfinite(plain), plain, most[:, 0] * np.sqrt(((gap / np.where(most > 0, most, 1)) ** 2).sum(axis=1)))


def nearest(rows: DataFrame, every: int = 100, k: int = 10, degree: int = 32, beam: int = 96, alpha: float = 1.2, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`.

    Nearness is the smallest Euclidean distance, ties go to the smaller vec_id, and a query isn't its own candidate. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id; vectors of
    another length than the query's aren't candidates. Of rows that repeat a vec_id each is a candidate (not for that id).
    Fewer candidates than k give fewer rows; an empty table gives none.

    Equal vectors are one vector of the graph; only the k + 1 smallest ids of each can be among anyone's k nearest.
    Queries are few (a fixed share of the rows) but grow with the table: they meet the shards in blocks of bounded size.
    """
    ship(rows.sparkSession)
    ready = usable(rows).where("vec_id is not null").drop("label").withColumn("key", F.xxhash64("vector"))
    # The engine keeps the first k + 1 rows of each vector already before the shuffle.
    rank = F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))
    few = ready.withColumn("i", rank).where(F.col("i") <= k + 1)
    distinct = few.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    queries = ready.where(F.col("vec_id") % every == 0).select("vec_id", "vector")
    n, m = (r.n for r in ready.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("m")).select(F.explode(F.array("n", "m")).alias("n")).collect())
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(m / BLOCK))
    # A shard's key holds the block of queries: with several blocks a graph is built for each, over BLOCK searches a small share.
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = distinct.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).withColumn("block", spread(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", spread(shards))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for size in sorted({len(v) for v in own["vector"]} & {len(v) for v in asked["vector"]}):
            o = own[own["vector"].map(len) == size].sort_values("key", kind="stable")
            a = asked[asked["vector"].map(len) == size]
            x, ids = matrix(o["vector"]), list(o["ids"])
            g = Graph(x, degree, beam, alpha)
            for i in range(0, len(a), 256):
                q, names = matrix(a["vector"].iloc[i : i + 256]), a["vec_id"].to_numpy()[i : i + 256]
                found, _ = g.search(q, beam)
                for v, name, near in zip(q, names, found):
                    near = near[near >= 0]
                    d = distances(x[near], v)
                    pairs = sorted((s, int(c)) for s, r in zip(d.tolist(), near) for c in ids[r] if c != name)[:k]
                    parts.append(pd.DataFrame({"query_id": name, "vec_id": [c for _, c in pairs], "score": [s for s, _ in pairs]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
