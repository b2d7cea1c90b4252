"""Operator 6: near-duplicate documents by DartMinHash signatures and a banded join.

A document is a weighted set: its word shingles with their counts. Over each unit of an element's weight, hashed darts arrive at
hashed ranks, as a Poisson process; the same unit gets the same darts in every document. A dart falls on one of the
signature's coordinates, and a coordinate keeps its earliest dart. Only darts below a rank that falls with the set's weight are
made, a few for each coordinate whatever the set's size; a document with an empty coordinate throws again, farther.
Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents with the same words are one class. Classes that agree in a band are candidates (see linking), unless their parities
say that they differ in too many shingles (no similar pair is lost by that); pairs are verified on whole texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, cut, scratch, small_side, text_batches
from .linking import linked, shared_members
from .shingles import mix, shingles, similarity

#: Bands, coordinates in a band; longs of a document's parities: a bit says whether the shingles of its number are odd in count.
BANDS, ROWS, PARITIES = 20, 4, 16
_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs, size) of the weighted sets (doc, element, weight > 0); rows of documents without elements are 0."""
    out = np.zeros((docs, size), np.uint64)
    total = np.bincount(doc, weight, docs)
    todo, reach = total > 0, size * (math.log(size) + 3.0)
    while todo.any():
        own = todo[doc]
        d, e, w = doc[own], element[own], weight[own]
        units = np.ceil(w).astype(np.int64)
        row = np.repeat(np.arange(len(d)), units)
        level = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)
        seed = mix(e[row] + mix(level.astype(np.uint64) + _U(1)))
        limit = (reach / total)[d[row]]
        room = w[row] - level  # of the unit, 1 but for a last part
        cells, ranks, darts = [], [], []
        rank, live, step = np.zeros(len(row)), np.arange(len(row)), 0
        while len(live):
            step += 1
            draw = mix(seed[live] + _U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank[live] -= np.log(_uniform(draw))
            live, draw = (ok := rank[live] < limit[live], live[ok], draw[ok])[1:]
            dart = mix(draw ^ _U(0xD1B54A32D192ED03))
            fits = _uniform(mix(dart + _U(7))) < room[live]
            at, dart = live[fits], dart[fits]
            cells.append(d[row[at]] * size + (dart % _U(size)).astype(np.int64))
            ranks.append(rank[at])
            darts.append(dart)
        cell, dart = np.concatenate(cells), np.concatenate(darts)
        order = np.lexsort((np.concatenate(ranks), cell))
        cell, dart = cell[order], dart[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        found = np.bincount(cell[first] // size, minlength=docs) == size
        full = found[cell // size] & first if len(cell) else first
        out.reshape(-1)[cell[full]] = dart[full]
        todo &= ~found
        reach *= 2
    return out


def banded(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key (docs, bands) for each band; the band's number is part of it."""
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :bands])
    return key.view(np.int64)


def _sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, words (a hash of the sequence of words; null if there is none), size (number of shingles), bands, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1_000_000):
            texts = b.column(2).to_pylist()
            doc, element, count, w, many = shingles(texts)
            keys = banded(signatures(doc, element, count.astype(np.float64), len(texts), bands * rows), bands, rows)
            bit = (mix(element + _U(11)) % _U(64 * PARITIES)).astype(np.int64)
            odd = np.bincount(doc * (64 * PARITIES) + bit, count, len(texts) * 64 * PARITIES).astype(np.int64) & 1
            parities = np.packbits(odd.astype(np.uint8).reshape(len(texts), -1), axis=1, bitorder="little").view(np.int64)
            ends = np.cumsum(many)
            same = [hashlib.blake2b(w[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, many)]
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1)))
            total = np.bincount(doc, count, len(texts)).astype(np.int64)
            columns = [b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(total), lists(keys), lists(parities)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "words", "size", "bands", "parities"])

    bounded_arrow(docs.sparkSession)
    of = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))
    return of.mapInArrow(run, "doc_id long, text_hash long, words binary, size long, bands array<long>, parities array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts are as similar as asked."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    first = cut(classes.join(ids, "id", "left_semi").select("id", "first.*"), "ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts = cut(own.join(small_side(first), ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "text"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2_000_000):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            known = {**dict(zip(a, ta)), **dict(zip(b, tb))}
            place = {k: i for i, k in enumerate(known)}
            doc, element, count, _, _ = shingles(list(known.values()))
            edge = np.searchsorted(doc, np.arange(len(known) + 1))
            part = lambda k: (element[edge[i := place[k]] : edge[i + 1]], count[edge[i] : edge[i + 1]])
            ok = [(x, y) for x, y in zip(a, b) if similarity(part(x), part(y)) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ok], pa.int64()), pa.array([y for _, y in ok], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _may(threshold: float):
    """Whether two classes can be as similar as asked: by their sizes, and by the parities that differ, each for a shingle at least that one has more often."""

    def may(x, y) -> Column:
        apart = reduce(add, (F.bit_count(F.get(x("parities"), F.lit(i)).bitwiseXOR(F.get(y("parities"), F.lit(i)))) for i in range(PARITIES)))
        return (F.least(x("size"), y("size")) >= threshold * F.greatest(x("size"), y("size"))) & (apart <= (x("size") + y("size")) * ((1 - threshold) / (1 + threshold)) + 1e-6)

    return may


@scratch
def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, component_id, kept for every row: connected groups of documents whose shingles are similar.

    Two documents link at a weighted Jaccard similarity of `threshold` or more of their counted shingles of five words
    (at 0.8 a link is a candidate with probability 0.99997). component_id is the smallest doc_id reachable; kept says that
    it is the document's own. Null texts, and texts without words, link with nothing and are kept. Rows with a null
    doc_id have a null component and are kept. Of rows that repeat a doc_id each goes by its own text.
    Texts of any length count whole; an empty table gives an empty result; further columns are ignored.
    """
    signed = cut(_sign(docs, bands, rows), "signed")
    has = signed.where("doc_id is not null and words is not null")
    # A class is named by half of its hash, so that a repeated doc_id isn't one class.
    node = F.conv(F.substring(F.hex("words"), 2, 15), 16, 10).cast("long")
    classes = cut(has.groupBy(node.alias("id"), "words").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("size").alias("size"), F.any_value("parities").alias("parities"), F.any_value("bands").alias("bands")), "classes")
    members = shared_members(classes.select(F.explode("bands").alias("bucket"), "id"))
    grouped = linked(members, classes.select("id", "size", "parities"), lambda pairs: _verified(pairs, classes, docs, threshold), _may(threshold))
    of = cut(classes.join(grouped.withColumnRenamed("node", "id"), "id").select("words", "component", "first.doc_id"), "grouped")
    least = of.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = of.join(least, "component").select("words", F.col("least").alias("component_id"))
    single = classes.join(named, "words", "left").select("words", F.coalesce("component_id", "first.doc_id").alias("component_id"))
    out = signed.select("doc_id", "words").join(single, "words", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
