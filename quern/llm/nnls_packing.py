"""Operator 8: packing of documents into windows by non-negative least squares over length combinations.

Tokens are counted once, in one pass over the texts; only pieces (document, start, length, checksum) go on. The histogram of
piece lengths has at most as many entries as a window has tokens, whatever the corpus, and the plan is made from it on the
driver: lengths are rounded up to units; combinations of up to four lengths that fill a window are enumerated; repeat
counts are solved by non-negative least squares against the histogram, rounded down, and made exact lengths again. What
is left is packed greedily, longest first, into the smallest gap that takes it, gaps of the planned windows included. The
plan says where the i-th piece of each length goes; pieces get their number in parallel and look their place up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_arrow, cut, text_batches
from .word_bpe import KEEP_WORDS, LONG, WORD_END, Splitter

WINDOW, END, UNITS, DEPTH = 4096, 2, 64, 4
#: Parts in which the pieces of one length are numbered.
PARTS = 64


class Ids:
    """Token ids of whole texts as little-endian 32-bit numbers, by the tokenizers library, each new word once."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.tok = self.split.tok
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.marks = {str(t.content)[:2] for t in self.tok.get_added_tokens_decoder().values()}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stop = np.nonzero(self.ends[ids])[0] + 1
            if len(stop) == len(some):
                data, at = ids.tobytes(), 0
                for w, e in zip(some, (stop * 4).tolist()):
                    self.words[w] = data[at:e]
                    at = e
            else:
                self.words.update((w, self._whole(w)) for w in some)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty. Words of this batch are known until it ends, long ones no longer."""
        find = self.split.words
        parts = [None if t is None or any(m in t for m in self.marks) else find(t) for t in texts]
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        known = self.words
        new = list({w for ws in parts if ws for w in ws if w not in known})
        self._learn(new)
        of = known.__getitem__
        out = [self._whole(t or "") if ws is None else b"".join(map(of, ws)) for t, ws in zip(texts, parts)]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One for each file and worker process."""
    return Ids(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids, with the end id, cut at multiples of the window."""
    tail = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for b in text_batches(batches, 1_000_000):
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), ids.encode(b.column(1).to_pylist())):
                data += tail
                n = len(data) // 4
                rows += [(doc_id, s, min(window, n - s), zlib.crc32(data[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    bounded_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 that brings a @ x nearest to b, by the active-set method."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        passive[j] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 0)
            if not low.any():
                break
            step = min(x[i] / (x[i] - s[i]) if x[i] > s[i] else 0.0 for i in np.nonzero(low)[0])
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
    return x


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All descending combinations of at most `depth` lengths, in units, that fill a window."""

    def extend(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for p in range(min(left, most), 0, -1):
                if p * parts < left:
                    break
                for rest in extend(left - p, p, parts - 1):
                    yield (p, *rest)

    return list(extend(units, units, depth))


def plan(histogram: dict[int, int], window: int = WINDOW, units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of windows, [(length, pieces of it in each window), ...]) that use every piece of the histogram once."""
    unit = window // units
    queues = defaultdict(list)  # by unit: [length, number], shortest last
    for length in sorted(histogram, reverse=True):
        if histogram[length]:
            queues[-(-length // unit)].append([length, histogram[length]])
    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for k, c in enumerate(combos):
        for p in c:
            a[p - 1, k] += 1
    b = np.array([sum(n for _, n in queues[u + 1]) for u in range(units)], float)
    # A missing piece can't be used, one left over can: rows weigh by the root of their share.
    scale = 1 / np.sqrt(np.maximum(b, 1))
    repeats = np.floor(nnls(a * scale[:, None], b * scale) + 1e-6).astype(np.int64)
    windows: list[list] = []  # [number, {length: pieces}, gap]
    for k in np.argsort(-repeats, kind="stable"):
        left = int(repeats[k])
        while left > 0:
            use = defaultdict(int)
            heads = []
            for p in combos[k]:
                at = next((e for e in reversed(queues[p]) if e[1] > sum(h is e for h in heads)), None)
                if at is None:
                    break
                heads.append(at)
            if len(heads) < len(combos[k]):
                break
            n = min(left, *(e[1] // sum(h is e for h in heads) for e in heads))
            for e in heads:
                use[e[0]] += 1
                e[1] -= n
            for p in set(combos[k]):
                queues[p] = [e for e in queues[p] if e[1]]
            windows.append([n, dict(use), window - sum(x * m for x, m in use.items())])
            left -= n
    by_gap = defaultdict(list)
    for w in windows:
        by_gap[w[2]].append(w)
    rest = sorted((e for q in queues.values() for e in q), reverse=True)
    for length, number in rest:
        while number:
            gap = next((g for g in range(length, window + 1) if by_gap.get(g)), None)
            w = by_gap[gap].pop() if gap is not None else [number, {}, window]
            each = min(w[2] // length, number)
            n = min(w[0], number // each)
            if n < w[0] and gap is not None:
                by_gap[gap].append([w[0] - n, dict(w[1]), w[2]])
            use = dict(w[1])
            use[length] = use.get(length, 0) + each
            by_gap[w[2] - each * length].append([n, use, w[2] - each * length])
            number -= n * each
    return [(n, sorted(use.items(), reverse=True)) for g in sorted(by_gap) for n, use, _ in by_gap[g]]


def places(planned: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, sequence, pieces in each, offset): where the first-th to last-th piece of a length go."""
    taken, rows, sequence = defaultdict(int), [], 0
    for n, use in planned:
        offset = 0
        for length, each in use:
            rows.append((length, taken[length], taken[length] + n * each - 1, sequence, each, offset))
            taken[length] += n * each
            offset += each * length
        sequence += n
    return rows


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row of `docs`.

    Null and empty texts have the end id only. A document of more tokens than a window is cut at multiples of the window.
    Sequences are numbered from 0 without gaps, and so are offsets in each; ties between pieces of a length go by doc_id and start.
    Rows with null or repeated ids are packed each by itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")
    cut_up = cut(pieces(docs, path, window).withColumn("part", part), "pieces")
    histogram = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(histogram, window))
    table = spark.createDataFrame(where or [(0, 0, -1, 0, 1, 0)], "length long, first long, last long, sequence long, each long, at long")
    counts = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")).cast("long") - 1
    # counts has PARTS rows for each length at most; table is bounded by the number of lengths and combinations.
    numbered = cut_up.withColumn("rank", rank).join(F.broadcast(counts), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = numbered.alias("p").join(F.broadcast(table).alias("t"), F.expr("p.length = t.length and p.rank between t.first and t.last"))
    i = F.col("p.rank") - F.col("t.first")
    sequence = F.col("t.sequence") + F.expr("(p.rank - t.first) div t.each")
    return placed.select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), (F.col("t.at") + i % F.col("t.each") * F.col("p.length")).alias("offset"))
