"""Operator 9: language identification by a bidirectional gated recurrent network over bytes (see byte_gru)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_gru import WINDOW, Gru
from .common import bounded_arrow, text_batches

#: The bounded training sample: documents of each language, windows of each document. Every language that occurs is learned.
PER_LANGUAGE, WINDOWS = 250, 6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id):
    """True for documents that are never learned from; false for a null id (which isn't learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, steps: int = 350) -> Gru | None:
    """A network trained on windows from anywhere in the texts of a bounded sample of labelled documents.

    Documents whose remainder is 0 and those without text or language are left out. None if nothing is left. Rows are chosen, not
    ids: of rows that repeat an id only those chosen are read, and equal rows count once, so the sample is bounded.
    """
    own = F.xxhash64("text")
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "own"))
    chosen = may.select("doc_id", "lang", own.alias("own")).withColumn("i", place).where(F.col("i") <= per_language).select("doc_id", "lang", "own").distinct()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            out = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(doc_id % (1 << 32))
                for at in [0] if len(data) <= WINDOW else rng.integers(0, len(data) - WINDOW + 1, windows).tolist():
                    if data[at : at + WINDOW]:
                        out.append((doc_id, at, lang, data[at : at + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "at", "lang", "piece"])

    sample = may.withColumn("own", own).join(F.broadcast(chosen), ["doc_id", "lang", "own"]).select(F.col("doc_id").cast("long"), "lang", "text")
    rows = sorted({tuple(r) for r in sample.mapInArrow(some, "doc_id long, at long, lang string, piece binary").distinct().collect()}, key=lambda r: (r[0], r[1], r[2], bytes(r[3])))
    if not rows:
        return None
    names = sorted({r[2] for r in rows})
    net = Gru(names)
    net.train([bytes(r[3]) for r in rows], np.array([names.index(r[2]) for r in rows]), steps)
    return net


def predict(docs: DataFrame, net: Gru | None) -> DataFrame:
    """The columns of `docs` with lang_pred (string) and score (double) added, or in the place of columns of these names.

    Texts that are null or hold no letter get `und` and 0; so do all if there is no network. Every byte of a text counts,
    whatever its length. Only the text is looked at. A narrow map.
    """
    bounded_arrow(docs.sparkSession, 1000)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            texts = b.column(at).to_pylist()
            fit_ = [i for i, t in enumerate(texts) if net is not None and t is not None and _LETTER.search(t)]
            best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if fit_:
                for i, p in zip(fit_, net.documents([texts[i].encode("utf-8", "surrogatepass") for i in fit_])):
                    k = int(np.argmax(p))
                    best[i], score[i] = net.languages[k], min(1.0, float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`, by a network fitted on `docs`."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
