"""Operator 10: SentencePiece ids of whole texts and their decoding (see piece_bpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_arrow, text_batches
from .piece_bpe import encoder

ENCODED = "doc_id long, ids string, decoded string"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (in decimal, joined by spaces, the end id last) and decoded text for every row of `docs`.

    Null texts count as empty: only the end id. A narrow map over whole texts; further columns are ignored,
    repeated rows and null ids stay, and an empty table gives an empty result.
    """
    return _mapped(docs, path, ENCODED, lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, as `encode_decode` gives ids and texts, without moving them."""

    def digest(ids: str, text: str):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return ids.count(" ") + 1, sha(ids), sha(text)

    return _mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, path: str, ddl: str, row) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in text_batches(batches):
            rows = []
            for text in b.column(1).to_pylist():
                ids = e.written(text)
                rows.append(row(ids, e.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema)

    bounded_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast(T.StringType())).mapInArrow(run, ddl)
