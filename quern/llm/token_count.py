"""Operator 1: token counts of whole texts (see word_bpe for the merging)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow
from .word_bpe import counter


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text as a long. Null and empty texts count 0; any length is counted whole."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`; further columns are ignored.

    A narrow map: no shuffle, rows repeat as they do in `docs`, and a null doc_id is kept. An empty table
    gives an empty result.
    """
    bounded_arrow(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
