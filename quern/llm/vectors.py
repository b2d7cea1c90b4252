"""Reading vectors from a table column: which take part, and equal ones as one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(v: Column | str) -> Column:
    """True for vectors that aren't null, empty or zero and hold no null or non-finite component."""
    v = F.col(v) if isinstance(v, str) else v
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fits & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label (null if there is none) and vector (array of double) of the rows whose vector takes part.

    Negative zeros become zeros, so that equal vectors are equal bytes.
    """
    label = F.col("label").cast("long") if "label" in rows.columns else F.lit(None).cast("long")
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    return rows.where(sound("embedding")).select(F.col("vec_id").cast("long"), label.alias("label"), v.alias("vector"))


def matrix(column) -> np.ndarray:
    """A float64 matrix of a pandas column of equally long arrays."""
    return np.array(list(column), dtype=np.float64) if len(column) else np.zeros((0, 0))
