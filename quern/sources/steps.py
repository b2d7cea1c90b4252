"""Tables between the steps of an iteration: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of sessions on a local master that name none.
_temporary: dict[str, str | None] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on a local master a temporary one if it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _temporary.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="quern-")
        _temporary[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written in the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
