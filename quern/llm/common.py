"""What several operators share: lineage cuts, bounded broadcasts and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, and their bytes at most (a Spark row has 8 bytes a column and 16 more).
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: Removes a query's shuffle files when it has ended, not when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


#: Folders of sessions on a local master that name none.
_temporary: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is made on a local master only (as in tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _temporary.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="quern-")
        _temporary[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as a table in the shared folder and read it: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has written; nothing that is still to be computed may read them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function that returns the rows of `step` as one table; all other tables that cut() writes meanwhile are deleted."""

    @wraps(step)
    def run(*args, **kwargs) -> DataFrame:
        _scopes.append([])
        try:
            out = step(*args, **kwargs)
            result = cut(out, step.__name__)
            kept = _scopes[-1].pop()
        finally:
            paths = _scopes.pop()
            spark = SparkSession.getActiveSession()
            for path in paths:
                _delete(spark, path)
        if _scopes:
            _scopes[-1].append(kept)
        return result

    return run


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (already cut, of numbers only) marked for broadcast if its rows are few, and take BROADCAST_BYTES at most; else as it is."""
    rows = min(rows, BROADCAST_BYTES // (16 + 8 * len(df.columns)))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_batches(batches: Iterator, chars: int = 4_000_000) -> Iterator:
    """Slices of Arrow record batches that hold about `chars` bytes each, so that long texts don't add up."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * chars / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context: they may not share the driver's path."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='quern-')}/quern.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._quern_shipped = True


def bounded_arrow(spark: SparkSession, rows: int = 2000) -> None:
    """Ready for Python stages: Arrow batches of at most `rows` rows, unless the session already asks for fewer."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
