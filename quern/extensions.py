"""What a user may put in place of the engine's own parts: protocols, their deterministic defaults, and a registry.

Providers hand over DataFrames, scorers and counters are column expressions or Arrow UDFs, models run in mapInPandas, sinks in foreachBatch, and a
folder of exported rows can be read as a data source of its own (`spark.read.format("quern_rows")`).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .functions import numbers, text
from .operators import packing, scans


class RecallProvider(Protocol):
    """A corpus: documents and relations at a commit, by metadata first."""

    def documents(self, spark: SparkSession, commit: int | None) -> DataFrame: ...
    def relations(self, spark: SparkSession, commit: int | None) -> DataFrame: ...


class IndexedRecallProvider(RecallProvider, Protocol):
    """A corpus that can name candidates for terms."""

    def candidates(self, spark: SparkSession, terms: list[str], most: int) -> DataFrame: ...


class ContextProvider(Protocol):
    def blocks(self, spark: SparkSession, request: dict) -> DataFrame: ...


class AssemblyProvider(ContextProvider, Protocol):
    def depends(self, spark: SparkSession, ids: DataFrame) -> DataFrame: ...
    def original(self, spark: SparkSession, ids: DataFrame) -> DataFrame: ...


class ContextScorer(Protocol):
    """A score for each unit; null stops it."""

    def score(self, utility: Column, new_facets: Column, tokens: Column) -> Column: ...


class TokenCounter(Protocol):
    def count(self, said: Column) -> Column: ...


class OutgoingEncoder(Protocol):
    def encode(self, rows: DataFrame, by: str) -> DataFrame: ...


class HierarchyRead(Protocol):
    def edges(self, spark: SparkSession, generation: int | None) -> DataFrame: ...


class HierarchyRepository(HierarchyRead, Protocol):
    def publish(self, edges: DataFrame) -> int: ...


class VectorSource(Protocol):
    def page(self, spark: SparkSession, after: int, most: int) -> DataFrame: ...


class ObjectReader(Protocol):
    def read(self, spark: SparkSession, generation: int) -> DataFrame: ...


class StorageEngine(Protocol):
    def get(self, key: str) -> DataFrame: ...
    def prefix(self, start: str) -> DataFrame: ...
    def commit(self, staged: DataFrame) -> int: ...


class ModelProvider(Protocol):
    """Texts in, texts out; null is a failure that the fallback answers."""

    def complete(self, prompts: list[str]) -> list[str | None]: ...


class SemanticOutputValidator(Protocol):
    def faults(self, output: str) -> list[str]: ...


class Clock(Protocol):
    """The time in microseconds: runs take it as an argument, so that they can be repeated."""

    def now(self) -> int: ...


class DeletionEvidenceVerifier(Protocol):
    def holds(self, target: Column, digest: Column) -> Column: ...


class SystemUnderTest(Protocol):
    def answer(self, queries: DataFrame) -> DataFrame: ...


# Defaults.


class R0Scorer:
    def score(self, utility: Column, new_facets: Column, tokens: Column) -> Column:
        return numbers.r0_score(utility, new_facets, tokens)


class ReferenceTokens:
    def count(self, said: Column) -> Column:
        return text.token_count(said)


class JsonEncoder:
    """The rows of each group as one JSON list, in the order of their columns."""

    def encode(self, rows: DataFrame, by: str) -> DataFrame:
        rest = [c for c in rows.columns if c != by]
        return rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("wire"))


class FixedClock:
    def __init__(self, at: int):
        self.at = at

    def now(self) -> int:
        return self.at


class SystemClock:
    def now(self) -> int:
        return time.time_ns() // 1000


class Echo:
    """A model that repeats what it is asked; texts that hold `fail` are failures. For tests and dry runs."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [None if "fail" in p else p for p in prompts]


def fallback(prompt: str) -> str:
    """What is said where no model answers: the first sentence, at most 80 characters."""
    return prompt.split(".")[0][:80]


class StrictJson:
    """An object with the keys of a schema (name: type, of string, integer, number, boolean, array, object; `?` behind it: may be missing), each once."""

    TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}

    def __init__(self, **schema: str):
        self.schema = schema

    def faults(self, output: str) -> list[str]:
        twice: list[str] = []

        def pairs(items: list[tuple[str, Any]]) -> dict:
            names = [k for k, _ in items]
            twice.extend(sorted({k for k in names if names.count(k) > 1}))
            return dict(items)

        try:
            value = json.loads(output, object_pairs_hook=pairs)
        except (ValueError, TypeError):
            return ["not JSON"]
        if not isinstance(value, dict):
            return ["not an object"]
        found = [f"{k}: twice" for k in twice] + [f"{k}: unknown" for k in sorted(value.keys() - self.schema.keys())]
        for name, kind in self.schema.items():
            if name not in value:
                found += [] if kind.endswith("?") else [f"{name}: missing"]
            elif not isinstance(value[name], self.TYPES[kind.rstrip("?")]) or isinstance(value[name], bool) and kind.rstrip("?") in ("integer", "number"):
                found.append(f"{name}: not {kind.rstrip('?')}")
        return found


class KeyValue:
    """A storage engine over a folder: each commit is a folder of staged rows (key, op, value), the last word on a key holds."""

    SCHEMA = "key string, op string, value string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.commits = spark, root, 0

    def snapshot(self, commit: int | None = None) -> DataFrame:
        upto = self.commits if commit is None else commit
        parts = [self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/c={i}").withColumn("c", F.lit(i)) for i in range(1, upto + 1)]
        if not parts:
            return self.spark.createDataFrame([], "key string, value string")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return scans.latest(rows, ["key"], "c").where("op = 'put'").select("key", "value")

    def get(self, key: str) -> DataFrame:
        return self.snapshot().where(F.col("key") == key)

    def prefix(self, start: str) -> DataFrame:
        return self.snapshot().where(F.startswith("key", F.lit(start))).orderBy("key")

    def commit(self, staged: DataFrame) -> int:
        staged.select("key", "op", "value").write.parquet(f"{self.root}/c={self.commits + 1}")
        self.commits += 1
        return self.commits


def complete(rows: DataFrame, prompt: str, model: ModelProvider, validator: SemanticOutputValidator | None = None) -> DataFrame:
    """`rows` with answer, source (model or fallback) and faults (array), batch by batch; a model's failure is answered by the fallback."""
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = model.complete([p or "" for p in f[prompt]])
            answers = [a if a is not None else fallback(p or "") for a, p in zip(said, f[prompt])]
            yield f.assign(answer=answers, source=["fallback" if a is None else "model" for a in said], faults=[validator.faults(a) if validator else [] for a in answers])

    return rows.mapInPandas(run, f"{kinds}, answer string, source string, faults array<string>")


def audit(rows: DataFrame, path: str) -> None:
    """What a model was asked and said, by digests only, appended to a folder."""
    rows.select(F.sha2("answer", 256).alias("answer_digest"), "source", F.size("faults").alias("n_faults")).write.mode("append").parquet(path)


def prepare(hooks: list[Callable[[DataFrame], DataFrame]], rows: DataFrame) -> DataFrame:
    """Rows through each hook in order."""
    for hook in hooks:
        rows = hook(rows)
    return rows


def reconcile(calls: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each tool call with what is known of it: done, failed, or unknown where no result came; unknown calls are never made again."""
    state = F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "done").otherwise("failed")
    return calls.join(results.select(key, "ok"), key, "left").withColumn("state", state).drop("ok")


def packed(provider: ContextProvider, spark: SparkSession, request: dict, budget: int) -> DataFrame:
    """A pack of a provider's blocks."""
    return packing.pack(provider.blocks(spark, request), "request", budget)


# A data source of exported rows: one JSON object a line, a partition for each file.


class RowsSource(DataSource):
    """`spark.read.format("quern_rows").schema(...).load(folder)`: the lines of all files in a local or mounted folder."""

    @classmethod
    def name(cls) -> str:
        return "quern_rows"

    def schema(self) -> str:
        return "id string, kind string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _RowsReader(self.options["path"], [f.name for f in schema.fields])


class _RowsReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path.removeprefix("file://"), names

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(f)) for f in sorted(Path(self.path).iterdir()) if not f.name.startswith((".", "_"))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                yield tuple(row.get(n) for n in self.names)


#: Parts by name; a session's own are added with register().
PARTS: dict[str, Any] = {"scorer": R0Scorer(), "tokens": ReferenceTokens(), "encoder": JsonEncoder(), "clock": SystemClock(), "model": Echo()}


def register(spark: SparkSession, **parts: Any) -> None:
    """Put parts in the place of the defaults, and make the data source known to the session."""
    PARTS.update(parts)
    spark.dataSource.register(RowsSource)
