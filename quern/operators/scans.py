"""Keyed reads: point gets, pages with exact continuation, byte caps, overlays of staged changes, export and import."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[str], after: Column | None, entries: int, size: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """The next rows in `order` behind `after` (a predicate), at most `entries` and most_bytes of column `size`, each with has_more.

    One row more than asked is read (a top-k, not a sort of the table); it tells if the page has a successor. The first row comes whatever its size.
    """
    ahead = (rows if after is None else rows.where(after)).orderBy(*order).limit(entries + 1)
    w = Window.orderBy(*order)
    numbered = ahead.withColumn("_n", F.row_number().over(w)).withColumn("_bytes", F.sum(F.col(size) if size else F.lit(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("_n") <= entries) & ((F.col("_n") == 1) | (F.lit(most_bytes is None) | (F.col("_bytes") <= (most_bytes or 0))))
    marked = numbered.withColumn("_fits", fits).withColumn("has_more", F.min("_fits").over(Window.partitionBy()) == F.lit(False))
    return marked.where("_fits").drop("_n", "_bytes", "_fits")


def overlay(base: DataFrame, staged: DataFrame, key: str, values: list[str]) -> DataFrame:
    """`base` under staged changes (key, op put or delete, values): the last word on each key is the staged one."""
    s = staged.select(key, "op", *(F.col(v).alias(f"_{v}") for v in values))
    both = base.join(s, key, "full_outer").where(F.col("op").isNull() | (F.col("op") == "put"))
    return both.select(key, *(F.when(F.col("op").isNull(), F.col(v)).otherwise(F.col(f"_{v}")).alias(v) for v in values))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the greatest `order` of each key, by one aggregation (combined before the shuffle), without a window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def ids_to_numbers(rows: DataFrame, name: str) -> DataFrame:
    """name, number: gapless numbers from 0 for distinct names in order. Parts are sorted by ranges; only their sizes meet."""
    from ..sources.steps import settle

    sorted_ = settle(rows.select(name).distinct().orderBy(name).withColumn("_m", F.monotonically_increasing_id()), "names").withColumn("_part", F.shiftright("_m", 33))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_k"))
    before = sizes.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.join(F.broadcast(before), "_part").select(name, (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def encode_cursor(key: bytes, **state) -> str:
    """A token that binds what a page continues: the state and a keyed hash of it."""
    body = json.dumps(state, sort_keys=True, separators=(",", ":")).encode()
    return f"{body.hex()}.{hmac.new(key, b'cursor' + body, hashlib.sha256).hexdigest()}"


def decode_cursor(key: bytes, token: str, **bound) -> dict:
    """The state of a token; ValueError if it isn't whole, or bound to another request."""
    head, _, tail = token.partition(".")
    try:
        body = bytes.fromhex(head)
    except ValueError as e:
        raise ValueError("the cursor is no token") from e
    if not hmac.compare_digest(hmac.new(key, b"cursor" + body, hashlib.sha256).hexdigest(), tail):
        raise ValueError("the cursor is not of this service")
    state = json.loads(body)
    if any(state.get(k) != v for k, v in bound.items()):
        raise ValueError("the cursor is bound to another request")
    return state


def export_rows(rows: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, nulls written."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def import_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of exported lines; a line that doesn't fit the schema ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def framed(rows: DataFrame, key: str, payload: Column, kind: str, version: int = 1) -> DataFrame:
    """key and a record envelope: magic, kind, version, length, checksum and payload."""
    body = F.encode(payload, "UTF-8")
    head = F.concat(F.lit(f"QR|{kind}|{version}|"), F.octet_length(body).cast("string"), F.lit("|"), F.crc32(body).cast("string"), F.lit("|"))
    return rows.select(key, F.concat(head, payload).alias("record"))


def unframed(records: DataFrame, key: str, kind: str, most: int = 1 << 20) -> DataFrame:
    """key, payload, fault: a record's payload if magic, kind, length and checksum hold; else what doesn't."""
    part = lambda i: F.regexp_extract("record", r"(?s)^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$", i)
    body = F.encode(part(6), "UTF-8")
    fault = F.when(part(1) != "QR", "magic").when(part(2) != kind, "kind").when(F.octet_length(body) > most, "too long").when(F.octet_length(body).cast("string") != part(4), "length").when(F.crc32(body).cast("string") != part(5), "checksum")
    return records.select(key, F.when(fault.isNull(), part(6)).alias("payload"), fault.alias("fault"))


def byte_range(payload: Column, start: int, end: int, most: int = 1 << 20) -> Column:
    """Bytes from start to end (excluded) of a binary payload; null outside of it, or if there are more than `most`."""
    return F.when((F.lit(start) < end) & (F.lit(end) <= F.octet_length(payload)) & F.lit(end - start <= most), F.substring(payload, start + 1, end - start))


def name_status(blob: Column) -> Column:
    """(status, path, old_path) from NUL-separated name-status output; renames and copies (R, C) name two paths."""
    parts = F.filter(F.split(blob, "\u0000"), lambda p: p != "")
    empty = F.array().cast("array<struct<status:string,path:string,old_path:string>>")
    start = F.struct(empty.alias("rows"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("old"))

    def step(acc: Column, p: Column) -> Column:
        two = acc["status"].rlike("^[RC]") & acc["old"].isNull()
        row = F.struct(acc["status"].alias("status"), p.alias("path"), acc["old"].alias("old_path"))
        none = F.lit(None).cast("string")
        done = acc["status"].isNotNull() & ~two
        return F.struct(F.when(done, F.array_append(acc["rows"], row)).otherwise(acc["rows"]).alias("rows"), F.when(acc["status"].isNull(), p).when(two, acc["status"]).otherwise(none).alias("status"), F.when(acc["status"].isNotNull() & two, p).otherwise(none).alias("old"))

    return F.aggregate(parts, start, step, lambda acc: acc["rows"])
