"""Tagged values, canonical JSON, selectors and validations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(**fields: Column | str) -> Column:
    """JSON of an object with its keys in order and no spaces; nulls are written."""
    return F.to_json(F.struct(*(_col(fields[k]).alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def digest(**fields: Column | str) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(**fields), 256)


def keyed(key: str, *parts: Column) -> Column:
    """A keyed hash: the key goes in first and last, so that nothing can be added to the parts."""
    return F.sha2(F.concat(F.lit(f"{key}\u0000"), F.sha2(F.concat_ws("\u0000", F.lit(key), *parts), 256)), 256)


def object_key(kind: Column, value: Column) -> Column:
    """A name of a tagged value, equal for equal values only."""
    return F.to_json(F.struct(kind.alias("type"), value.cast("string").alias("value")), {"ignoreNullFields": "false"})


def slot_key(subject: Column, predicate: Column) -> Column:
    return F.concat_ws("\u0000", subject.cast("string"), predicate.cast("string"))


def value_type(json: Column | str) -> Column:
    """The kind of a JSON value: object, array, string, boolean, null, integer or number; null if it starts as none."""
    t = F.trim(_col(json))
    first = F.substr(t, F.lit(1), F.lit(1))
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(t.isin("true", "false"), "boolean").when(t == "null", "null").when(t.rlike(r"^-?[0-9]+$"), "integer").when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "number")


def json_depth(json: Column | str) -> Column:
    """How deep the braces and brackets outside of strings nest."""
    bare = F.regexp_replace(F.regexp_replace(_col(json), r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, walk, lambda acc: acc["most"])


def json_bounded(json: Column | str, most_bytes: int, most_depth: int = 64) -> Column:
    """Whether a JSON text is there, short enough and not nested too deep."""
    j = _col(json)
    return F.coalesce((F.octet_length(j) <= most_bytes) & (json_depth(j) <= most_depth) & value_type(j).isNotNull(), F.lit(False))


def string_set_valid(values: Column | str, most: int, most_bytes: int) -> Column:
    """Whether a set of strings has at most `most` values, none of them blank, too long or there twice."""
    v = _col(values)
    return F.coalesce((F.size(v) <= most) & F.forall(v, lambda x: (F.length(F.trim(x)) > 0) & (F.octet_length(x) <= most_bytes)) & (F.size(F.array_distinct(v)) == F.size(v)), F.lit(False))


def text_valid(text: Column | str, most_bytes: int) -> Column:
    """Whether a text isn't blank, and short enough."""
    return F.coalesce((F.length(F.trim(_col(text))) > 0) & (F.octet_length(_col(text)) <= most_bytes), F.lit(False))


def select(kind: str, content: Column | str, *at) -> Column:
    """What an evidence selector points at: bytes (start, end), characters (start, end), lines (first, last), a JSON path, a heading, a speaker's turn or a tool's field; null outside of the content."""
    c = _col(content)
    if kind == "bytes":
        raw = F.encode(c, "UTF-8")
        return F.when((F.lit(at[0]) < at[1]) & (F.lit(at[1]) <= F.octet_length(c)), F.hex(F.substring(raw, at[0] + 1, at[1] - at[0])))
    if kind == "characters":
        return F.when((F.lit(at[0]) < at[1]) & (F.lit(at[1]) <= F.length(c)), F.substring(c, at[0] + 1, at[1] - at[0]))
    if kind == "lines":
        lines = F.split(c, "\n")
        return F.when((F.lit(at[0]) >= 1) & (F.lit(at[0]) <= at[1]) & (F.lit(at[1]) <= F.size(lines)), F.array_join(F.slice(lines, at[0], at[1] - at[0] + 1), "\n"))
    if kind in ("json", "tool_field"):
        return F.get_json_object(c, at[0])
    if kind == "heading":
        return F.nullif(F.regexp_extract(c, f"<{at[0]}[^>]*>(.*?)</{at[0]}>", 1), F.lit(""))
    if kind == "speaker":
        return F.when(_col(at[0]) == at[1], c)
    raise ValueError(f"no selector of kind {kind}")
