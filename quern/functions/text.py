"""Text functions as column expressions: normal forms, tokens, spans, cue rules, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of letters and numbers; with `_` in original text.
ALNUM, WORDISH = r"[\p{L}\p{N}]+", r"[\p{L}\p{N}_]+"
# The first words of an explicit statement and what it declares, in the order in which they are tried.
CUES = (
    ("do not remember ", "boundary:do_not_store"), ("don't remember ", "boundary:do_not_store"), ("do not store ", "boundary:do_not_store"), ("do not mention ", "boundary:do_not_mention"), ("never mention ", "boundary:do_not_mention"),
    ("не запоминай ", "boundary:do_not_store"), ("не храни ", "boundary:do_not_store"), ("не упоминай ", "boundary:do_not_mention"), ("не используй ", "boundary:do_not_influence"),
    ("i prefer ", "preference:strong"), ("i like ", "preference:moderate"), ("я предпочитаю ", "preference:strong"), ("мне нравится ", "preference:moderate"),
    ("моя цель — ", "goal"), ("моя цель - ", "goal"), ("my goal is ", "goal"), ("моя цель ", "goal"), ("i promise to ", "commitment"), ("я обещаю ", "commitment"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: Column | str) -> Column:
    """Lower case, with each run of other signs than letters and numbers as one space."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}]+", " "))


def all_tokens(text: Column | str) -> Column:
    """Runs of letters and numbers in lower case, as often as they occur."""
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def token_set(text: Column | str, least: int = 1) -> Column:
    """Distinct tokens of `least` characters or more, in order."""
    return F.array_sort(F.array_distinct(F.filter(all_tokens(text), lambda t: F.length(t) >= least)))


def bounded_terms(text: Column | str, most: int = 256) -> Column:
    """Distinct tokens of at most `most` bytes."""
    return F.filter(token_set(text), lambda t: F.octet_length(t) <= most)


def overlap_score(query: str, text: Column | str) -> Column:
    """The share of the query's terms in the text, and 1 more if it holds the query as it stands; null without a term in common."""
    want = sorted({t for t in "".join(c if c.isalnum() else " " for c in query).lower().split() if len(t.encode()) <= 256})
    found = F.size(F.array_intersect(F.array(*map(F.lit, want)), bounded_terms(text)))
    return F.when(found > 0, found / len(want) + F.when(F.contains(F.lower(_col(text)), F.lit(query.lower())), 1.0).otherwise(0.0))


def wordish(text: Column | str) -> Column:
    """Tokens of original text: letters, numbers and `_`, in lower case."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(f"({WORDISH})"), 1), F.lower)


def spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, term, start, end: the tokens of original text with their byte ranges in UTF-8."""
    parts = lambda group: F.regexp_extract_all(F.col(text), F.lit(f"([^\\p{{L}}\\p{{N}}_]*)({WORDISH})"), group)
    each = rows.select(key, F.posexplode(F.arrays_zip(parts(1).alias("gap"), parts(2).alias("own"))).alias("place", "p"))
    end = F.sum(F.octet_length("p.gap") + F.octet_length("p.own")).over(Window.partitionBy(key).orderBy("place"))
    sized = each.select(key, "place", F.lower("p.own").alias("term"), F.octet_length("p.own").alias("n"), end.alias("end"))
    return sized.select(key, "place", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def phrase_anchor(phrase: Column | str) -> Column:
    """The first token of a phrase that neither starts nor ends it: both its edges are whole."""
    p = _col(phrase)
    inner = F.regexp_replace(F.regexp_replace(p, f"^{WORDISH}", ""), f"{WORDISH}$", "")
    return F.lower(F.nullif(F.regexp_extract(inner, f"({WORDISH})", 1), F.lit("")))


def collapse(text: Column | str) -> Column:
    """Lower case and single spaces; punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(_col(text), r"\s+", " ")))


def is_refinement(old: Column | str, new: Column | str) -> Column:
    """Whether the new text is longer than the old one and holds it, both collapsed."""
    a, b = collapse(old), collapse(new)
    return (F.octet_length(b) > F.octet_length(a)) & F.contains(b, a)


def signal(text: Column | str) -> Column:
    """What a turn declares by its first words, if it says anything after them; else null."""
    t = F.trim(_col(text))
    low = F.lower(t)
    found = None
    for cue, kind in CUES:
        says = F.when(F.length(F.trim(F.substr(t, F.lit(len(cue) + 1)))) > 0, F.lit(kind))
        hit = F.startswith(low, F.lit(cue))
        found = F.when(hit, says) if found is None else found.when(hit, says)
    return found


def unique_range(content: Column | str, quote: Column | str) -> tuple[Column, Column]:
    """Byte range of a quote that occurs once; nulls if it occurs never or again (without overlap)."""
    c, q = _col(content), _col(quote)
    at = F.instr(c, q)
    again = F.instr(F.substr(c, at + F.length(q)), q)
    start = F.when((F.length(q) > 0) & (at > 0) & (again == 0), F.octet_length(F.substr(c, F.lit(1), at - 1)))
    return start.cast("long"), (start + F.octet_length(q)).cast("long")


def source_range(content: Column | str, first: Column, from_column: Column, last: Column, to_column: Column) -> Column:
    """Text from a line (from 1) and column (from 0) to another's, the last column excluded; null outside of the text."""
    lines = F.split(_col(content), "\n")
    a, b = F.get(lines, first - 1), F.get(lines, last - 1)
    fits = (first >= 1) & (first <= last) & a.isNotNull() & b.isNotNull() & (from_column <= F.length(a)) & (to_column <= F.length(b)) & ((first < last) | (from_column < to_column))
    one = F.substr(a, from_column + 1, to_column - from_column)
    inner = F.slice(lines, first + 1, F.greatest(last - first - 1, F.lit(0)))
    many = F.concat_ws("\n", F.substr(a, from_column + 1), F.when(F.size(inner) > 0, F.array_join(inner, "\n")), F.substr(b, F.lit(1), to_column))
    return F.when(fits, F.when(first == last, one).otherwise(many))


def is_kebab(text: Column | str) -> Column:
    return _col(text).rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def local_id(domain: str, text: Column | str, ordinal: Column) -> Column:
    """A stable name: `rule-` and 16 hexadecimal digits of a hash of the text and its ordinal."""
    return F.concat(F.lit("rule-"), F.substr(F.sha2(F.concat_ws("\u0000", F.lit(domain), _col(text), ordinal.cast("string")), 256), F.lit(1), F.lit(16)))


def token_count(text: Column | str) -> Column:
    """One for each run of letters, numbers and `_`, and one for each other sign but white space."""
    return F.regexp_count(_col(text), F.lit(rf"{WORDISH}|[^\s\p{{L}}\p{{N}}_]"))


def longest_terms(text: Column | str, most: int = 8) -> Column:
    """The longest distinct terms of three characters or more, ties in order; at most `most`."""
    terms = F.array_distinct(F.filter(wordish(text), lambda t: (F.length(t) >= 3) & (F.octet_length(t) <= 256)))
    keyed = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(keyed, lambda s: s["t"]), 1, most)
