"""Half-open intervals and as-of reads; a null end is no end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds_at(start: str, end: str, at: Column | int) -> Column:
    """start <= at < end."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))


def as_of(revisions: DataFrame, snapshot: Column | int) -> DataFrame:
    """The revision of each identity that was visible at a commit: intervals don't overlap, so a filter does."""
    return revisions.where(holds_at("tx_from", "tx_to", snapshot))


def bitemporal(revisions: DataFrame, key: list[str], snapshot: Column | int, at: Column | int) -> DataFrame:
    """The latest revision of each key that is visible at a commit and valid at a time."""
    known = as_of(revisions, snapshot).where(holds_at("valid_from", "valid_to", at))
    return known.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("tx_from")))).where("_r = 1").drop("_r")


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of rows of a key whose intervals [start, end) overlap, by bins of `width`; ends must not be null.

    A row is in each bin that it touches; a pair is kept in the bin of its later start, so it comes once.
    """
    binned = lambda df, tag: df.select(*key, F.col("id").alias(f"{tag}_id"), F.col("start").alias(f"{tag}_start"), F.col("end").alias(f"{tag}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"))
    pairs = binned(left.where("start < end"), "l").join(binned(right.where("start < end"), "r"), [*key, "bin"])
    later = F.greatest("l_start", "r_start")
    return pairs.where((later < F.least("l_end", "r_end")) & (F.floor(later / width) == F.col("bin"))).drop("bin")


def gaps(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Ranges (gap_from, gap_to) of numbers missing between the present ones of each key."""
    after = F.lead(sequence).over(Window.partitionBy(*key).orderBy(sequence))
    return rows.select(*key, sequence).distinct().withColumn("_next", after).where(F.col("_next") > F.col(sequence) + 1).select(*key, (F.col(sequence) + 1).alias("gap_from"), (F.col("_next") - 1).alias("gap_to"))
