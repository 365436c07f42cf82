"""Structural checks of a corpus, each a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evalkit import bucketed

#: Shortest body compared for duplicates, and shortest that is not too short.
DUPLICATE_FROM, SHORT_BELOW = 10, 12


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_bodies(rows: DataFrame, body: str, item: str, place: str) -> DataFrame:
    """hash, items, severity: one body under several items; worse within one place."""
    long = rows.filter(F.char_length(body) >= DUPLICATE_FROM).withColumn("hash", F.sha1(F.col(body).cast("binary")))
    per = long.groupBy("hash").agg(F.countDistinct(item).alias("items"), F.countDistinct(place).alias("places"), F.count("*").alias("n"), F.min(item).alias("first_item"))
    same = F.when(F.col("places") < F.col("items"), "error").otherwise("warn")
    return per.filter("items > 1").select("hash", "items", "first_item", same.alias("severity"))


def short_bodies(rows: DataFrame, body: str) -> DataFrame:
    return rows.filter(F.char_length(body) < SHORT_BELOW)


def with_previous(rows: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """Adds ``previous``: the number before each in its group's order, found range by range so that a large group is not one task."""
    d = bucketed(rows, order)
    within = F.lag(number).over(Window.partitionBy(group, "bucket").orderBy(order))
    first = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(order))
    last = d.groupBy(group, "bucket").agg(F.max_by(number, order).alias("last"))
    ahead = last.select(F.col(group).alias("_g"), F.col("bucket").alias("_b"), F.lag("last").over(Window.partitionBy(group).orderBy("bucket")).alias("_before"))  # one row a bucket
    d = d.withColumn("_within", within).withColumn("_first", first).join(ahead, F.col(group).eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b")))
    return d.select(*rows.columns, F.when(F.col("_first") == 1, F.col("_before")).otherwise(F.col("_within")).alias("previous"))


def sequence_breaks(rows: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """Where numbers do not rise by one: not at all is an error, a gap is a warning with what is missing."""
    out = with_previous(rows, group, order, number).withColumn("step", F.col(number) - F.col("previous")).filter((F.col("step") <= 0) | (F.col("step") > 1))
    return out.select(group, number, "step", F.when(F.col("step") <= 0, "error").otherwise("warn").alias("severity"), F.greatest(F.col("step") - 1, F.lit(0)).alias("missing"))


def missing_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Stretches of 1 .. max that no row has, as (group, first, last)."""
    seen = with_previous(rows.select(group, number).distinct(), group, number, number).withColumn("before", F.coalesce("previous", F.lit(0)))
    return seen.filter(F.col(number) > F.col("before") + 1).select(group, (F.col("before") + 1).alias("first"), (F.col(number) - 1).alias("last"))
