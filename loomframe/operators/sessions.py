"""Session history: sliding expiry and the last entries, on a batch of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries kept of a session, and seconds after which it is forgotten.
KEEP, TTL = 20, 1800


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts))


def sessions(turns: DataFrame, key: str, ts: str, ttl: int = TTL) -> DataFrame:
    """Adds ``session``: a new one starts where the gap since the turn before is the ttl or more."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    opens = F.when(gap.isNull() | (gap >= ttl * 1_000_000), 1).otherwise(0)
    return turns.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def tail(turns: DataFrame, key: list[str], order: str, n: int = KEEP) -> DataFrame:
    """The last ``n`` turns of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
