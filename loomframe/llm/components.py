"""Connected components without collecting links anywhere.

Alternates two contractions until nothing changes.  *Large star*: every node
sends its larger neighbours to the smallest node of its neighbourhood.  *Small
star*: every node sends its smaller neighbours, and itself, to the smallest of
them.  The links end up as one star per component; the number of rounds grows
with the logarithm of the size, not with the diameter.

A neighbourhood is never gathered: its minimum is an aggregate (summed before
the shuffle) that is joined back to the links, so a hub's links may be split.
Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Links run from the larger node a to the smaller b."""
    low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = e.join(low, F.col("a") == F.col("u"))
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node reachable.

    ``parts``: files of each round, where the links are few.  Links may run either way, repeat, or join a node to itself (those are ignored); null ends are ignored.
    """
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e, before = cut(e, parts), None
    while True:
        e = cut(_small_star(_large_star(e)).filter("a <> b").distinct(), parts)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
