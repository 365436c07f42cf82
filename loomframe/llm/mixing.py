"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets: the mix holds ``share`` times all words, dealt by weight.  A source is
clamped at ``epochs`` times its size and the excess is dealt again by weight
until none is above.  That fixed point has a closed form: with sources ordered
by cap / weight, the level is the largest of (total - caps before) / (weights
from here on), and each target is the smaller of cap and level x weight.

Sampling: a source at e epochs repeats every document floor(e) times, and the
rest once more for documents in the order of a seeded md5 until the words are
reached.  Documents fall into hash buckets of about ``BUCKET`` documents; sums
per bucket tell which bucket the cut falls into, and only those buckets (one per
source) are ordered document by document.  A hot source is therefore never
ordered in one task; only its bucket sums are.  The document whose size is
nearest to what is still missing closes the gap.

One global window runs over the per-source sums: one row per source.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; sizes of 0 give targets of 0; ties are ordered by id; rows that repeat
an id, or have none, are separate documents (equal rows are interchangeable); a very long text counts by its words like any
other, and closes a gap only if it is the nearest; extra columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 2000


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """src, n_docs, source_size, target from rows of (src, size).  Weights repeat over the sources in order."""
    per = sizes.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    per = per.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)))
    per = per.withColumn("cap", epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - before("cap")) / (F.sum("w").over(everything) - before("w"))
    return per.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(
        "src", "n_docs", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """id, size, source_size, target and times (how often the mix holds the document), with the ``keep`` columns."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), *keep))
    goal = targets(rows, **how)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("n_buckets", F.ceil(F.col("n_docs") / BUCKET)).withColumnRenamed("src", "s")
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.join(goal, F.col("src").eqNullSafe(F.col("s"))).drop("s").withColumn("h", h)
    dealt = dealt.withColumn("b", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_buckets"))
    own = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(F.col("src").alias("s"), F.col("b").alias("k"), F.col("rest").alias("r")).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(own)).select("s", "k", (F.col("upto") <= F.col("r")).alias("all"), (F.col("r") - F.col("upto") + F.col("n")).alias("left"))
    dealt = dealt.join(sums, F.col("src").eqNullSafe(F.col("s")) & (F.col("b") == F.col("k")))
    out = ["id", "src", "size", "source_size", "target", *keep]
    clear = dealt.filter(F.col("all") | (F.col("left") <= 0)).select(*out, (F.col("whole") + F.col("all").cast("int")).alias("times"))
    group = Window.partitionBy("src", "b")
    torn = dealt.filter(~F.col("all") & (F.col("left") > 0))
    torn = torn.withColumn("upto", F.sum("size").over(group.orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    torn = torn.withColumn("in", F.col("upto") <= F.col("left"))
    torn = torn.withColumn("gap", F.col("left") - F.coalesce(F.max(F.when(F.col("in"), F.col("upto"))).over(group), F.lit(0)))
    nearest = F.row_number().over(group.orderBy(F.col("in"), F.abs(F.col("size") - F.col("gap")), "h", "id"))
    torn = torn.withColumn("last", ~F.col("in") & (nearest == 1) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    torn = torn.select(*out, (F.col("whole") + (F.col("in") | F.col("last")).cast("int")).alias("times"))
    return clear.unionByName(torn).withColumnRenamed("id", id_col).withColumnRenamed("src", source_col)
