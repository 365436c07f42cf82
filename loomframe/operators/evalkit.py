"""Evaluation: retrieval metrics, AUC, threshold scans, gates, faithfulness and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_at(ranks: Column, k: int) -> Column:
    return F.exists(ranks, lambda r: (r > 0) & (r <= k))


def coverage_at(ranks: Column, k: int) -> Column:
    return (F.size(ranks) > 0) & F.forall(ranks, lambda r: (r > 0) & (r <= k))


def reciprocal_rank(ranks: Column) -> Column:
    return F.coalesce(1.0 / F.array_min(F.filter(ranks, lambda r: r > 0)), F.lit(0.0))


def retrieval_table(rows: DataFrame, group: str, ks=(1, 3, 5)) -> DataFrame:
    """Metrics by group and overall, from rows of (group, ranks); rows without ground truth do not count."""
    r = F.col("ranks")
    out = [F.count("*").alias("n")] + [F.round(F.avg(hit_at(r, k).cast("double")), 6).alias(f"hit_{k}") for k in ks]
    out += [F.round(F.avg(coverage_at(r, ks[-1]).cast("double")), 6).alias("coverage"), F.round(F.avg(reciprocal_rank(r)), 6).alias("mrr")]
    return rows.filter(F.size("ranks") > 0).rollup(group).agg(*out).withColumn(group, F.coalesce(group, F.lit("overall")))


#: Buckets of values that running sums are split into.
BUCKETS = 64


def bucketed(rows: DataFrame, value: str, parts: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bucket``: which of about equal ranges of the values a row falls into, so that no window needs all rows in one task.

    The bounds come from approximate quantiles; any bounds give the same running sums.
    """
    cuts = sorted(set(rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.01)))
    at = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value)))
    return rows.withColumn("bucket", at)


def running(rows: DataFrame, value: str, sums: list[str], parts: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``before_<sum>``: sums over smaller values (of the same ``parts``), from rows of distinct values with ``bucket``."""
    per = rows.groupBy(*parts, "bucket").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    ahead = Window.partitionBy(*parts).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    per = per.select(*parts, "bucket", *(F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums))
    own = Window.partitionBy(*parts, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(per, [*parts, "bucket"])
    return out.select(*rows.columns, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"before_{c}") for c in sums))


def auc(rows: DataFrame, positive: str, value: str) -> DataFrame:
    """Rank form with average ranks for ties; null if either side is empty.

    Ranks come from running sums over the distinct values, range by range.
    """
    per = bucketed(rows.groupBy(value).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q")), value)
    s = running(per, value, ["q"]).withColumn("won", F.col("p") * (F.col("before_q") + F.col("q") / 2)).agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.round(F.col("w") / (F.col("p") * F.col("q")), 6)).alias("auc"), F.coalesce("p", F.lit(0)).alias("positives"), F.coalesce("q", F.lit(0)).alias("negatives"))


def threshold_scan(rows: DataFrame, positive: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Cut points between neighbouring values, and beyond both ends: negatives below are caught, positives below are lost."""
    per = bucketed(rows.groupBy(F.col(value).alias("v")).agg(F.count_if(~F.col(positive)).alias("neg"), F.count_if(positive).alias("pos")), "v")
    first = per.groupBy("bucket").agg(F.min("v").alias("low"))
    first = first.select((F.lag("bucket").over(Window.orderBy("bucket"))).alias("bucket"), F.col("low").alias("after"))  # one row a bucket
    run = running(per, "v", ["neg", "pos"]).join(first, "bucket", "left")
    following = F.coalesce(F.lead("v").over(Window.partitionBy("bucket").orderBy("v")), "after")
    cum = run.select("v", following.alias("next"), (F.col("before_neg") + F.col("neg")).alias("caught"), (F.col("before_pos") + F.col("pos")).alias("lost"))
    inner = cum.select(F.coalesce((F.col("v") + F.col("next")) / 2, F.col("v") + eps).alias("t"), "caught", "lost")
    low = per.agg((F.min("v") - eps).alias("t"), F.lit(0).cast("long").alias("caught"), F.lit(0).cast("long").alias("lost"))
    return low.unionByName(inner)


def scan_readings(scan: DataFrame) -> DataFrame:
    """What catching all negatives costs, and what losing no positive catches."""
    most = scan.agg(F.max("caught").alias("all"))
    s = scan.join(F.broadcast(most))
    return s.agg(F.min(F.when(F.col("caught") == F.col("all"), F.col("lost"))).alias("cost_of_all"), F.max(F.when(F.col("lost") == 0, F.col("caught"))).alias("caught_for_free"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at floor(n p) of the sorted values, the last at most; null if there is none."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * p).cast("int")))


def gate(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """Each floor with the measured value and whether it holds; a floor without a measurement fails."""
    return floors.join(metrics, ["name", "metric"], "left").select("name", "metric", "floor", "value", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("passed"))
