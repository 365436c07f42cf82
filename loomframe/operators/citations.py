"""Checking the citations of answers: does the reference exist, was it retrieved, does the sentence fit it?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions.text import PAIRS_CITATION, char_pairs, coverage, norm_source, references

#: How much better another text must fit, and between which bounds, and from how many pairs on.
MARGIN, OTHER_FROM, OWN_UPTO, PAIRS_FROM = 0.10, 0.25, 0.35, 8
SEVERITY = {"fabricated": 0, "content_mismatch": 1, "not_in_context": 2, "verified": 3}


def verify(answers: DataFrame, store: DataFrame, retrieved: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct citation with its status.

    ``store``: source, number.  ``retrieved``: key, rank, source, number, document.
    """
    c = lexer.citations(answers, key, text).withColumn("want", norm_source(F.col("source"))).withColumnRenamed("source", "law")
    corpus = store.select(norm_source(F.col("source")).alias("s")).distinct().withColumn("known", F.lit(True))
    c = c.join(corpus, F.col("want") == F.col("s"), "left").withColumn("scoped", F.coalesce("known", F.lit(False))).drop("s", "known")
    by_number = store.groupBy("number").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("source")).alias("sources"), F.collect_set(norm_source(F.col("source"))).alias("norms"))
    c = c.join(by_number, "number", "left")
    exists = F.when(F.col("scoped"), F.coalesce(F.array_contains("norms", F.col("want")), F.lit(False))).otherwise(F.col("hits").isNotNull())
    mentioned = retrieved.select(key, "source", F.explode(F.array_distinct(F.concat(F.array("number"), F.transform(references(F.col("document")), lambda r: r["number"])))).alias("number")).filter("number is not null")
    places = mentioned.groupBy(key, "number").agg(F.array_sort(F.collect_set("source")).alias("context"))
    c = c.join(places, [key, "number"], "left")
    context = F.coalesce("context", F.array().cast("array<string>"))
    c = c.withColumn("found_in", F.when(F.col("scoped"), F.filter(context, lambda s: norm_source(s) == F.col("want"))).otherwise(context)).withColumn("exists", exists)
    basic = F.when(~F.col("exists"), "fabricated").when(F.size("found_in") > 0, "verified").otherwise("not_in_context")
    c = c.withColumn("basic", basic).withColumn("grams", char_pairs(F.col("sentence"), PAIRS_CITATION))
    fit = c.filter("basic = 'verified'").select(key, "i", F.col("number").alias("no"), "want", "grams").join(
        retrieved.select(key, "rank", "number", norm_source(F.col("source")).alias("src"), char_pairs(F.col("document"), PAIRS_CITATION).alias("body")), key)
    fit = fit.withColumn("cov", coverage(F.col("grams"), F.col("body"))).withColumn("may", (F.col("number") == F.col("no")) & (F.col("want").isNull() | (F.col("src") == F.col("want"))))
    fit = fit.withColumn("own_rank", F.min(F.when(F.col("may"), F.col("rank"))).over(Window.partitionBy(key, "i")))
    fit = fit.groupBy(key, "i").agg(F.max(F.when(F.col("rank") == F.col("own_rank"), F.col("cov"))).alias("own"), F.coalesce(F.max(F.when(F.col("rank") != F.col("own_rank"), F.col("cov"))), F.lit(0.0)).alias("best_other"))
    c = c.join(fit.filter("own is not null"), [key, "i"], "left")
    off = (F.size("grams") >= PAIRS_FROM) & (F.col("best_other") - F.col("own") >= MARGIN) & (F.col("best_other") >= OTHER_FROM) & (F.col("own") <= OWN_UPTO)
    status = F.when(F.coalesce(off, F.lit(False)), "content_mismatch").otherwise(F.col("basic"))
    return c.select(
        key, "number", "spelling", "law", status.alias("status"), "exists", (F.size("found_in") > 0).alias("in_context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "found_in",
        (~F.col("scoped") & (F.coalesce("hits", F.lit(0)) > 1)).alias("ambiguous"), F.round("own", 6).alias("own"), F.round("best_other", 6).alias("best_other"))


def report(checks: DataFrame, key: str) -> DataFrame:
    """Counts by status of each answer."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in SEVERITY]
    return checks.groupBy(key).agg(F.count("*").alias("total"), *counts, F.bool_or(F.col("status") != "verified").alias("has_problem"))


def by_severity(checks: DataFrame, key: str) -> DataFrame:
    """Adds ``place``: the order in which an answer's checks are shown, the gravest first, then by number."""
    rank = F.coalesce(*(F.when(F.col("status") == s, n) for s, n in SEVERITY.items()))
    return checks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, "number", F.coalesce("law", F.lit("")))))
