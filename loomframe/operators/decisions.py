"""Abstention as columns: the threshold rule, when to skip the judge, and how its outcome is merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The similarity below which nothing is answered; how many sources a second pass may ask.
THRESHOLD, SECOND_PASS = 0.35, 2


def abstain(questions: DataFrame, retrieved: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, top_score, has_exact, abstained, reason; ``retrieved`` has key, score, exact."""
    per = retrieved.groupBy(key).agg(F.count("*").alias("n"), F.max("score").alias("s"), F.bool_or("exact").alias("e"))
    q = questions.select(key).join(per, key, "left")
    top, exact = F.coalesce("s", F.lit(0.0)), F.coalesce("e", F.lit(False))
    reason = F.when(F.col("n").isNull(), "no_hits").when((top < threshold) & ~exact, "below_threshold").otherwise("answered")
    return q.select(key, top.alias("top_score"), exact.alias("has_exact"), (reason != "answered").alias("abstained"), reason.alias("reason"))


def skip_reason(n_hits: Column, has_exact: Column, abstained: Column) -> Column:
    return F.when(n_hits == 0, "no_hits").when(has_exact, "exact_article_hit").when(abstained, "sim_abstain")


def merge(abstained: Column, reason: Column, outcome: Column, answerable: Column, binding: Column) -> tuple[Column, Column]:
    """(abstained, reason) after the judge; every failure keeps the threshold's decision."""
    judged = (outcome == "judged") & (binding != "not_in_context")
    mismatch = (outcome == "binding_mismatch") | ((outcome == "judged") & (binding == "not_in_context"))
    why = (
        F.when(mismatch, "judge_binding_mismatch").when(judged & answerable, "answered").when(judged, "judge_unanswerable")
        .when(outcome == "parse_failure", "judge_parse_failure").when(outcome == "error", "judge_error_fallback").otherwise(reason)
    )
    return F.when(judged, ~answerable).otherwise(abstained), why


def with_policy(policy: Column, hard_skip: Column, abstained: Column, judged: Column, answerable: Column) -> Column:
    """Whether a policy ('sim' or 'judge') refuses."""
    return F.when(hard_skip, abstained).when((policy == "sim") & abstained, True).when(judged, ~answerable).otherwise(abstained)
