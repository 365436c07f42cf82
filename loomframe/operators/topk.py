"""Exact vector top-k with pinned identifiers, source boosts and filters.

Scoring runs block by block: queries and items are dealt into blocks, each pair
of blocks is scored in matrix products of bounded bytes, and only the k best of each query leave it.  What
is shuffled is the items once per query block; memory per task is two blocks and ``SCORE_BYTES`` of scores.
Scores are rounded to 9 digits before they are compared, so equal vectors tie on
``ord`` whatever the order of summation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_ws

#: Fixed value: what naming its source adds to a score, once.
BOOST = 0.03
#: Rows of a block of queries or items, and bytes of scores that a task holds at once.
BLOCK, SCORE_BYTES = 8_192, 32 << 20


def cosine(a: Column, b: Column) -> Column:
    """JVM cosine in double precision; 0 if either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def scores(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, ord, score): the k best items of each query by boosted score.

    ``queries``: query_id, qv, names, source_filter.  ``items``: ord, source, embedding, and kind if some are headings, which are never found.
    """
    if "kind" in items.columns:
        items = items.filter(~F.col("kind").eqNullSafe(F.lit("heading")))
    (nq, ni) = (max(1, -(-df.count() // BLOCK)) for df in (queries, items))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(ni - 1))))
    x = items.withColumn("ib", F.pmod(F.xxhash64("ord"), F.lit(ni)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ord": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return none
        b, ids = _unit(right["embedding"]), right["ord"].to_numpy()
        kinds, inv = np.unique(right["source"].astype(str).to_numpy(), return_inverse=True)
        step, out = max(1, SCORE_BYTES // (8 * len(ids))), []
        for at in range(0, len(left), step):
            part = left.iloc[at : at + step]
            s = _unit(part["qv"]) @ b.T
            for i, (names, only) in enumerate(zip(part["names"], part["source_filter"], strict=True)):
                if names is not None and len(names):
                    s[i] += BOOST * np.array([any(n in c for n in names) for c in kinds])[inv]
                if only is not None:
                    s[i, ~np.array([only in c for c in kinds])[inv]] = -np.inf
            np.round(s, 9, out=s)
            cut = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(s), -np.inf)
            row, col = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
            order = np.lexsort((ids[col], -s[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, np.arange(len(s)))
            best = np.arange(len(row)) - first[row] < k
            row, col = row[best], col[best]
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "ord": ids[col], "score": s[row, col]}))
        return pd.concat(out)

    found = q.groupBy("qb", "ib").cogroup(x.groupBy("qb", "ib")).applyInPandas(lambda left, right: block(left, right), "query_id long, ord long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return found.withColumn("pool_rank", F.row_number().over(best)).filter(F.col("pool_rank") <= k)


def source_named(names: Column, source: Column) -> Column:
    return F.coalesce(F.exists(names, lambda n: F.contains(source, n)), F.lit(False))


def pinned(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, ord, score) of items that an identifier of the query pins.

    With pairs, a pair's number and source must both match, or a loose number alone; without, a number counts
    if the query names no source or the item's.  ``queries`` also has numbers and pairs.
    """
    paired = F.coalesce(F.size("pairs") > 0, F.lit(False))
    by_pair = queries.filter(paired).select("query_id", "qv", "names", "source_filter", F.explode("pairs").alias("p")).select(
        "query_id", "qv", "names", "source_filter", F.col("p.number").alias("number"), F.col("p.source").alias("need"), F.lit(False).alias("free"))
    by_number = queries.select("query_id", "qv", "names", "source_filter", F.explode("numbers").alias("number"), F.lit(None).cast("string").alias("need"), (paired | (F.size("names") == 0)).alias("free"))
    if "kind" in items.columns:
        items = items.filter(~F.col("kind").eqNullSafe(F.lit("heading")))
    hit = by_pair.unionByName(by_number).join(items, "number")
    ok = F.when(F.col("need").isNotNull(), F.contains("source", F.col("need"))).otherwise(F.col("free") | source_named(F.col("names"), F.col("source")))
    ok &= F.col("source_filter").isNull() | F.contains("source", F.col("source_filter"))
    score = F.round(F.round(cosine(F.col("qv"), F.col("embedding")), 9) + F.when(source_named(F.col("names"), F.col("source")), BOOST).otherwise(0.0), 9)
    return hit.filter(ok).select("query_id", "ord", score.alias("score")).dropDuplicates(["query_id", "ord"])


def hybrid(queries: DataFrame, items: DataFrame, k: int = 5, found: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, ord, score, exact): pinned items first, then the rest, each by score and ord.

    ``found``: what ``scores`` gave for these, for ``k`` or more, so that it is not computed again.
    """
    pins = pinned(queries, items)
    best = scores(queries, items, k) if found is None else found.filter(F.col("pool_rank") <= k)
    rest = best.select("query_id", "ord", "score").join(pins.select("query_id", "ord"), ["query_id", "ord"], "left_anti")
    both = pins.withColumn("exact", F.lit(True)).unionByName(rest.withColumn("exact", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "ord")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "ord", "score", "exact")


def non_empty(ranked: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Ranked items whose document is not blank, the first ``k`` of them: there may be fewer.  ``documents``: ord, document."""
    kept = ranked.join(documents.select("ord", "document"), "ord").filter(trim_ws(F.coalesce("document", F.lit(""))) != "")
    return kept.drop("document").filter(F.col("rank") <= k)


def reranked(ranked: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, ord, score, exact): pinned items first as they were, the rest by the model's score; all, with ``place`` for those within k.

    ``model``: query_id, ord, model.
    """
    j = ranked.join(model, ["query_id", "ord"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.when(F.col("exact"), F.col("rank")), F.desc("model"), "rank")
    return j.select("query_id", F.row_number().over(order).alias("rank"), "ord", "score", "exact", "model")
