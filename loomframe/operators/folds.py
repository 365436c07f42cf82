"""The two order-dependent folds over short ranked lists: source coverage and rewrite merging.

Both work on at most a few rows per query, held as arrays; each swap changes
what the next may do, so they are folds (``aggregate``) rather than joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a fold sees of a row.
ROW = "array<struct<place: int, ord: bigint, source: string, exact: boolean>>"


def _list(part: Column) -> Column:
    """The rows of a part in their order."""
    row = F.struct(F.col("place").cast("int").alias("place"), F.col("ord").cast("long").alias("ord"), "source", "exact")
    return F.coalesce(F.array_sort(F.collect_list(F.when(part, row))), F.array().cast(ROW))


def _swapped(out: Column, at: Column, row: Column) -> Column:
    return F.transform(out, lambda x, i: F.when(i == at, row).otherwise(x))


def _last_spare(out: Column, reach: Column, more_than: int) -> Column:
    """The last place before ``reach`` that is not pinned and whose source has more than ``more_than`` rows; null if there is none."""
    same = lambda x: F.size(F.filter(out, lambda y: y["source"] == x["source"]))
    return F.array_max(F.transform(out, lambda x, i: F.when((i < reach) & ~x["exact"] & (same(x) > more_than), i)))


def _cover(results: Column, pool: Column, names: Column, present: Column) -> Column:
    """Bring in each named source that the results lack, if its best item was next in line.

    ``pool`` is in score order and reaches at least one past the results.
    """
    said = F.array_distinct(names)
    wanted = F.filter(said, lambda n: F.array_contains(present, n))

    def step(out: Column, name: Column) -> Column:
        lacks = ~F.exists(out, lambda x: F.contains(x["source"], name))
        fits = F.transform(pool, lambda p: F.contains(p["source"], name) & ~F.exists(out, lambda x: x["ord"] == p["ord"]))
        place = F.array_position(fits, F.lit(True)).cast("int")  # from 1
        spare = _last_spare(out, F.size(out), 1)
        return F.when(lacks & (place > 0) & (place - 1 <= F.size(results)) & spare.isNotNull(), _swapped(out, spare, F.get(pool, place - 1))).otherwise(out)

    few = (F.size(results) < 2) | (F.size(said) < 2) | (F.size(wanted) < 2)
    return F.when(few, results).otherwise(F.aggregate(wanted, results, step))


def _merge(base: Column, extra: Column, k: int, most: int) -> Column:
    """Add rewritten queries' hits source by source, up to ``most`` items each; swap where the list is full.

    ``extra``: (name, row) in the order of the names.  A source that has enough, or can swap nothing, is done.
    """

    def step(state: Column, hit: Column) -> Column:
        out, name, row = state["out"], hit["name"], hit["row"]
        over = state["done"].eqNullSafe(name)
        enough = F.size(F.filter(out, lambda x: F.contains(x["source"], name))) >= most
        held = F.exists(out, lambda x: x["ord"] == row["ord"])
        full = F.size(out) >= k
        spare = _last_spare(out, F.size(base), most)
        add = ~over & ~enough & ~held
        new = F.when(add & ~full, F.concat(out, F.array(row))).when(add & full & spare.isNotNull(), _swapped(out, spare, row)).otherwise(out)
        done = F.when(over | enough | (add & full & spare.isNull()), name).otherwise(state["done"])
        return F.struct(new.alias("out"), done.alias("done"))

    return F.aggregate(extra, F.struct(base.alias("out"), F.lit(None).cast("string").alias("done")), step)["out"]


def _ranked(folded: DataFrame) -> DataFrame:
    return folded.select("query_id", F.posexplode("out").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.ord")


def coverage(rows: DataFrame) -> DataFrame:
    """``rows``: query_id, part ('result' or 'pool'), place, ord, source, exact, names, present (named sources that the corpus has)."""
    per = rows.groupBy("query_id").agg(_list(F.col("part") == "result").alias("results"), _list(F.col("part") == "pool").alias("pool"), F.first("names").alias("names"), F.first("present").alias("present"))
    return _ranked(per.select("query_id", _cover(F.col("results"), F.col("pool"), F.col("names"), F.col("present")).alias("out")))


def rewrites(rows: DataFrame, k: int = 5, most: int = 2) -> DataFrame:
    """``rows``: query_id, part ('base' or a source's name), place, ord, source, exact, names."""
    row = F.struct(F.col("place").cast("int").alias("place"), F.col("ord").cast("long").alias("ord"), "source", "exact")
    hits = F.array_sort(F.collect_list(F.when(F.col("part") != "base", F.struct(F.array_position("names", F.col("part")).alias("o"), F.col("place").cast("int").alias("place"), F.col("part").alias("name"), row.alias("row")))))
    per = rows.groupBy("query_id").agg(_list(F.col("part") == "base").alias("base"), hits.alias("hits"))
    extra = F.transform(F.filter("hits", lambda h: h["o"] > 0), lambda h: F.struct(h["name"], h["row"]))
    return _ranked(per.select("query_id", _merge(F.col("base"), extra, k, most).alias("out")))
