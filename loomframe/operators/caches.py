"""Caches as tables: lookup, misses, pruning, eviction and incremental upsert."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(keys: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its value and where it was found: ``first``, else ``second``, else a miss."""
    a = first.select(key, F.col(value).alias("_a"))
    b = second.select(key, F.col(value).alias("_b"))
    state = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("miss")
    return keys.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("_a", "_b").alias(value), state.alias("state"))


def prune(cache: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Entries that this run has seen; all of them if it saw none."""
    any_seen = seen.agg((F.count("*") > 0).alias("_any"))
    flagged = cache.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    return flagged.join(F.broadcast(any_seen)).filter(F.coalesce("_seen", F.lit(False)) | ~F.col("_any")).drop("_seen", "_any")


def keep_newest(cache: DataFrame, at: str, most: int, tie: str, per: str | None = None) -> DataFrame:
    """The ``most`` newest entries, of each ``per`` if given."""
    if per is None:
        return cache.orderBy(F.desc(at), tie).limit(most)
    w = Window.partitionBy(per).orderBy(F.desc(at), tie)
    return cache.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def upsert(have: DataFrame, come: DataFrame, key: str) -> DataFrame:
    """What is there, and what of ``come`` is new by key (the first row of each new key)."""
    return have.unionByName(come.join(have.select(key), key, "left_anti").dropDuplicates([key]))


def whole(cache: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the right length, and one row with how many others were dropped."""
    fits = F.coalesce(F.size(vector) == dim, F.lit(False))
    return cache.filter(fits), cache.agg(F.count_if(~fits).alias("dropped"))


def read(spark, path: str, schema: str) -> DataFrame:
    """A stored cache; an empty one if it is missing or cannot be read."""
    try:
        return spark.read.schema(schema).parquet(path).select("*")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def store(cache: DataFrame, path: str) -> None:
    """Replace a stored cache: written whole beside the old one, then moved into its place, so a reader sees either."""
    spark = cache.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, staged, old = hadoop(path), hadoop(f"{path}.staged"), hadoop(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    for p in (staged, old):
        fs.delete(p, True)
    cache.write.parquet(staged.toString())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(staged, target):
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def without_source(index: DataFrame, source: str) -> DataFrame:
    """An index after one source is taken out; hashes that only it had are free again."""
    return index.filter(~F.col("source").eqNullSafe(F.lit(source)))


def good_items(history: DataFrame, item: str) -> DataFrame:
    """Entries that are JSON objects; others are skipped."""
    return history.withColumn("_v", F.try_parse_json(item)).filter(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))).drop("_v")
