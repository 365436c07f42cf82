"""Files as tables: Markdown corpora, JSON lines, manifests, prompts; and table sinks that replace whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """source (file name), text: each ``.md`` file whole, in a defined order by name.  A missing folder or one without such a file is an error."""
    d = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    if not d.inputFiles():
        raise FileNotFoundError(f"no Markdown file in {path}")
    return d.select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("source"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a bad line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tolerant: an unreadable manifest is a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, modified of each Markdown file."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def without_front_matter(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?\n", ""))


def next_version(previous: DataFrame, current_hash: DataFrame) -> DataFrame:
    """version, hash: one up where the hash changed, else as before; 1 at first."""
    p = previous.select(F.col("version").alias("v"), F.col("hash").alias("h"))
    joined = current_hash.join(p, how="left")
    return joined.select(F.when(F.col("v").isNull(), 1).when(F.col("h") == F.col("hash"), F.col("v")).otherwise(F.col("v") + 1).cast("int").alias("version"), "hash")


def json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
