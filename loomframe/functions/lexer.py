"""Names and numbered references of a text, bound clause by clause.

A text becomes one row for each known name, reference and clause end, with the gap of
plain text before it, and one for its own end.  Which names govern a reference then follows from running
counts within the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import KNOWN_SOURCES, REFERENCE, numeral

NAMES = "|".join(sorted(KNOWN_SOURCES, key=lambda n: -len(n)))
#: What ends a clause, and what may stand between coordinated names.
CLAUSE_END = r"[。；;！!？?\n]"
COORDINATION = r"[\s和与及、,，/]"


def tokens(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, i, gap, tok, kind (name, ref, end) and clause of each token; the text's end is one without characters."""
    pattern = rf"(?:{NAMES})|{REFERENCE}|{CLAUSE_END}"
    found = F.arrays_zip(F.split(F.col(col), pattern).alias("gap"), F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0)).alias("tok"))
    t = df.select(key, F.posexplode(found).alias("i", "x")).select(key, "i", "x.gap", F.coalesce("x.tok", F.lit("")).alias("tok"))
    kind = F.when(F.regexp_like("tok", F.lit(f"^(?:{NAMES})$")), "name").when(F.regexp_like("tok", F.lit(f"^{REFERENCE}$")), "ref").otherwise("end")
    t = t.withColumn("kind", kind)
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("clause", F.coalesce(F.count(F.when(F.col("kind") == "end", 1)).over(before), F.lit(0)))


def signals(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, numbers (no name governs them), names, and pairs (null where no name is mentioned)."""
    upto = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = tokens(df, key, col).withColumn("glue", (F.col("kind") == "name") & F.regexp_like("gap", F.lit(f"^{COORDINATION}*$")))
    t = t.withColumn("chain", F.count(F.when(~F.col("glue"), 1)).over(upto))
    within = Window.partitionBy(key, "clause").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    is_name = F.col("kind") == "name"
    t = t.withColumn("last_chain", F.last(F.when(is_name, F.col("chain")), ignorenulls=True).over(within))
    t = t.withColumn("said", F.collect_list(F.when(is_name, F.struct("chain", "tok"))).over(within))
    refs = t.filter("kind = 'ref'").withColumn("number", numeral(F.regexp_replace("tok", r"\s+", ""))).filter("number > 0")
    governing = F.transform(F.filter("said", lambda x: x["chain"] == F.col("last_chain")), lambda x: x["tok"])
    refs = refs.withColumn("by", F.when(F.col("last_chain").isNull(), F.array().cast("array<string>")).otherwise(governing))
    per = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "number", "by"))).alias("r"))
    names = t.filter(is_name).groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"])).alias("names"))
    loose = F.array_distinct(F.transform(F.filter("r", lambda x: F.size(x["by"]) == 0), lambda x: x["number"]))
    pairs = F.array_distinct(F.flatten(F.transform("r", lambda x: F.transform(x["by"], lambda n: F.struct(n.alias("source"), x["number"].alias("number"))))))
    none = F.array().cast("array<struct<source:string,number:bigint>>")
    out = df.select(key).join(per, key, "left").join(names, key, "left")
    return out.select(
        key,
        F.coalesce(loose, F.array().cast("array<bigint>")).alias("numbers"),
        F.coalesce("names", F.array().cast("array<string>")).alias("names"),
        F.when(F.col("names").isNotNull(), F.coalesce(pairs, none)).alias("pairs"),
    )


def citations(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, i, number, spelling, source (nearest name before it in its clause), sentence; the first of each (source, number)."""
    within = Window.partitionBy(key, "clause").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = tokens(df, key, col).withColumn("source", F.last(F.when(F.col("kind") == "name", F.col("tok")), ignorenulls=True).over(within))
    said = F.concat("gap", F.when(F.col("kind") == "end", "").otherwise(F.col("tok")))
    sentence = t.groupBy(key, "clause").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", said.alias("said")))), lambda x: x["said"]), "").alias("sentence"))
    refs = t.filter("kind = 'ref'").withColumn("spelling", F.regexp_replace("tok", r"\s+", "")).withColumn("number", numeral(F.col("spelling"))).filter("number > 0")
    first = F.row_number().over(Window.partitionBy(key, F.coalesce("source", F.lit("")), "number").orderBy("i"))
    return refs.withColumn("n", first).filter("n = 1").join(sentence, [key, "clause"]).select(key, "i", "number", "spelling", "source", "sentence")
