"""Strict parsing of judge output, cross-checks against what was retrieved, and the second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, norm_source, numeral, references, strip_ws, trim_ws

#: Most requirements in a verdict, and the shortest quote worth checking.
MOST, QUOTE_FROM = 6, 6


def json_body(raw: Column) -> Column:
    """What stands in a fence, or from the first brace to the last; null without one."""
    t = trim_ws(raw)
    fenced = F.regexp_extract(t, r"^```(?:json)?\s*\n?([\s\S]*?)\n?```$", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", trim_ws(fenced)).when(F.startswith(t, F.lit("{")), t).when(braces != "", braces)


def number_of(v: Column) -> Column:
    """A positive number from a JSON scalar: an integer, its digits, numerals, or the only reference in a text."""
    whole = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    spelled = F.when(F.schema_of_variant(v) == "STRING", trim_ws(F.try_variant_get(v, "$", "string")))
    only = let(references(spelled), lambda r: F.when(F.size(r) == 1, F.get(r, F.lit(0))["number"]))
    found = F.array(let(whole, lambda w: F.when(w == F.floor(w), w.cast("long"))), numeral(spelled), only)
    return F.get(F.filter(found, lambda n: n > 0), F.lit(0))


def _text(v: Column, path: str) -> Column:
    s = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", trim_ws(F.try_variant_get(v, path, "string")))
    return F.nullif(s, F.lit(""))


def parse(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, error, answerable, reason, missing, requirements (source, number, quote).

    The first rule that fails names the error; a verdict with one has no other fields.
    """
    body = json_body(F.coalesce(F.col(raw), F.lit("")))
    d = df.select(key, trim_ws(F.coalesce(F.col(raw), F.lit(""))).alias("t"), body.alias("body")).withColumn("v", F.try_parse_json("body"))
    d = d.withColumn("kind", F.schema_of_variant("v")).withColumn("req", F.try_variant_get("v", "$.requirements", "variant")).withColumn("req_kind", F.schema_of_variant("req"))
    items = F.try_variant_get("v", "$.requirements", "array<variant>")

    def item(x: Column) -> Column:
        return F.struct(_text(x, "$.law").alias("source"), number_of(F.try_variant_get(x, "$.articleNo", "variant")).alias("number"), _text(x, "$.quote").alias("quote"))

    many = F.transform(items, item)
    one = item(F.col("v"))
    single = F.filter(F.array(one), lambda r: r["source"].isNotNull() & r["number"].isNotNull())
    has_list = F.col("req").isNotNull()
    # the generator keeps the optimiser from copying the parsed items into every use of them
    d = d.withColumn("found", F.when(has_list, many).otherwise(single)).select("*", F.explode(F.array("found")).alias("all"))
    is_list = F.coalesce(F.startswith("req_kind", F.lit("ARRAY")), F.lit(False))
    bad = F.exists("all", lambda r: r["source"].isNull() | r["number"].isNull())
    flag = F.schema_of_variant(F.try_variant_get("v", "$.answerable", "variant")) == "BOOLEAN"
    yes = F.try_variant_get("v", "$.answerable", "boolean")
    error = (
        F.when(F.col("t") == "", "empty").when(F.col("body").isNull(), "no object").when(F.col("v").isNull(), "not json").when(~F.startswith("kind", F.lit("OBJECT")), "not an object")
        .when(~F.coalesce(flag, F.lit(False)), "answerable is no boolean").when(has_list & ~is_list, "requirements is no list").when(is_list & (F.size(items) > MOST), "too many requirements")
        .when(bad, "bad requirement").when(yes & (F.size("all") == 0), "nothing named")
    )
    first = F.filter("all", lambda r, i: F.array_position(F.transform("all", lambda x: F.concat_ws("#", x["source"], x["number"].cast("string"))), F.concat_ws("#", r["source"], r["number"].cast("string"))) == i + 1)
    d = d.withColumn("error", error)
    fine = F.col("error").isNull()
    return d.select(
        key, "error", F.when(fine, yes).alias("answerable"), F.when(fine, F.coalesce(_text(F.col("v"), "$.reason"), F.lit(""))).alias("reason"),
        F.when(fine, _text(F.col("v"), "$.missing")).alias("missing"), F.when(fine, first).alias("requirements"))


def cross_check(verdicts: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """key, binding, matched (first rank of each requirement, -1 if none), unmatched, quotes_found, named_anyway.

    ``retrieved``: key, rank, source, number, document.  Sources match if either name holds the other.
    """
    req = verdicts.select(key, F.posexplode("requirements").alias("i", "r")).select(key, "i", F.col("r.source").alias("want"), F.col("r.number").alias("n"), strip_ws(F.col("r.quote")).alias("quote"))
    got = retrieved.select(F.col(key).alias("k"), "rank", norm_source(F.col("source")).alias("have"), F.col("number").alias("m"), strip_ws(F.col("document")).alias("doc"))
    want = norm_source(F.col("want"))
    named = (want != "") & (F.col("have") != "") & (F.contains(want, F.col("have")) | F.contains("have", want))
    hit = req.join(got, (F.col(key) == F.col("k")) & (F.col("n") == F.col("m")) & named, "left")
    hit = hit.withColumn("first", F.row_number().over(Window.partitionBy(key, "i").orderBy("rank"))).filter("first = 1")
    checkable = F.char_length("quote") >= QUOTE_FROM
    per = hit.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("rank", F.lit(-1)).alias("rank")))), lambda x: x["rank"]).alias("matched"),
        F.count_if(F.col("rank").isNull()).alias("misses"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.struct("i", "want", "n")))), lambda x: F.concat_ws("#", x["want"], x["n"].cast("string"))).alias("unmatched"),
        F.bool_and(F.when(checkable, F.coalesce(F.contains("doc", F.col("quote")), F.lit(False)))).alias("quotes"),
    )
    v = verdicts.filter("error is null").join(per, key, "left")
    none = F.array().cast("array<string>")
    yes = F.col("answerable")
    return v.select(
        key, F.when(~yes, "not_applicable").when(F.col("misses") > 0, "not_in_context").otherwise("in_context").alias("binding"),
        F.when(yes, F.col("matched")).otherwise(F.array().cast("array<int>")).alias("matched"), F.when(yes, F.col("unmatched")).otherwise(none).alias("unmatched"),
        F.when(yes & (F.col("misses") == 0), F.col("quotes")).alias("quotes_found"), (~yes & (F.size("requirements") > 0)).alias("named_anyway"))


def second_pass(verdicts: DataFrame, checks: DataFrame, present: DataFrame, corpus: list[str], key: str, most: int = 2) -> DataFrame:
    """key, planned: corpus sources to ask once more, those that a binding misses first, at most ``most``."""
    names = F.array(*map(F.lit, corpus))
    said = F.concat_ws(" ", F.coalesce("missing", F.lit("")), "reason")
    here = present.groupBy(key).agg(F.collect_set(norm_source(F.col("source"))).alias("here"))
    d = verdicts.join(checks.select(key, "binding", "unmatched"), key).join(here, key, "left")
    missed = F.when(F.col("binding") == "not_in_context", F.transform("unmatched", lambda u: norm_source(F.regexp_extract(u, r"^(.*)#\d+$", 1)))).otherwise(F.array().cast("array<string>"))
    named = F.when(~F.col("answerable"), F.filter(names, lambda n: F.contains(said, n) & ~F.coalesce(F.array_contains("here", n), F.lit(False)))).otherwise(F.array().cast("array<string>"))
    plan = F.array_distinct(F.filter(F.concat(missed, named), lambda n: F.array_contains(names, n)))
    return d.select(key, F.slice(plan, 1, most).alias("planned"))
