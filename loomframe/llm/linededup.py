"""Line dedup by site-relative frequency.

Lines are counted once per page within their host; a line is boilerplate if it
stands on more than ``ratio`` of the host's pages.  It must repeat: by default a line of
a single page is none, however few pages the host has (``least`` = 2 pages; a caller may ask for more).  A page has few lines, so a host has at most (lines per page) / ratio such
lines: they travel as one short array per host, which is joined to the host's
pages.  The pages themselves are not exploded or regrouped, and a host that
holds a third of all rows is only split, never gathered: counts are summed before
the shuffle, and its pages stay where they were read.

Lines are compared by 96 bits of hash of their trimmed text.

Defined cases: a null text has no lines and stays null; empty lines are always
kept and never counted; a line that repeats within a page counts once; pages of
a null host form a host; hosts with fewer than ``least`` pages lose nothing; a
page may end up empty but is never removed; rows that repeat or lack an id are pages of
their own; a line at exactly the ratio stays; a very long page is one array of its lines
in one task; extra columns are dropped unless named in ``keep``; an empty table gives no rows.

Copies.  Where pages may be copies of one another, ``copies`` names their key.
Equal texts of a host then count as one page, so a line is not boilerplate because
one page was copied often.  Near copies still share their lines: of the pages
that are boilerplate by at least ``MOSTLY`` of their characters, the one of smallest
key that holds a line keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import write_shared

#: Fixed patterns of HTML: what is not shown, what ends a line, what is only dropped.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|hr|tr|td|th|table|article|section|nav|header|footer|main|aside|blockquote|pre|form|title|body|html)\b[^>]*>|[\r\n]+"
TAG = r"<[^>]*>"

#: Share of a page's characters in boilerplate lines from which it may be a near copy rather than a page with boilerplate.
MOSTLY = 0.5


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def visible_lines(html: Column) -> Column:
    """The page's text with one line per block element."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def _first_holders(base: DataFrame, often: DataFrame, copies: str) -> DataFrame:
    """__h, __id, __spare: the boilerplate lines that a page keeps as the first of those that are mostly boilerplate."""
    lines = F.transform(F.filter(F.split("__text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(_key(x).alias("key"), F.char_length(F.trim(x)).alias("n")))
    held = base.join(often, F.col("__host").eqNullSafe(F.col("__h"))).select("__h", F.col(copies).alias("__id"), "__drop", lines.alias("line"))
    held = held.withColumn("gone", F.filter("line", lambda x: F.array_contains("__drop", x["key"])))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    mostly = held.filter((F.size("gone") > 0) & (chars("gone") >= MOSTLY * chars("line")) & F.col("__id").isNotNull())
    first = mostly.select("__h", "__id", F.explode(F.array_distinct(F.transform("gone", lambda x: x["key"]))).alias("key")).groupBy("__h", "key").agg(F.min("__id").alias("__id"))
    return first.groupBy("__h", "__id").agg(F.collect_list("key").alias("__spare"))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = 0.2, least: int = 2, keep: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """The ``keep`` columns, host, n_lines, n_dropped and the text without its boilerplate lines.

    ``copies``: one of ``keep``, the key of pages that may be copies of one another.
    """
    base = pages.select(*keep, F.col(host).alias("__host"), F.col(text).alias("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(x) != "")
    count = F.count_distinct(F.col("__copy")) if copies else F.count("*")
    told = base.withColumn("__copy", F.xxhash64("__text")) if copies else base
    seen = told.select("__host", *(["__copy"] if copies else []), F.explode(F.array_distinct(F.transform(lines, _key))).alias("key")).groupBy("__host", "key").agg(count.alias("n"))
    total = told.groupBy("__host").agg(count.alias("pages")).withColumnRenamed("__host", "h")
    often = seen.filter(F.col("n") >= least).join(total, F.col("__host").eqNullSafe(F.col("h"))).filter(F.col("n") > ratio * F.col("pages"))
    # written out, so that Spark knows its size: it is broadcast if small, else a hot host's pages are split over tasks
    often = write_shared(often.groupBy(F.col("h").alias("__h")).agg(F.collect_list("key").alias("__drop")), "boilerplate")
    split = F.split("__text", "\n")
    dropped = lambda x: F.array_contains("__drop", _key(x))
    out = base.join(often, F.col("__host").eqNullSafe(F.col("__h")), "left")
    if copies:
        spare = write_shared(_first_holders(base, often, copies).withColumnRenamed("__h", "__s"), "spared")
        out = out.join(spare, F.col("__host").eqNullSafe(F.col("__s")) & (F.col(copies) == F.col("__id")), "left")
        dropped = lambda x: F.array_contains("__drop", _key(x)) & ~F.coalesce(F.array_contains("__spare", _key(x)), F.lit(False))
    kept = F.when(F.col("__drop").isNull(), split).otherwise(F.filter(split, lambda x: (F.trim(x) == "") | ~dropped(x)))
    out = out.withColumn("__kept", kept).withColumn("__n", F.size(lines))
    none = F.col("__text").isNull()
    return out.select(
        *keep,
        F.col("__host").alias(host),
        F.when(none, 0).otherwise(F.col("__n")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size(split) - F.size("__kept")).cast("long").alias("n_dropped"),
        F.array_join("__kept", "\n").alias(text),
    )
