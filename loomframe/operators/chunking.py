"""Structure-aware chunking: blocks, heading paths, numbered articles.

Everything is windows over (source, position): which headings are open at a block,
and which article a continuation belongs to.  Only one document's blocks share a
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, trim_ws

#: How a block of each kind begins.
HEADING = r"^(#{1,6})\s+(.*)$"
ARTICLE = r"^第[一二三四五六七八九十百千万零0-9]+条"
ARTICLE_EN = r"^Article\s+[0-9]+"
LEVELS = range(1, 7)


def blocks(docs: DataFrame, key: str, text: str, separator: str = r"\n{2,}") -> DataFrame:
    """key, pos, block: trimmed parts of each text, without empty ones and rules."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), separator), trim_ws)
    return docs.select(key, F.posexplode(F.filter(parts, lambda p: (p != "") & (p != "---"))).alias("pos", "block"))


def heading_path(at_level: dict[int, Column], titles: dict[int, Column]) -> Column:
    """Open headings outermost first: one at a level stands unless a shallower one came after it."""
    shown = []
    for level in LEVELS:
        above = [at_level[u] for u in LEVELS if u < level]
        last = F.greatest(*above, F.lit(-1), F.lit(-1)) if above else F.lit(-1)
        shown.append(F.when(at_level[level] > F.coalesce(last, F.lit(-1)), titles[level]))
    path = F.concat_ws(" > ", *shown)
    return F.when(path != "", path)


def chunk(docs: DataFrame, key: str = "source", text: str = "text", separator: str = r"\n{2,}") -> DataFrame:
    """key, ord, kind, article_no, chapter, document, embed_text, hash."""
    b = blocks(docs, key, text, separator)
    level = F.length(F.regexp_extract("block", HEADING, 1))
    article = F.coalesce(F.nullif(F.regexp_extract("block", ARTICLE, 0), F.lit("")), F.nullif(F.regexp_extract("block", ARTICLE_EN, 0), F.lit("")))
    b = b.withColumn("level", level).withColumn("title", F.when(level > 0, trim_ws(F.regexp_extract("block", HEADING, 2)))).withColumn("art", F.when(level == 0, article))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for n in LEVELS:
        own = F.col("level") == n
        b = b.withColumn(f"p{n}", F.coalesce(F.max(F.when(own, F.col("pos"))).over(upto), F.lit(-1))).withColumn(f"t{n}", F.last(F.when(own, F.col("title")), ignorenulls=True).over(upto))
    b = b.withColumn("chapter", heading_path({n: F.col(f"p{n}") for n in LEVELS}, {n: F.col(f"t{n}") for n in LEVELS}))
    opens = (F.col("level") > 0) | F.col("art").isNotNull()
    b = b.withColumn("g", F.count(F.when(opens, 1)).over(upto))
    b = b.withColumn("in_article", F.coalesce(F.max(F.when(F.col("art").isNotNull(), F.lit(1))).over(Window.partitionBy(key, "g")), F.lit(0)) == 1)
    b = b.withColumn("c", F.when(F.col("in_article"), F.lit(-1)).otherwise(F.col("pos")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])
    out = b.groupBy(key, "g", "c").agg(
        F.min("pos").alias("pos"), F.max("level").alias("level"), F.max("art").alias("article_no"), F.min_by("chapter", "pos").alias("chapter"), F.max("title").alias("title"), F.array_join(parts, "\n\n").alias("document"))
    out = out.withColumn("document", F.when(F.col("level") > 0, F.col("title")).otherwise(F.col("document")))
    kind = F.when(F.col("level") > 0, "heading").when(F.col("article_no").isNotNull(), "article").otherwise("content")
    order = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return out.select(key, order.alias("ord"), kind.alias("kind"), "article_no", "chapter", "document", embed_text(F.col("chapter"), F.col("document")).alias("embed_text"), fingerprint(F.col("document")).alias("hash"))


def path_prefix(chapter: Column) -> Column:
    """The path without its outermost part, unless that is all there is."""
    parts = F.split(chapter, " > ")
    kept = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return F.when(chapter.isNotNull() & (chapter != ""), F.nullif(F.array_join(kept, " > "), F.lit("")))


def embed_text(chapter: Column, document: Column) -> Column:
    return F.concat_ws("\n", path_prefix(chapter), document)


def outline_changes(rows: DataFrame, key: str, order: str, levels: list[str]) -> DataFrame:
    """key, order, level (1 up), title: a heading wherever a level or one above it differs from the row before."""
    w = Window.partitionBy(key).orderBy(order)
    changed, out = F.lit(False), []
    for i, c in enumerate(levels):
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
        out.append(F.struct(F.lit(i + 1).alias("level"), F.when(changed, F.col(c)).alias("title")))
    heads = rows.select(key, order, F.array(*out).alias("h")).select(key, order, F.explode("h").alias("h"))
    return heads.select(key, order, F.col("h.level").alias("level"), F.col("h.title").alias("title")).filter("title is not null")


__all__ = ["blocks", "chunk", "embed_text", "outline_changes", "path_prefix"]
