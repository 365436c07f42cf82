"""Chunking, manifests, lint and comparison of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import canon, text
from ..functions.canon import canon_sql
from ..operators import chunking, lint, passages
from ..sources import read

MARKDOWN = table(
    "source string, text string",
    ("民法典.md", "# 民法典\n\n序言一段。\n\n## 第一编 总则\n\n### 第一章 一般规定\n\n第一条 为了保护民事主体。\n\n续段说明。\n\n第二条 调整平等主体。\n\n---\n\n## 第二编 物权\n\n### 第一章 一般规定\n\n第九百六十条 适用委托的规定。\n\n# 附则\n\n第九百六十六条 适用委托的规定。"),
    ("公司法.md", "第一条 没有标题的条文。\n\n# 公司法\n\nArticle 12 English body\n\n  \n\n只是内容"),
    ("empty.md", ""),
)
OUTLINE = table("source string, n int, bian string, zhang string, jie string", ("a", 1, "编一", "章一", None), ("a", 2, "编一", "章一", "节一"), ("a", 3, "编一", "章二", "节一"), ("a", 4, "编二", "章二", "节一"), ("b", 1, None, "章一", None), ("b", 2, None, "章一", None))
PATHS = table("id int, chapter string, document string", (1, "民法典 > 第一编 > 第一章", "正文"), (2, "民法典", "正文"), (3, None, "正文"), (4, "甲 > 乙", "x"), (5, "", "y"))


#: Fixed value: a line that begins a numbered text.
ARTICLE_LINE = r"(?m)^第[一二三四五六七八九十百千万零0-9]+条"


def chunk_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(MARKDOWN.df(spark))


_TRIM = f"'^{text.WS}+|{text.WS}+$', '', 'g'"
_LEVELS = range(1, 7)
_P = ", ".join(f"coalesce(max(CASE WHEN level = {n} THEN pos END) OVER u, -1) AS p{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER u AS t{n}" for n in _LEVELS)
_PATH = ", ".join(f"CASE WHEN p{n} > " + (f"greatest({', '.join(f'p{u}' for u in range(1, n))}, -1)" if n > 1 else "-1") + f" THEN t{n} END" for n in _LEVELS)
CHUNK_OUTLINE = f"""WITH src AS {MARKDOWN.sql()},
parts AS (SELECT source, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT source, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: regexp_replace(p, {_TRIM})), lambda p: p <> '' AND p <> '---') AS l FROM src)),
kinds AS (SELECT *, length(regexp_extract(block, '^(#{{1,6}})\\s+(.*)$', 1)) AS level, regexp_extract(block, '^(#{{1,6}})\\s+(.*)$', 2) AS title,
  coalesce(nullif(regexp_extract(block, '{chunking.ARTICLE}'), ''), nullif(regexp_extract(block, '{chunking.ARTICLE_EN}'), '')) AS a FROM parts),
k AS (SELECT source, block, pos, level, CASE WHEN level > 0 THEN title END AS title, CASE WHEN level = 0 THEN a END AS art FROM kinds),
w AS (SELECT *, {_P}, count(CASE WHEN level > 0 OR art IS NOT NULL THEN 1 END) OVER u AS g FROM k WINDOW u AS (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, nullif(concat_ws(' > ', {_PATH}), '') AS path, max(art) OVER (PARTITION BY source, g) IS NOT NULL AS inside FROM w),
c AS (SELECT source, g, CASE WHEN inside THEN -1 ELSE pos END AS c, min(pos) AS pos, max(level) AS level, max(art) AS article_no, min_by(path, pos) AS chapter, max(title) AS title, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS body FROM x GROUP BY ALL),
d AS (SELECT *, CASE WHEN level > 0 THEN title ELSE body END AS document FROM c)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY pos) - 1)::INTEGER AS ord, CASE WHEN level > 0 THEN 'heading' WHEN article_no IS NOT NULL THEN 'article' ELSE 'content' END AS kind, article_no, chapter, document,
  concat_ws(chr(10), CASE WHEN chapter IS NULL THEN NULL WHEN strpos(chapter, ' > ') > 0 THEN substr(chapter, strpos(chapter, ' > ') + 3) ELSE chapter END, document) AS embed_text, substr(sha1(document), 1, 16) AS hash FROM d"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, one block a line."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    c = chunking.chunk(d, separator="\n")
    return c.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "content").alias("content"), F.sum(F.char_length("document")).alias("chars"), F.min("hash").alias("least_hash"))


CHUNK_DOCUMENTS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), b AS (SELECT doc_id, regexp_replace(raw, {_TRIM}) AS block FROM l),
k AS (SELECT doc_id, block, regexp_extract(block, '^(#{{1,6}})\\s+(.*)$', 1) <> '' AS head FROM b WHERE block <> '' AND block <> '---')
SELECT doc_id::VARCHAR AS source, count(*) AS chunks, count(*) FILTER (WHERE NOT head) AS content, sum(length(block))::BIGINT AS chars, min(substr(sha1(block), 1, 16)) AS least_hash FROM k GROUP BY doc_id"""


def chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints that several lines share."""
    b = chunking.blocks(read(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return b.groupBy(text.fingerprint(F.col("block")).alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).filter("n > 1")


CHUNK_FINGERPRINT = f"""WITH b AS (SELECT doc_id, regexp_replace(raw, {_TRIM}) AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents))
SELECT substr(sha1(block), 1, 16) AS hash, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b WHERE block <> '' AND block <> '---' GROUP BY 1 HAVING count(*) > 1"""


def embed_text_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATHS.df(spark).select("id", chunking.path_prefix(F.col("chapter")).alias("prefix"), chunking.embed_text(F.col("chapter"), F.col("document")).alias("embed_text"))


EMBED_TEXT_PREFIX = f"""WITH p AS (SELECT id, document, CASE WHEN chapter IS NULL OR chapter = '' THEN NULL WHEN strpos(chapter, ' > ') > 0 THEN substr(chapter, strpos(chapter, ' > ') + 3) ELSE chapter END AS prefix FROM {PATHS.sql()})
SELECT id, prefix, concat_ws(chr(10), prefix, document) AS embed_text FROM p"""


def emit_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.outline_changes(OUTLINE.df(spark), "source", "n", ["bian", "zhang", "jie"])


EMIT_OUTLINE = f"""WITH o AS {OUTLINE.sql()}, d AS (SELECT *, bian IS DISTINCT FROM lag(bian) OVER w AS c1, zhang IS DISTINCT FROM lag(zhang) OVER w AS c2, jie IS DISTINCT FROM lag(jie) OVER w AS c3 FROM o WINDOW w AS (PARTITION BY source ORDER BY n))
SELECT source, n, 1 AS level, bian AS title FROM d WHERE c1 AND bian IS NOT NULL UNION ALL SELECT source, n, 2, zhang FROM d WHERE (c1 OR c2) AND zhang IS NOT NULL UNION ALL SELECT source, n, 3, jie FROM d WHERE (c1 OR c2 OR c3) AND jie IS NOT NULL"""


#: Documents whose hashes are put together in one row.
RUN = 1000


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, bytes, lines, lines that begin with a number, and a hash.

    The hash is of the hashes of runs of ids, each of its documents' hashes in id order, so a large source is never in one row.
    """
    d = read(spark, sf_dir, "documents")
    numbered = F.regexp_count("text", F.lit(ARTICLE_LINE))
    per = d.select("source", "doc_id", F.floor(F.col("doc_id") / RUN).alias("run"), F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n")).alias("lines"), numbered.alias("articles"), F.sha1(F.col("text").cast("binary")).alias("h"))
    sums = [F.sum(c).alias(c) for c in ("bytes", "lines", "articles")]
    joined = lambda k: F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda x: x["h"]), "").cast("binary"))
    runs = per.groupBy("source", "run").agg(F.count("*").alias("documents"), *sums, joined("doc_id").alias("h"))
    return runs.groupBy("source").agg(F.sum("documents").alias("documents"), *sums, joined("run").alias("hash"))


CORPUS_MANIFEST = f"""WITH r AS (SELECT source, doc_id // {RUN} AS run, count(*) AS documents, sum(strlen(text)) AS bytes, sum(len(string_split(text, chr(10)))) AS lines, sum(len(regexp_extract_all(text, '{ARTICLE_LINE}'))) AS articles, sha1(string_agg(sha1(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2)
SELECT source, sum(documents)::BIGINT AS documents, sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines, sum(articles)::BIGINT AS articles, sha1(string_agg(h, '' ORDER BY run)) AS hash FROM r GROUP BY source"""


def lint_dup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers (position in the document) that one source uses more than once for the same first line."""
    d = read(spark, sf_dir, "documents").select("source", F.md5(F.split("text", "\n")[0].cast("binary")).alias("head"))
    return lint.duplicate_keys(d, "source", "head")


LINT_DUP_KEY = "SELECT source, md5(split_part(text, chr(10), 1)) AS head, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1"


def lint_dup_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.duplicate_bodies(read(spark, sf_dir, "documents"), "text", "doc_id", "source")


LINT_DUP_BODY = """SELECT sha1(text) AS hash, count(DISTINCT doc_id) AS items, min(doc_id) AS first_item, CASE WHEN count(DISTINCT source) < count(DISTINCT doc_id) THEN 'error' ELSE 'warn' END AS severity
FROM documents WHERE length(text) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1"""


def lint_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = chunking.blocks(read(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return lint.short_bodies(b, "block").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("block").alias("least"))


LINT_SHORT = f"""WITH b AS (SELECT doc_id, regexp_replace(raw, {_TRIM}) AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents))
SELECT doc_id, count(*) AS n, min(block) AS least FROM b WHERE block <> '' AND block <> '---' AND length(block) < 12 GROUP BY doc_id"""


def lint_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.sequence_breaks(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "doc_id")


LINT_SEQUENCE = """WITH d AS (SELECT source, doc_id, doc_id - lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS step FROM documents)
SELECT source, doc_id, step, CASE WHEN step <= 0 THEN 'error' ELSE 'warn' END AS severity, greatest(step - 1, 0) AS missing FROM d WHERE step <= 0 OR step > 1"""


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.missing_numbers(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


MISSING_IDS = """WITH d AS (SELECT source, doc_id, coalesce(lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id), 0) AS before FROM (SELECT DISTINCT source, doc_id FROM documents))
SELECT source, before + 1 AS first, doc_id - 1 AS last FROM d WHERE doc_id > before + 1"""


def cross_source_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the next by name, aligned by number (here: tens of ids): equal in the comparison form, different, or only in one."""
    d = read(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 10).alias("n"), F.md5(canon.canon(F.col("text")).cast("binary")).alias("c"))
    d = d.groupBy("source", "n").agg(F.min("c").alias("c"))
    follows = d.select("source").distinct().withColumn("other", F.lead("source").over(Window.orderBy("source"))).filter("other is not null")  # one row per source
    a = d.join(follows, "source").select("source", "n", F.col("c").alias("a"))
    b = d.withColumnRenamed("source", "other").join(follows, "other").select("source", "n", F.col("c").alias("b"))
    state = F.when(F.col("a").isNull(), "only second").when(F.col("b").isNull(), "only first").when(F.col("a") == F.col("b"), "equal").otherwise("different")
    return a.join(b, ["source", "n"], "full").select("source", "n", state.alias("state"))


CROSS_SOURCE_DIFF = f"""WITH d AS (SELECT source, doc_id // 10 AS n, min(md5({canon_sql('text')})) AS c FROM documents GROUP BY 1, 2), f AS (SELECT source, lead(source) OVER (ORDER BY source) AS other FROM (SELECT DISTINCT source FROM documents)),
a AS (SELECT source, n, c AS a FROM d JOIN f USING (source) WHERE other IS NOT NULL), b AS (SELECT f.source, n, c AS b FROM d JOIN f ON f.other = d.source)
SELECT source, n, CASE WHEN a IS NULL THEN 'only second' WHEN b IS NULL THEN 'only first' WHEN a = b THEN 'equal' ELSE 'different' END AS state FROM a FULL JOIN b USING (source, n)"""


def outline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which two outlines differ."""
    o = OUTLINE.df(spark)
    a, b = (o.filter(F.col("source") == s).select("n", F.col("zhang").alias(c)) for s, c in (("a", "left_title"), ("b", "right_title")))
    return a.join(b, "n", "full").filter(~F.col("left_title").eqNullSafe(F.col("right_title"))).select("n", "left_title", "right_title")


OUTLINE_DIFF = f"""WITH o AS {OUTLINE.sql()}, a AS (SELECT n, zhang AS left_title FROM o WHERE source = 'a'), b AS (SELECT n, zhang AS right_title FROM o WHERE source = 'b')
SELECT n, left_title, right_title FROM a FULL JOIN b USING (n) WHERE left_title IS DISTINCT FROM right_title"""


def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page: hidden parts and tags gone, block ends as lines, spaces unified, blank runs collapsed."""
    t = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|td|th|ul|ol|table|article|section|nav)>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(text.unescape(t), r"[ \t\x{3000}\x{00A0}]+", " "), r" ?\n[ \n]*", "\n")
    return read(spark, sf_dir, "pages").select("page_id", text.trim_ws(t).alias("text"))


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', '', 'g'), '(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|td|th|ul|ol|table|article|section|nav)>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"
_HTML = f"regexp_replace({_HTML}, '&amp;?', '&', 'g')"
STRIP_HTML = rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t\x{{3000}}\x{{00A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), {_TRIM}) AS text FROM pages"


def stale_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages and how many documents hold them verbatim, white space aside."""
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = passages.holders(read(spark, sf_dir, "documents"), b, "doc_id", "text", "item_id", "text")
    return b.select("item_id").join(hits, F.col("item_id") == F.col("item"), "left").groupBy("item_id").agg(F.count("doc").alias("documents"))


STALE_GROUND_TRUTH = f"""WITH b AS (SELECT item_id, regexp_replace(text, '{text.WS}', '', 'g') AS p FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '{text.WS}', '', 'g') AS t FROM documents)
SELECT item_id, count(doc_id) AS documents FROM b LEFT JOIN d ON contains(t, p) GROUP BY item_id"""

QUERIES = {
    f.__name__: f
    for f in (chunk_outline, chunk_documents, chunk_fingerprint, embed_text_prefix, emit_outline, corpus_manifest, lint_dup_key, lint_dup_body, lint_short, lint_sequence, missing_ids, cross_source_diff, outline_diff, strip_html, stale_ground_truth)
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
