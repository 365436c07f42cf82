"""Injected defects, what catches them, answer quality by citations, and second passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import text
from ..operators import citations, defects
from ..sources import read
from .audit import _CHECKED, _checks
from .parsing import _fold_sql, pairs_sql, strip_sql

_C1 = "[1] 来源：民法典.md#第五条 | 章节：甲 | 条号：第五条 | 相关度：0.900\n自然人满八周岁的期间为三年。\n\n---\n\n[2] 来源：公司法.md#第九条 | 条号：第九条\n公司解散的应当清算。"
_C2 = "[1] 来源：民法典.md | 条号：第二十条\n期限为三十日，自知道之日起计算。\n\n---\n\n[2] 来源：民法典.md | 条号：第二十一条\n股东查阅章程。\n\n---\n\n[3] 来源：民法典.md | 条号：第二十二条\n期限为三十日，自知道之日起算。"
_C3 = "[1] 来源：民法典.md | 条号：第30条\n完全一样的正文。\n\n---\n\n[2] 来源：民法典.md | 条号：第31条\n完全一样的正文。"
ANSWERED = table(
    "id int, answer string, context string, corpus string",
    (1, "依据第5条，期间为三年，八周岁以上。第5条仍适用。", _C1, "第五条 x 第一百条 y 公示催告 人民调解委员会调解"), (2, "依据第二十条，期限为三十日。", _C2, "没有"), (3, "依据第30条。", _C3, "第30条 仲裁前置 人民调解委员会调解 公示催告"),
    (4, "没有引用", "（本地知识库未检索到相关条文）", ""), (5, "见第九十九条", _C1, "第2条 人民调解委员会调解"),
)
MUTANTS = table(
    "id int, kind string, needle string", (1, "fabricated_cite", "877"), (1, "article_swap", "第9条"), (2, "fabricated_cite", "778"), (2, "article_swap", "第二十一条"), (3, "unsupported_append", "公示催告"), (4, "article_swap", "第三十一条"), (5, "distorted_number", "十年"), (6, "article_swap", "第七条"),
)
CHECKS = table(
    "id int, kind string, i int, number long, status string",
    (1, "fabricated_cite", 0, 5, "verified"), (1, "fabricated_cite", 1, 877, "fabricated"), (1, "article_swap", 0, 9, "not_in_context"), (2, "fabricated_cite", 0, 778, "not_in_context"), (2, "article_swap", 0, 21, "content_mismatch"), (2, "article_swap", 1, 21, "verified"),
    (3, "unsupported_append", 0, 877, "fabricated"), (4, "article_swap", 0, 31, "verified"), (5, "distorted_number", 0, 10, "fabricated"),
)
ORIGINALS = table("id int, total int, verified int, content_mismatch int", (1, 3, 2, 0), (2, 2, 1, 1), (3, 0, 0, 0), (4, 4, 4, 0))
JUDGED = table("id string, claims int, supported int, failed boolean", ("a", 4, 4, False), ("b", 3, 2, False), ("c", 0, 0, False), ("d", None, None, True), ("e", 5, 1, False), ("f", 3, 2, False))
VERDICTS = table("id string, verdicts array<string>, failed boolean", ("a", ["supported", "supported"], False), ("b", ["supported", "unsupported"], False), ("c", [], False), ("d", ["supported"], True))
MATCHED = table("id int, rank int, score double", (1, 0, 0.7), (1, 2, 0.4), (2, -1, None), (2, 1, 0.55), (3, -1, None))
FIRST = table("id int, outcome string, answerable boolean, chunks int, tokens int, latency int", (1, "judged", False, 5, 100, 900), (2, "judged", False, 5, 110, 800), (3, "binding_mismatch", True, 5, 120, 700), (4, "error", None, 5, 0, 600), (5, "judged", False, 5, 90, 500), (6, "judged", True, 5, 80, 400))
SECOND = table("id int, outcome string, answerable boolean, chunks int, tokens int, latency int", (1, "judged", True, 7, 140, 1000), (2, "parse_failure", None, 7, 130, 1100), (3, "judged", True, 6, 125, 900), (4, "judged", True, 7, 1, 1), (5, "judged", True, 5, 2, 2))
GATES = table("name string, has_truth boolean, value double, floor double", ("overall", True, 0.96, 0.95), ("lookup", True, 0.9, 0.95), ("ood", False, None, 0.5), ("typo", None, None, 0.5), ("fine", True, 1.0, 1.0))
RUNS = table("category string, ranks array<int>, abstained boolean", ("lookup", [1, 0], False), ("lookup", [2], True), ("ood", [], True), ("ood", [], False), ("ood", [], True))


def inject_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.mutants(ANSWERED.df(spark), "id", "answer", "context", "corpus")


_BLOCKS = f"""src AS {ANSWERED.sql()},
cut AS (SELECT id, unnest(string_split(context, chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS b, generate_subscripts(string_split(context, chr(10) || chr(10) || '---' || chr(10) || chr(10)), 1) AS pos FROM src),
blk AS (SELECT id, pos, regexp_extract(h, '来源：([^\\s|]+)', 1) AS source, regexp_extract(h, '条号：([^\\s|]+)', 1) AS raw, regexp_replace(substr(b, length(h) + 2), '^{text.WS}+|{text.WS}+$', '', 'g') AS body FROM (SELECT *, split_part(b, chr(10), 1) AS h FROM cut)),
said AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT id, 'answer' AS part, generate_subscripts(regexp_extract_all(answer, '{text.REFERENCE}'), 1) AS pos, unnest(regexp_extract_all(answer, '{text.REFERENCE}')) AS raw FROM src
  UNION ALL SELECT id, 'corpus', 0, unnest(regexp_extract_all(corpus, '{text.REFERENCE}')) FROM src
  UNION ALL SELECT id, 'block', pos, nullif(regexp_extract(raw, '{text.REFERENCE}'), '') FROM blk WHERE source <> '')),
{_fold_sql('said', 'rid', 'raw')},
num AS (SELECT s.*, regexp_replace(raw, '\\s+', '', 'g') AS spelling, value AS n FROM said s LEFT JOIN folded USING (rid)),
b AS MATERIALIZED (SELECT blk.id, blk.pos, split_part(source, '#', 1) AS file, blk.raw, n, {strip_sql('body', text.PAIRS_PLAIN)} AS plain FROM blk JOIN num ON part = 'block' AND num.id = blk.id AND num.pos = blk.pos),
pairs AS MATERIALIZED (SELECT *, {pairs_sql('plain')} AS g FROM b),
origin AS (SELECT id, arg_min(n, pos) AS n, arg_min(spelling, pos) AS spelling FROM num a WHERE part = 'answer' AND n > 0 AND EXISTS (SELECT 1 FROM b WHERE b.id = a.id AND b.n = a.n) GROUP BY id),
own AS (SELECT o.*, (SELECT arg_min(file, pos) FROM b WHERE b.id = o.id AND b.n = o.n) AS file, (SELECT arg_min(g, pos) FROM pairs p WHERE p.id = o.id AND p.n = o.n) AS g FROM origin o),
goal AS (SELECT o.id, o.spelling, p.n, p.raw, row_number() OVER (PARTITION BY o.id ORDER BY p.file = o.file, CASE WHEN p.file = o.file THEN sim END NULLS FIRST, p.pos) AS r, p.file = o.file AND sim >= {defects.DISSIMILAR} AS unfit
  FROM own o JOIN (SELECT *, 0 AS z FROM pairs WHERE n IS NOT NULL) p ON p.id = o.id AND p.n <> o.n, LATERAL (SELECT CASE WHEN len(o.g) = 0 OR len(p.g) = 0 THEN 0 ELSE len(list_intersect(o.g, p.g))::DOUBLE / len(list_distinct(list_concat(o.g, p.g))) END AS sim))"""


def _quoted(s: str) -> str:
    return "'" + s.replace("\n", "' || chr(10) || '") + "'"


_SWAPPED = " ".join(f"WHEN strpos(answer, '{a}') > 0 AND strpos(context, '{a}') > 0 THEN ['{b}', replace(answer, '{a}', '{b}')]" for a, b in defects.SWAPS)
_ADDED = " ".join(f"WHEN strpos(corpus, '{p}') = 0 THEN ['{p}', answer || {_quoted(chr(10) * 2 + s)}]" for p, s in defects.APPENDS)
INJECT_DEFECTS = f"""WITH RECURSIVE {_BLOCKS},
most AS (SELECT id, max(n) + {defects.FAKE_OFFSET} AS fake FROM num WHERE part = 'corpus' AND n > 0 GROUP BY id),
swap AS (SELECT id, spelling, CASE WHEN regexp_matches(spelling, '^第[0-9]+条$') OR raw = '' THEN '第' || n || '条' ELSE raw END AS needle FROM goal WHERE r = 1 AND NOT unfit),
m AS (SELECT src.id, answer, 'fabricated_cite' AS kind, fake::VARCHAR AS needle, answer || {_quoted(defects.FAKE_SENTENCE[0])} || fake || '{defects.FAKE_SENTENCE[1]}' AS altered FROM src JOIN most USING (id)
  UNION ALL SELECT id, answer, 'distorted_number', x[1], x[2] FROM (SELECT *, CASE {_SWAPPED} END AS x FROM src)
  UNION ALL SELECT src.id, answer, 'article_swap', needle, replace(answer, spelling, needle) FROM src JOIN swap USING (id)
  UNION ALL SELECT id, answer, 'unsupported_append', x[1], x[2] FROM (SELECT *, CASE {_ADDED} END AS x FROM src))
SELECT id, kind, needle, altered FROM m WHERE altered <> answer"""


def swap_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to cite in place of the right one: of another source first, else the least similar if it is dissimilar."""
    d = ANSWERED.df(spark).withColumn("refs", text.references(F.col("answer"))).withColumn("blocks", defects.blocks(F.col("context")))
    return defects.swap_target(d).filter("goal is not null").select("id", "origin.spelling", F.col("goal.number").alias("number"))


SWAP_TARGET = f"WITH RECURSIVE {_BLOCKS} SELECT id, spelling, n AS number FROM goal WHERE r = 1 AND NOT unfit"


def citation_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.citation_catch(MUTANTS.df(spark), CHECKS.df(spark), "id").select("id", "kind", "status", "caught")


_NEEDLE = f"""src AS (SELECT row_number() OVER () AS rid, *, CASE WHEN kind = 'article_swap' THEN nullif(regexp_extract(needle, '{text.REFERENCE}', 1), '') END AS raw FROM {MUTANTS.sql()}),
{_fold_sql('src', 'rid', 'raw')},
m AS (SELECT src.*, CASE WHEN kind = 'fabricated_cite' THEN TRY_CAST(needle AS BIGINT) ELSE value END AS number FROM src LEFT JOIN folded USING (rid)), c AS {CHECKS.sql()}"""
CITATION_CATCH = f"""WITH RECURSIVE {_NEEDLE}, h AS (SELECT m.id, m.kind, (SELECT arg_min(c.status, c.i) FROM c WHERE c.id = m.id AND c.kind = m.kind AND c.number = m.number) AS status FROM m)
SELECT id, kind, status, coalesce(CASE kind WHEN 'fabricated_cite' THEN status = 'fabricated' WHEN 'article_swap' THEN status <> 'verified' END, false) AS caught FROM h"""


def citation_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the originals and those wrongly marked; swapped numbers, and how many the content rule or any status catches."""
    o = ORIGINALS.df(spark).agg(F.sum("total").alias("originals"), F.sum("content_mismatch").alias("false_positives"))
    swaps = defects.citation_catch(MUTANTS.df(spark), CHECKS.df(spark), "id").filter("kind = 'article_swap'")
    s = swaps.agg(F.count("*").alias("swaps"), F.count_if("by_content").alias("detected"), F.count_if("by_any").alias("caught_any"))
    return o.crossJoin(s).withColumn("rate", F.round(F.try_divide("detected", "swaps"), 6))  # one row each


CITATION_CALIBRATION = f"""WITH RECURSIVE {_NEEDLE}, s AS (SELECT m.rid, count(*) FILTER (WHERE c.status = 'content_mismatch') > 0 AS d, count(*) FILTER (WHERE c.status <> 'verified') > 0 AS a FROM m LEFT JOIN c ON c.id = m.id AND c.kind = m.kind AND c.number = m.number WHERE m.kind = 'article_swap' GROUP BY m.rid)
SELECT (SELECT sum(total) FROM {ORIGINALS.sql()})::BIGINT AS originals, (SELECT sum(content_mismatch) FROM {ORIGINALS.sql()})::BIGINT AS false_positives, count(*) AS swaps, count(*) FILTER (WHERE d) AS detected, count(*) FILTER (WHERE a) AS caught_any,
round(count(*) FILTER (WHERE d)::DOUBLE / nullif(count(*), 0), 6) AS rate FROM s"""


def citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of each answer, the gravest first, then by number and place."""
    return citations.by_severity(_checks(spark), "id").select("id", "place", "number", "status")


CITATION_ORDER = f"""WITH RECURSIVE {_CHECKED} SELECT id, row_number() OVER (PARTITION BY id ORDER BY list_position(['fabricated', 'content_mismatch', 'not_in_context', 'verified'], status), number, coalesce(law, '')) AS place, number, status FROM z"""


def citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified share of all citations, over the answers that cite at all."""
    o = ORIGINALS.df(spark).filter("total > 0")
    return o.agg(F.count("*").alias("cited"), F.sum("total").alias("total"), F.sum("verified").alias("verified"), F.round(F.try_divide(F.sum("verified"), F.sum("total")), 6).alias("accuracy"))


CITATION_ACCURACY = f"SELECT count(*) AS cited, sum(total)::BIGINT AS total, sum(verified)::BIGINT AS verified, round(sum(verified)::DOUBLE / nullif(sum(total), 0), 6) AS accuracy FROM {ORIGINALS.sql()} WHERE total > 0"


def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with an unsupported claim, the least faithful first."""
    j = JUDGED.df(spark).filter(~F.col("failed") & (F.col("claims") > 0)).withColumn("faithfulness", F.round(F.col("supported") / F.col("claims"), 6)).filter("faithfulness < 1")
    place = F.row_number().over(Window.orderBy("faithfulness", "id"))  # an inline table of a few answers
    return j.select(place.alias("place"), "id", "faithfulness")


WORST_FIRST = f"SELECT row_number() OVER (ORDER BY supported::DOUBLE / claims, id) AS place, id, round(supported::DOUBLE / claims, 6) AS faithfulness FROM {JUDGED.sql()} WHERE NOT failed AND claims > 0 AND supported < claims"


def clean_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by their claims: caught if any is unsupported, fit to calibrate on if there are claims and all are supported."""
    c = VERDICTS.df(spark)
    caught = F.exists("verdicts", lambda v: v == "unsupported")
    return c.select("id", caught.alias("caught"), (~F.col("failed") & (F.size("verdicts") > 0) & F.forall("verdicts", lambda v: v == "supported")).alias("clean"))


CLEAN_BASE = f"SELECT id, list_contains(verdicts, 'unsupported') AS caught, NOT failed AND len(verdicts) > 0 AND len(list_filter(verdicts, lambda v: v <> 'supported')) = 0 AS clean FROM {VERDICTS.sql()}"


def named_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score of what a verdict names and the context has; null if it has none."""
    return MATCHED.df(spark).groupBy("id").agg(F.min(F.when(F.col("rank") >= 0, F.col("score"))).alias("named"))


NAMED_SCORE = f"SELECT id, min(score) FILTER (WHERE rank >= 0) AS named FROM {MATCHED.sql()} GROUP BY id"


def second_pass_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.merge_passes(FIRST.df(spark), SECOND.df(spark), "id")


SECOND_PASS_MERGE = f"""WITH j AS (SELECT f.*, s.outcome AS o, s.answerable AS a, s.chunks AS c, s.tokens AS t, s.latency AS l, coalesce(f.outcome IN ('judged', 'binding_mismatch') AND s.chunks > f.chunks, false) AS second FROM {FIRST.sql()} f LEFT JOIN {SECOND.sql()} s ON s.id = f.id)
SELECT id, second, CASE WHEN u THEN o ELSE outcome END AS outcome, CASE WHEN u THEN a ELSE answerable END AS answerable, CASE WHEN u THEN c ELSE chunks END AS chunks, tokens + CASE WHEN second THEN t ELSE 0 END AS tokens, latency + CASE WHEN second THEN l ELSE 0 END AS latency
FROM (SELECT *, second AND o IN ('judged', 'binding_mismatch') AS u FROM j)"""


def gate_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates' exit code: 1 if one is missed, or names a category that is unknown or has no ground truth."""
    g = GATES.df(spark)
    bad = ~F.coalesce("has_truth", F.lit(False)) | F.coalesce(F.col("value") < F.col("floor"), F.lit(True))
    return g.agg(F.max(bad.cast("int")).alias("code"), F.count_if(bad).alias("missed"))


GATE_EXIT = f"SELECT max((NOT coalesce(has_truth, false) OR coalesce(value < floor, true))::INT) AS code, count(*) FILTER (WHERE NOT coalesce(has_truth, false) OR coalesce(value < floor, true)) AS missed FROM {GATES.sql()}"


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by category; a category without ground truth has only its share of refusals.  The total counts rows with ground truth."""
    r = RUNS.df(spark).withColumn("hit", F.exists("ranks", lambda x: (x > 0) & (x <= 5)).cast("double")).withColumn("truth", F.size("ranks") > 0)
    out = [F.count("*").alias("n"), F.when(F.bool_or("truth"), F.round(F.avg("hit"), 6)).alias("hit_5"), F.round(F.avg(F.col("abstained").cast("double")), 6).alias("refused")]
    return r.groupBy("category").agg(*out).unionByName(r.filter("truth").groupBy(F.lit("overall").alias("category")).agg(*out))


_METRICS = "count(*) AS n, CASE WHEN bool_or(len(ranks) > 0) THEN round(avg((len(list_filter(ranks, lambda x: x BETWEEN 1 AND 5)) > 0)::INT), 6) END AS hit_5, round(avg(abstained::INT), 6) AS refused"
METRIC_TABLE = f"SELECT category, {_METRICS} FROM {RUNS.sql()} GROUP BY category UNION ALL SELECT 'overall', {_METRICS} FROM {RUNS.sql()} WHERE len(ranks) > 0"


def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each benchmark passage's character pairs that its five documents, put end to end, hold.

    A pair may straddle two documents.  A passage's documents are those of the five ids from its own on.
    """
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    near = b.select("item_id", F.explode(F.sequence(F.col("item_id"), F.col("item_id") + 4)).alias("doc_id"))
    d = near.join(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")), "doc_id")
    whole = d.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "").alias("hay"))
    g = b.join(whole, "item_id", "left").select("item_id", text.char_pairs(F.col("text"), text.PAIRS_SIGNAL).alias("q"), text.char_pairs(F.coalesce("hay", F.lit("")), text.PAIRS_SIGNAL).alias("h"))
    return g.select("item_id", F.round(text.coverage(F.col("q"), F.col("h")), 6).alias("coverage"))


QUERY_COVERAGE = f"""WITH h AS (SELECT item_id, string_agg(d.text, '' ORDER BY doc_id) AS hay FROM benchmark b JOIN documents d ON d.doc_id BETWEEN b.item_id AND b.item_id + 4 GROUP BY item_id),
s AS MATERIALIZED (SELECT b.item_id, {strip_sql('b.text', text.PAIRS_SIGNAL)} AS q, {strip_sql("coalesce(h.hay, '')", text.PAIRS_SIGNAL)} AS hay FROM benchmark b LEFT JOIN h USING (item_id)),
g AS MATERIALIZED (SELECT item_id, {pairs_sql('q')} AS q, {pairs_sql('hay')} AS h FROM s)
SELECT item_id, round(CASE WHEN len(q) = 0 OR len(h) = 0 THEN 0 ELSE len(list_intersect(q, h))::DOUBLE / len(q) END, 6) AS coverage FROM g"""

QUERIES = {
    f.__name__: f
    for f in (inject_defects, swap_target, citation_catch, citation_calibration, citation_order, citation_accuracy, worst_first, clean_base, named_score, second_pass_merge, gate_exit, metric_table, query_coverage)
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
