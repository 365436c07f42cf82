"""Decisions, verdicts and citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import citations, decisions, topk, verdicts
from ..sources import read
from .parsing import _fold_sql, _tokens
from .retrieval import _PINS, items, questions
from ..functions import text

VERDICTS = table(
    "id int, raw string",
    (1, '{"answerable": true, "requirements": [{"law": "民法典", "articleNo": 577, "quote": "当事人一方不履行合同义务"}], "reason": "ok"}'),
    (2, '```json\n{"answerable": false, "reason": "缺少公司法", "missing": "公司法第二十三条"}\n```'),
    (3, 'text {"answerable": true, "law": "公司法", "articleNo": "第二十三条"} tail'),
    (4, '{"answerable": "true"}'), (5, "nothing here"), (6, ""), (7, '{"answerable": true, "requirements": []}'), (8, '{"answerable": true, "requirements": {"law": "x"}}'),
    (9, '{"answerable": true, "requirements": [{"law": "民法典"}]}'), (10, '{"answerable": tru'), (11, "[1]"), (12, '{"answerable": true, "requirements": [{"law": "民法典", "articleNo": "20"}, {"law": "民法典", "articleNo": 20}, {"law": "刑法", "articleNo": "民法典第181条"}]}'),
    (13, '{"answerable": true, "requirements": [1, 2, 3, 4, 5, 6, 7]}'), (14, '{"answerable": false, "requirements": [{"law": "民法典", "articleNo": 3}], "reason": "x"}'), (15, None),
)
RETRIEVED = table(
    "id int, rank int, source string, number int, document string",
    (1, 0, "民法典.md", 576, "第五百七十六条 一方不履行"), (1, 1, "民法典.md", 577, "第五百七十七条 当事人一方不履行 合同义务的，应当承担违约责任"), (2, 0, "民法典.md", 577, "第五百七十七条"), (3, 0, "公司法.md", 24, "第二十四条"),
    (12, 0, "中华人民共和国民法典.md", 20, "第二十条"), (12, 1, "民法典.md", 20, "第二十条 又"), (14, 0, "民法典.md", 3, "第三条"),
)
SIM = table(
    "id int, n_hits int, has_exact boolean, abstained boolean, reason string, outcome string, answerable boolean, binding string",
    (1, 0, False, True, "no_hits", "skipped", None, None), (2, 3, True, False, "answered", "skipped", None, None), (3, 3, False, True, "below_threshold", "skipped", None, None), (4, 3, False, False, "answered", "judged", True, "in_context"),
    (5, 3, False, False, "answered", "judged", False, "not_applicable"), (6, 3, False, False, "answered", "judged", True, "not_in_context"), (7, 3, False, False, "answered", "binding_mismatch", True, "not_in_context"),
    (8, 3, False, True, "below_threshold", "parse_failure", None, None), (9, 3, False, False, "answered", "error", None, None),
)
STORE = table("source string, number int", ("民法典.md", 577), ("民法典.md", 23), ("民法典.md", 1), ("民法典.md", 2), ("公司法.md", 23), ("公司法.md", 3))
REPLIES = table(
    "id int, a string",
    (1, "依据民法典第577条，当事人一方不履行合同义务的应当承担违约责任。公司法第二十三条另有规定！"), (2, "依照第九百九十九条处理。第23条。"), (3, "民法典第一条规定股东可以查阅公司章程和会议记录。"), (4, "没有引用"), (5, "刑法第一条；公司法第二条。"),
)
CONTEXT = table(
    "id int, rank int, source string, number int, document string",
    (1, 0, "民法典.md", 577, "第五百七十七条 当事人一方不履行合同义务或者履行合同义务不符合约定的，应当承担违约责任"), (1, 1, "民法典.md", 23, "第二十三条 无民事行为能力人的监护人是其法定代理人"),
    (2, 0, "公司法.md", 3, "第三条 依照第二十三条的规定"), (3, 0, "民法典.md", 1, "第一条 为了保护民事主体的合法权益"), (3, 1, "公司法.md", 23, "第二十三条 股东可以查阅公司章程和会议记录的规定"), (5, 0, "民法典.md", 1, "第一条 目的"),
)


def abstain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, x = questions(spark, sf_dir, 1), items(spark, sf_dir)
    top = topk.hybrid(q, x, 5).join(q.select("query_id", F.col("query_id").alias("own")), "query_id").filter("ord <> own")
    return decisions.abstain(q, top, "query_id").withColumn("top_score", F.round("top_score", 6))


ABSTAIN_DECISION = f"""WITH {_PINS}, h AS (SELECT query_id, vec_id, boosted, exact FROM b WINDOW w AS (PARTITION BY query_id ORDER BY exact DESC, boosted DESC, vec_id) QUALIFY row_number() OVER w <= 5),
a AS (SELECT q.query_id, count(h.vec_id) AS n, coalesce(max(boosted), 0) AS top_score, coalesce(bool_or(exact), false) AS has_exact FROM q LEFT JOIN h ON h.query_id = q.query_id AND h.vec_id <> q.query_id GROUP BY q.query_id)
SELECT query_id, round(top_score, 6) AS top_score, has_exact, n = 0 OR (top_score < 0.35 AND NOT has_exact) AS abstained, CASE WHEN n = 0 THEN 'no_hits' WHEN top_score < 0.35 AND NOT has_exact THEN 'below_threshold' ELSE 'answered' END AS reason FROM a"""


def judge_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIM.df(spark).select("id", decisions.skip_reason(F.col("n_hits"), F.col("has_exact"), F.col("abstained")).alias("skip_reason"))


JUDGE_SKIP = f"SELECT id, CASE WHEN n_hits = 0 THEN 'no_hits' WHEN has_exact THEN 'exact_article_hit' WHEN abstained THEN 'sim_abstain' END AS skip_reason FROM {SIM.sql()}"


def merge_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = decisions.merge(*(F.col(c) for c in ("abstained", "reason", "outcome", "answerable", "binding")))
    return SIM.df(spark).select("id", a.alias("abstained"), r.alias("reason"))


MERGE_DECISION = f"""SELECT id, CASE WHEN outcome = 'judged' AND binding <> 'not_in_context' THEN NOT answerable ELSE abstained END AS abstained,
CASE WHEN outcome = 'binding_mismatch' OR (outcome = 'judged' AND binding = 'not_in_context') THEN 'judge_binding_mismatch' WHEN outcome = 'judged' AND answerable THEN 'answered' WHEN outcome = 'judged' THEN 'judge_unanswerable'
WHEN outcome = 'parse_failure' THEN 'judge_parse_failure' WHEN outcome = 'error' THEN 'judge_error_fallback' ELSE reason END AS reason FROM {SIM.sql()}"""


def _parsed(spark: SparkSession) -> DataFrame:
    return verdicts.parse(VERDICTS.df(spark), "id", "raw")


def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array_join(F.transform("requirements", lambda r: F.concat_ws("#", r["source"], r["number"].cast("string"))), ",")
    return _parsed(spark).select("id", "error", "answerable", named.alias("requirements"), "reason", "missing")


_TRIM = f"'^{text.WS}+|{text.WS}+$', '', 'g'"
_NAME = "regexp_replace(regexp_replace(replace({c}, '中华人民共和国', ''), '[《》\\s]', '', 'g'), '\\.md$', '', 'i')"


def _field(x: str, name: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{name}') = 'VARCHAR' THEN nullif(regexp_replace(json_extract_string({x}, '$.{name}'), {_TRIM}), '') END"


_VERDICTS = f"""raw AS (SELECT id, regexp_replace(coalesce(raw, ''), {_TRIM}) AS t FROM {VERDICTS.sql()}),
fence AS (SELECT *, regexp_extract(t, '^```(?:json)?\\s*\\n?([\\s\\S]*?)\\n?```$', 1) AS f, regexp_extract(t, '(?s)\\{{.*\\}}') AS braces FROM raw),
body AS (SELECT id, t, CASE WHEN f <> '' THEN regexp_replace(f, {_TRIM}) WHEN starts_with(t, '{{') THEN t ELSE nullif(braces, '') END AS b FROM fence),
j AS MATERIALIZED (SELECT *, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM body),
k AS MATERIALIZED (SELECT *, json_type(j) AS kind, json_type(j, '$.answerable') AS flag, json_type(j, '$.requirements') AS list FROM j),
item AS MATERIALIZED (SELECT row_number() OVER () AS rid, id, i, x, one, {_field('x', 'law')} AS source, {_field('x', 'quote')} AS quote, json_type(x, '$.articleNo') AS nk, json_extract_string(x, '$.articleNo') AS ns FROM (
  SELECT id, unnest(json_extract(j, '$.requirements[*]')) AS x, generate_subscripts(json_extract(j, '$.requirements[*]'), 1) AS i, false AS one FROM k WHERE list = 'ARRAY' UNION ALL SELECT id, j, 1, true FROM k WHERE kind = 'OBJECT' AND list IS NULL)),
hit AS MATERIALIZED (SELECT row_number() OVER () AS hid, rid, raw, ref FROM (SELECT rid, regexp_replace(ns, {_TRIM}) AS raw, false AS ref FROM item WHERE nk = 'VARCHAR' UNION ALL SELECT rid, unnest(regexp_extract_all(ns, '{text.REFERENCE}')), true FROM item WHERE nk = 'VARCHAR')),
{_fold_sql('hit', 'hid', 'raw')},
spelled AS (SELECT rid, max(CASE WHEN NOT ref AND value > 0 THEN value END) AS n, CASE WHEN count(DISTINCT CASE WHEN ref AND value > 0 THEN value END) = 1 THEN max(CASE WHEN ref AND value > 0 THEN value END) END AS only FROM hit JOIN folded USING (hid) GROUP BY rid),
r AS MATERIALIZED (SELECT item.*, coalesce(CASE WHEN nk IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND ns::DOUBLE = floor(ns::DOUBLE) AND ns::DOUBLE > 0 THEN ns::DOUBLE::BIGINT END, s.n, s.only) AS number FROM item LEFT JOIN spelled s USING (rid)),
held AS (SELECT * FROM r WHERE NOT one OR (source IS NOT NULL AND number IS NOT NULL)),
tally AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE source IS NULL OR number IS NULL) AS bad FROM held GROUP BY id),
v AS MATERIALIZED (SELECT k.id, CASE WHEN t = '' THEN 'empty' WHEN b IS NULL THEN 'no object' WHEN j IS NULL THEN 'not json' WHEN kind <> 'OBJECT' THEN 'not an object' WHEN flag IS DISTINCT FROM 'BOOLEAN' THEN 'answerable is no boolean'
  WHEN list IS NOT NULL AND list <> 'ARRAY' THEN 'requirements is no list' WHEN list = 'ARRAY' AND coalesce(n, 0) > {verdicts.MOST} THEN 'too many requirements' WHEN bad > 0 THEN 'bad requirement' WHEN json_extract_string(j, '$.answerable') = 'true' AND coalesce(n, 0) = 0 THEN 'nothing named' END AS error,
  json_extract_string(j, '$.answerable') = 'true' AS answerable, coalesce({_field('j', 'reason')}, '') AS reason, {_field('j', 'missing')} AS missing FROM k LEFT JOIN tally USING (id)),
req AS MATERIALIZED (SELECT h.id, row_number() OVER (PARTITION BY h.id ORDER BY h.i) - 1 AS i, h.source, h.number, h.quote FROM (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY id, source, number ORDER BY i) = 1) h JOIN v ON v.id = h.id AND v.error IS NULL)"""
PARSE_VERDICT = f"""WITH RECURSIVE {_VERDICTS}
SELECT id, error, CASE WHEN error IS NULL THEN answerable END AS answerable, CASE WHEN error IS NULL THEN coalesce((SELECT string_agg(source || '#' || number, ',' ORDER BY i) FROM req WHERE req.id = v.id), '') END AS requirements,
  CASE WHEN error IS NULL THEN reason END AS reason, CASE WHEN error IS NULL THEN missing END AS missing FROM v"""


def cross_check_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = verdicts.cross_check(_parsed(spark), RETRIEVED.df(spark), "id")
    return c.select("id", "binding", F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched"), F.array_join("unmatched", ",").alias("unmatched"), "quotes_found", "named_anyway")


def _bare(c: str) -> str:
    return _NAME.replace("{c}", c)


_BOUND = f"""{_VERDICTS},
got AS MATERIALIZED (SELECT id, rank, {_bare('source')} AS have, number, regexp_replace(document, '{text.WS}', '', 'g') AS doc FROM {RETRIEVED.sql()}),
named AS (SELECT id, i, source AS want, {_bare('source')} AS w, number, regexp_replace(quote, '{text.WS}', '', 'g') AS quote FROM req),
met AS (SELECT n.*, g.rank, g.doc FROM named n LEFT JOIN got g ON g.id = n.id AND g.number = n.number AND n.w <> '' AND g.have <> '' AND (contains(n.w, g.have) OR contains(g.have, n.w)) QUALIFY row_number() OVER (PARTITION BY n.id, n.i ORDER BY g.rank) = 1),
per AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE rank IS NULL) AS misses, string_agg(coalesce(rank, -1)::VARCHAR, ',' ORDER BY i) AS matched, string_agg(want || '#' || number, ',' ORDER BY i) FILTER (WHERE rank IS NULL) AS unmatched,
  bool_and(coalesce(contains(doc, quote), false)) FILTER (WHERE length(quote) >= {verdicts.QUOTE_FROM}) AS quotes FROM met GROUP BY id),
bound AS MATERIALIZED (SELECT v.id, v.answerable, v.reason, v.missing, CASE WHEN NOT answerable THEN 'not_applicable' WHEN misses > 0 THEN 'not_in_context' ELSE 'in_context' END AS binding, CASE WHEN answerable THEN matched ELSE '' END AS matched,
  CASE WHEN answerable THEN coalesce(unmatched, '') ELSE '' END AS unmatched, CASE WHEN answerable AND misses = 0 THEN quotes END AS quotes_found, NOT answerable AND coalesce(n, 0) > 0 AS named_anyway FROM v LEFT JOIN per USING (id) WHERE error IS NULL)"""
CROSS_CHECK_VERDICT = f"WITH RECURSIVE {_BOUND} SELECT id, binding, matched, unmatched, quotes_found, named_anyway FROM bound"


def second_pass_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _parsed(spark).filter("error is null")
    plan = verdicts.second_pass(v, verdicts.cross_check(v, RETRIEVED.df(spark), "id"), RETRIEVED.df(spark), ["民法典", "公司法"], "id")
    return plan.select("id", F.array_join("planned", ",").alias("planned"))


SECOND_PASS_PLAN = f"""WITH RECURSIVE {_BOUND}, corpus(law, o) AS (VALUES ('民法典', 0), ('公司法', 1)),
want AS (SELECT b.id, {_bare('m.source')} AS law, m.i AS o FROM bound b JOIN (SELECT req.*, met.rank FROM req JOIN met USING (id, i)) m ON m.id = b.id AND m.rank IS NULL WHERE b.binding = 'not_in_context'
  UNION ALL SELECT b.id, c.law, 100 + c.o FROM bound b JOIN corpus c ON contains(concat_ws(' ', coalesce(b.missing, ''), b.reason), c.law) WHERE NOT b.answerable AND NOT EXISTS (SELECT 1 FROM got WHERE got.id = b.id AND got.have = c.law)),
plan AS (SELECT id, law, min(o) AS o FROM want WHERE law IN (SELECT law FROM corpus) GROUP BY id, law), kept AS (SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) <= 2)
SELECT b.id, coalesce((SELECT string_agg(law, ',' ORDER BY o) FROM kept p WHERE p.id = b.id), '') AS planned FROM bound b"""


def expand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source plus those of the next by name whose text is not there yet."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("h"))
    follows = d.select("source").distinct().withColumn("base", F.lag("source").over(Window.orderBy("source"))).filter("base is not null")  # one row per source
    base = d.select(F.col("source").alias("base"), "doc_id", "h")
    extra = d.join(follows, "source").select("base", "doc_id", "h").join(base.select("base", "h").distinct(), ["base", "h"], "left_anti")
    return base.unionByName(extra)


EXPAND_CONTEXT = """WITH d AS (SELECT doc_id, source, sha1(text) AS h FROM documents), f AS (SELECT source, lag(source) OVER (ORDER BY source) AS base FROM (SELECT DISTINCT source FROM documents)), b AS (SELECT source AS base, doc_id, h FROM d)
SELECT base, doc_id, h FROM b UNION ALL SELECT f.base, d.doc_id, d.h FROM d JOIN f USING (source) WHERE f.base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.base = f.base AND b.h = d.h)"""


def _checks(spark: SparkSession) -> DataFrame:
    return citations.verify(REPLIES.df(spark), STORE.df(spark), CONTEXT.df(spark), "id", "a")


def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark).select("id", "number", "law", "status", "exists", "in_context", F.array_join("sources", ",").alias("sources"), F.array_join("found_in", ",").alias("found_in"), "ambiguous")


def content_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark).filter("own is not null").select("id", "number", "own", "best_other", (F.col("status") == "content_mismatch").alias("mismatch"))


def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.report(_checks(spark), "id")


def _grams_sql(column: str) -> str:
    p = text.PAIRS_CITATION.replace('\\"', '"').replace("'", "''")
    return f"regexp_replace({column}, '{p}', '', 'g')"


_NORM = "regexp_replace(regexp_replace(replace({c}, '中华人民共和国', ''), '[《》\\s]', '', 'g'), '\\.md$', '', 'i')"
_CHECKED = f"""{_tokens(REPLIES, 'a')},
keyed AS (SELECT id, i, clause, regexp_replace(tok, '\\s+', '', 'g') AS spelling, id * 1000 + i AS rid FROM t WHERE kind = 'ref'),
{_fold_sql('keyed', 'rid', 'spelling')},
refs AS (SELECT k.id, k.i, k.clause, value AS number FROM keyed k JOIN folded USING (rid) WHERE value > 0),
named AS (SELECT r.*, (SELECT max_by(n.tok, n.i) FROM t n WHERE n.kind = 'name' AND n.id = r.id AND n.clause = r.clause AND n.i < r.i) AS law,
  (SELECT string_agg(c.tok, '' ORDER BY c.i) FROM t c WHERE c.id = r.id AND c.clause = r.clause AND c.kind <> 'end') AS sentence FROM refs r),
cit AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY id, coalesce(law, ''), number ORDER BY i) = 1),
store AS (SELECT source, number, {_NORM.format(c='source')} AS s FROM {STORE.sql()}),
ctx AS MATERIALIZED (SELECT *, {_NORM.format(c='source')} AS s, {_grams_sql('document')} AS body FROM {CONTEXT.sql()}),
crefs AS (SELECT id AS cid, rank, source, s, hit, row_number() OVER () AS rid FROM (SELECT id, rank, source, s, unnest(regexp_extract_all(document, '{text.REFERENCE}')) AS hit FROM ctx)),
{_fold_sql('crefs', 'rid', 'hit', '2')},
seen AS (SELECT cid AS id, source, s, value AS number FROM crefs JOIN folded2 USING (rid) UNION SELECT id, source, s, number FROM ctx),
a AS (SELECT c.*, c.law IN (SELECT s FROM store) AND c.law IS NOT NULL AS scoped FROM cit c),
b AS (SELECT a.*, EXISTS (SELECT 1 FROM store st WHERE st.number = a.number AND (NOT scoped OR st.s = a.law)) AS present,
  coalesce((SELECT string_agg(DISTINCT st.source, ',' ORDER BY st.source) FROM store st WHERE st.number = a.number), '') AS sources,
  coalesce((SELECT string_agg(DISTINCT x.source, ',' ORDER BY x.source) FROM seen x WHERE x.id = a.id AND x.number = a.number AND (NOT scoped OR x.s = a.law)), '') AS found_in,
  NOT scoped AND (SELECT count(*) FROM store st WHERE st.number = a.number) > 1 AS ambiguous FROM a),
g AS MATERIALIZED (SELECT *, CASE WHEN NOT present THEN 'fabricated' WHEN found_in <> '' THEN 'verified' ELSE 'not_in_context' END AS basic, {_grams_sql('sentence')} AS grams FROM b),
cov AS (SELECT g.id, g.i, x.rank, x.number = g.number AND (g.law IS NULL OR x.s = g.law) AS may,
  len(list_intersect(list_distinct(list_transform(range(1, length(g.grams)), lambda k: substr(g.grams, k::BIGINT, 2))), list_distinct(list_transform(range(1, length(x.body)), lambda k: substr(x.body, k::BIGINT, 2)))))::DOUBLE
  / greatest(len(list_distinct(list_transform(range(1, length(g.grams)), lambda k: substr(g.grams, k::BIGINT, 2)))), 1) AS cov FROM g JOIN ctx x ON x.id = g.id WHERE g.basic = 'verified'),
own AS (SELECT id, i, min(rank) FILTER (WHERE may) AS r FROM cov GROUP BY id, i),
fit AS (SELECT c.id, c.i, max(cov) FILTER (WHERE rank = r) AS own, coalesce(max(cov) FILTER (WHERE rank <> r), 0) AS best_other FROM cov c JOIN own USING (id, i) WHERE r IS NOT NULL GROUP BY c.id, c.i),
z AS (SELECT g.*, fit.own, fit.best_other, CASE WHEN basic = 'verified' AND own IS NOT NULL AND len(list_distinct(list_transform(range(1, length(grams)), lambda k: substr(grams, k::BIGINT, 2)))) >= 8 AND best_other - own >= 0.1 AND best_other >= 0.25 AND own <= 0.35 THEN 'content_mismatch' ELSE basic END AS status FROM g LEFT JOIN fit USING (id, i))"""
VERIFY_CITATIONS = f"WITH RECURSIVE {_CHECKED} SELECT id, number, law, status, present AS exists, found_in <> '' AS in_context, sources, found_in, ambiguous FROM z"
CONTENT_MISMATCH = f"WITH RECURSIVE {_CHECKED} SELECT id, number, round(own, 6) AS own, round(best_other, 6) AS best_other, status = 'content_mismatch' AS mismatch FROM z WHERE own IS NOT NULL"
CITATION_REPORT = f"""WITH RECURSIVE {_CHECKED} SELECT id, count(*) AS total, count(*) FILTER (WHERE status = 'fabricated') AS fabricated, count(*) FILTER (WHERE status = 'content_mismatch') AS content_mismatch,
count(*) FILTER (WHERE status = 'not_in_context') AS not_in_context, count(*) FILTER (WHERE status = 'verified') AS verified, bool_or(status <> 'verified') AS has_problem FROM z GROUP BY id"""

QUERIES = {f.__name__: f for f in (abstain_decision, judge_skip, merge_decision, parse_verdict, cross_check_verdict, second_pass_plan, expand_context, verify_citations, content_mismatch, citation_report)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
