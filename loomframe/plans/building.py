"""Corpus building: normal forms, body start, tails; command-line filters and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import canon, text
from ..sources import files, read
from .parsing import _fold_sql

NUMBERS = table("id int, raw string", (1, "五百七十七"), (2, "577"), (3, "两百"), (4, "十"), (5, "一万二千三百"), (6, "甲"), (7, ""), (8, None), (9, "零"), (10, "一百零三"))
LEADS = table("id int, raw string", (1, "第五百七十七条 违约"), (2, "第 12 条"), (3, "依第三条"), (4, "第2十条"), (5, None), (6, ""), (7, "第两百条规定"), (8, "第条"), (9, "第零条"))
HEADINGS = table("id int, raw string", (1, "第一章 总 则"), (2, "第一章　总则"), (3, " 附  则 "), (4, "第十二编"), (5, "第3节 一 般 规 定"), (6, ""), (7, "总则第一章 x"))
MARKS = table("id int, raw string", (1, "甲,乙;丙,丁"), (2, "a,b;c"), (3, "甲,乙,丙,x"), (4, ""), (5, None), (6, "一,,二"))
FORMS = table("id int, raw string", (1, "第一条 为了保护“民事”主体，制定本法。"), (2, "为了保护民事主体制定本法"), (3, "第二章 总则\n第三条：甲、乙"), (4, "第三条 第二章 总则 甲乙"), (5, "Straße (été)"), (6, "Strasse ete"), (7, ""), (8, None), (9, "A-b"), (10, "aB"))
REASONS = table("id int, reason string, score double", (1, "judge_unanswerable", 0.7), (2, "judge_parse_failure", 0.123456), (3, "judge_error_fallback", 0.5), (4, "judge_binding_mismatch", 0.25), (5, "below_threshold", 0.3), (6, "no_hits", 0.0))
PAGES = table(
    "id int, pos int, line string",
    (1, 0, "目录"), (1, 1, "第一章 总则"), (1, 2, "第十五章 附则"), (1, 3, "第一编 总则"), (1, 4, "第一章 一般规定"), (1, 5, ""), (1, 6, "第一条 为了"), (1, 7, "第二条 x"),
    (2, 0, "第一条 a"), (3, 0, "第一章 甲"), (3, 1, "# 第一节 乙"), (3, 2, "第1条 b"), (4, 0, "没有"), (5, 0, "第二章 丙"), (5, 1, ""), (5, 2, "第一条 c"), (6, 0, ""), (6, 1, ""), (6, 2, "第一条"),
)
TAILS = table(
    "id int, a string, b string",
    (1, "第九条 本法自公布之日施行。版权所有 甲", "第九条 本法自公布之日施行。联系我们 乙"), (2, "相同。", "相同。"), (3, "一句。\n二行\n甲", "一句。\n二行\n乙乙"), (4, "完全不同", "毫无共同"), (5, "", "x"), (6, "前缀。后", "前缀。"), (7, "无句号甲", "无句号乙"),
)
CASES = table(
    "id string, category string, kind string, question string", ("a1", "lookup", None, "q1"), ("a2", "lookup", None, "q2"), ("b1", "out_of_domain", "adjacent", "q3"), ("b2", "out_of_domain", None, "q4"), ("c1", "cross", None, "q5"), ("b3", "out_of_domain", "", "q6"),
)
KINDS = table("kind string", ("fabricated_cite",), ("distorted_number",), ("article_swap",), ("unsupported_append",))
MADE = table("id string, kind string", ("a", "fabricated_cite"), ("b", "fabricated_cite"), ("c", "unsupported_append"))
STORE = table("ord int, source string, article_no string", (1, "民法典.md", "第二十三条"), (2, "公司法.md", "第二十三条"), (3, "民法典.md", "第23条"), (4, "公司法.md", None))
ASKED = table("id int, article_no string, source string", (1, "第二十三条", None), (2, "第二十三条", "公司法.md"), (3, "第23条", "公司法.md"), (4, "第一条", None))

PROMPTS = table("id int, raw string", (1, "---\nmodel: x\n---\n你好 {{q}}"), (2, "no settings\n---\nx\n---\n"), (3, "---\r\na: 1\r\n---\r\n text"), (4, ""), (5, "---\nopen"))
PREVIOUS = table("corpus string, version int, hash string", ("same", 3, "a"), ("changed", 7, "b"))
CURRENT = table("corpus string, hash string", ("same", "a"), ("changed", "c"), ("new", "d"))

_B = canon.BUILDER_NUMERALS
_WS = text.WS
_TRIMMED = f"'^{_WS}+|{_WS}+$', '', 'g'"


def builder_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NUMBERS.df(spark).select("id", canon.builder_numeral(F.col("raw")).alias("value"))


BUILDER_NUMERAL = f"WITH RECURSIVE src AS {NUMBERS.sql()}, {_fold_sql('src', 'id', 'raw')} SELECT id, CASE WHEN strpos(raw, '两') = 0 THEN value END AS value FROM folded JOIN src USING (id)"


def leading_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LEADS.df(spark).select("id", canon.leading_number(F.col("raw")).alias("number"))


LEADING_NUMBER = f"""WITH RECURSIVE src AS (SELECT id, nullif(regexp_extract(raw, '^{text.REFERENCE}', 1), '') AS n FROM {LEADS.sql()}), {_fold_sql('src', 'id', 'n')}
SELECT id, value AS number FROM folded"""


def full_width_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation in full width: inline texts, and every document by the hash of its new text."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.md5(canon.full_width(F.col("text")).cast("binary")).alias("text"))
    return MARKS.df(spark).select(F.col("id").cast("string").alias("id"), canon.full_width(F.col("raw")).alias("text")).unionByName(d)


def _wide(c: str) -> str:
    once = f"regexp_replace(replace({c}, ';', '；'), '([{canon.HAN}]),([{canon.HAN}])', '\\1，\\2', 'g')"
    return f"regexp_replace({once}, '([{canon.HAN}]),([{canon.HAN}])', '\\1，\\2', 'g')"


FULL_WIDTH_MARKS = f"SELECT id::VARCHAR AS id, {_wide('raw')} AS text FROM {MARKS.sql()} UNION ALL SELECT 'd' || doc_id, md5({_wide('text')}) FROM documents"


def heading_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HEADINGS.df(spark).select("id", canon.heading(F.col("raw")).alias("heading"))


HEADING_FORM = f"""WITH t AS (SELECT id, regexp_replace(regexp_replace(raw, '{_WS}+', ' ', 'g'), {_TRIMMED}) AS t FROM {HEADINGS.sql()}), m AS (SELECT id, t, regexp_extract(t, '^第[{_B}]+[编章节]') AS n FROM t)
SELECT id, CASE WHEN n = '' THEN replace(t, ' ', '') ELSE trim(n || ' ' || replace(substr(t, length(n) + 1), ' ', '')) END AS heading FROM m"""


def canon_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FORMS.df(spark).select("id", canon.canon(F.col("raw")).alias("canon"))


CANON_FORM = f"SELECT id, {canon.canon_sql('raw')} AS canon FROM {FORMS.sql()}"


def canon_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that agree in the comparison form, by that form."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5(canon.canon(F.col("text")).cast("binary")).alias("canon"))
    return d.groupBy("canon").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


CANON_COMPARE = f"SELECT md5({canon.canon_sql('text')}) AS canon, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a log line and as a tool's answer shows it."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", canon.for_log(t).alias("log"), F.md5(canon.for_tool(t).cast("binary")).alias("tool"))


TRUNCATED_TEXTS = f"""WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g'), {_TRIMMED}) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN '(空)' WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS log,
  md5(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '...[已截断，原长度 ' || length(text) || ' 字符]' ELSE text END) AS tool FROM d"""


def refusal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REASONS.df(spark).select("id", canon.refusal_message(F.col("reason"), F.col("score")).alias("message"))


REFUSAL_MESSAGES = f"""SELECT id, CASE reason WHEN 'judge_unanswerable' THEN '判官判定：检索到的条文回答不了这个问题，进入拒答模式' WHEN 'below_threshold' THEN '检索最高分 ' || printf('%.3f', score) || ' 低于阈值 0.35，进入拒答模式'
WHEN 'no_hits' THEN '检索最高分 ' || printf('%.3f', score) || ' 低于阈值 0.35，进入拒答模式' ELSE '判官未能给出可用判定（' || reason || '），退回相似度规则：最高分 ' || printf('%.3f', score) END AS message FROM {REASONS.sql()}"""


def body_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each page's body: the first numbered line, and the headings numbered one right above it."""
    line = text.trim_ws(F.regexp_replace("line", "^[# ]+", ""))
    kind = rf"^第([{_B}]+)[编章节]{_WS}+[^\s]"
    p = PAGES.df(spark).withColumn("numbered", F.regexp_like("line", F.lit(rf"^第[{_B}]+条({_WS}|$)")))
    p = p.withColumn("opens", F.regexp_like(line, F.lit(kind)) & (canon.builder_numeral(F.regexp_extract(line, kind, 1)) == 1))
    first = p.groupBy("id").agg(F.min(F.when(F.col("numbered"), F.col("pos"))).alias("first")).filter("first is not null")
    above = p.join(first, "id").filter("pos < first")
    blank = above.groupBy("id").agg(F.max(F.when(F.col("line") != "", F.col("pos"))).alias("text_at")).select("id", (F.coalesce("text_at", F.lit(-1)) + 1).alias("top"))
    stop = above.join(blank, "id").filter("pos < top").groupBy("id").agg((F.coalesce(F.max(F.when(~F.col("opens"), F.col("pos"))), F.lit(-1)) + 1).alias("start"))
    out = first.join(blank, "id", "left").join(stop, "id", "left")
    return out.select("id", F.coalesce("start", "top", "first").alias("start"))


BODY_START = f"""WITH RECURSIVE p AS (SELECT *, regexp_replace(ltrim(line, '# '), {_TRIMMED}) AS bare FROM {PAGES.sql()}),
first AS (SELECT id, min(pos) AS first FROM p WHERE regexp_matches(line, '^第[{_B}]+条({_WS}|$)') GROUP BY id),
up(id, n) AS (SELECT id, first FROM first UNION ALL SELECT u.id, u.n - 1 FROM up u JOIN p ON p.id = u.id AND p.pos = u.n - 1 WHERE p.line = ''),
top AS (SELECT id, min(n) AS n FROM up GROUP BY id),
climb(id, n) AS (SELECT id, n FROM top UNION ALL SELECT c.id, c.n - 1 FROM climb c JOIN p ON p.id = c.id AND p.pos = c.n - 1 WHERE regexp_matches(p.bare, '^第(一|1)[编章节]{_WS}+\\S'))
SELECT id, min(n) AS start FROM climb GROUP BY id"""


def tail_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of two sources, each without the footer that the other lacks."""
    a, b = F.col("a"), F.col("b")
    return TAILS.df(spark).select("id", canon.common_prefix(a, b).cast("int").alias("shared"), canon.trimmed_tail(a, b).alias("a"), canon.trimmed_tail(b, a).alias("b"))


def _kept(c: str) -> str:
    return f"CASE WHEN a = b THEN {c} ELSE regexp_replace(regexp_extract(substr({c}, 1, shared), '(?s)^.*[。\\n]'), {_TRIMMED}) END"


TAIL_TRIM = f"""WITH t AS (SELECT *, (least(length(a), length(b), coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i::BIGINT, 1) <> substr(b, i::BIGINT, 1))) - 1, 1000000)))::INTEGER AS shared FROM {TAILS.sql()})
SELECT id, shared, {_kept('a')} AS a, {_kept('b')} AS b FROM t"""


def case_filters(spark: SparkSession, sf_dir: str, category: str = "lookup", ids: tuple[str, ...] = ("a1", "b1"), most: int = 2) -> DataFrame:
    """The command line's filters, each on its own: by category, by ids, the first ``most`` by id."""
    c = CASES.df(spark).select("id", "category")
    place = F.row_number().over(Window.orderBy("id"))  # an inline table of a few cases
    flags = [(F.col("category") == category).alias("by_category"), F.col("id").isin(*ids).alias("by_id"), (place <= most).alias("by_limit")]
    return c.select("id", *flags)


CASE_FILTERS = f"SELECT id, category = 'lookup' AS by_category, id IN ('a1', 'b1') AS by_id, id IN (SELECT id FROM {CASES.sql()} ORDER BY id LIMIT 2) AS by_limit FROM {CASES.sql()}"


def missing_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases out of the domain that do not say of which kind; any of them is an error."""
    return CASES.df(spark).filter((F.col("category") == "out_of_domain") & (F.coalesce("kind", F.lit("")) == "")).select("id", "question")


MISSING_KIND = f"SELECT id, question FROM {CASES.sql()} WHERE category = 'out_of_domain' AND (kind IS NULL OR kind = '')"


def absent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KINDS.df(spark).exceptAll(MADE.df(spark).select("kind").distinct())


ABSENT_KINDS = f"SELECT kind FROM {KINDS.sql()} WHERE kind NOT IN (SELECT kind FROM {MADE.sql()})"


def lookup_by_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with exactly this spelling of a number, of one source if it is named."""
    a, s = ASKED.df(spark).withColumnRenamed("source", "only"), STORE.df(spark)
    return a.join(s, "article_no").filter(F.col("only").isNull() | (F.col("only") == F.col("source"))).select("id", "ord")


LOOKUP_BY_SPELLING = f"SELECT a.id, s.ord FROM {ASKED.sql()} a JOIN {STORE.sql()} s ON s.article_no = a.article_no WHERE a.source IS NULL OR a.source = s.source"

def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without their leading block of settings."""
    return PROMPTS.df(spark).select("id", files.without_front_matter(F.col("raw")).alias("prompt"))


FRONT_MATTER = f"SELECT id, trim(regexp_replace(raw, '^---\\r?\\n(?s:.*?)\\r?\\n---\\r?\\n', '')) AS prompt FROM {PROMPTS.sql()}"


def manifest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next version of each corpus: one up where its hash changed, 1 at first."""
    p = PREVIOUS.df(spark)
    now = CURRENT.df(spark)
    out = None
    for name in ("same", "changed", "new"):
        one = files.next_version(p.filter(F.col("corpus") == name), now.filter(F.col("corpus") == name).select("hash")).select(F.lit(name).alias("corpus"), "version")
        out = one if out is None else out.unionByName(one)
    return out


MANIFEST_VERSION = f"SELECT c.corpus, (CASE WHEN p.version IS NULL THEN 1 WHEN p.hash = c.hash THEN p.version ELSE p.version + 1 END)::INTEGER AS version FROM {CURRENT.sql()} c LEFT JOIN {PREVIOUS.sql()} p USING (corpus)"


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as reports show them: three digits, four digits, and rounded to four as a number."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("double") / 7).alias("x"))
    return li.select("l_orderkey", "l_linenumber", F.format_string("%.3f", "x").alias("three"), F.format_string("%.4f", "x").alias("four"), F.round("x", 4).alias("rounded"))


NUMBER_FORMATS = "SELECT l_orderkey, l_linenumber, printf('%.3f', x) AS three, printf('%.4f', x) AS four, round(x, 4) AS rounded FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE / 7 AS x FROM lineitem)"

QUERIES = {
    f.__name__: f
    for f in (builder_numeral, leading_number, full_width_marks, heading_form, canon_form, canon_compare, truncated_texts, refusal_messages, body_start, tail_trim, case_filters, missing_kind, absent_kinds, lookup_by_spelling, front_matter, manifest_version, number_formats)
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
