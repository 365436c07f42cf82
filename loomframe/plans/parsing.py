"""Numerals, names, references, query signals and citations on inline texts; pairs and hashes on documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import codes, lexer, text
from ..sources import read

NUMBERS = table(
    "id int, raw string", (1, "第五百七十七条"), (2, "第577条"), (3, "十"), (4, "二十三"), (5, "一百零七"), (6, "两千零一"), (7, "一万二千三百四十五"),
    (8, "第 23 条"), (9, "甲"), (10, ""), (11, "第一千二百六十条"), (12, "零"), (13, "百"), (14, "三万"), (15, None),
)
NAMES = table("id int, raw string", (1, "中华人民共和国民法典"), (2, "《民法典》"), (3, "民法典.md"), (4, " 公司法　.MD"), (5, ""), (6, "刑法 .md"), (7, None))
QUESTIONS = table(
    "id int, q string",
    (1, "民法典第577条和公司法第二十三条分别怎么规定？"), (2, "公司法和民法典第二十三条"), (3, "第577条"), (4, "民法典第577条怎么规定？那第23条呢？"), (5, "合同法、劳动法与刑法第十条；第零条"),
    (6, "民法典是什么"), (7, "公司法或民法典第五条，第六条"), (8, "第 12 条和第十二条"), (9, ""), (10, "甲第三条。民法典\n第四条"),
)
ANSWERS = table(
    "id int, a string",
    (1, "依据《民法典》第577条，当事人应当承担违约责任。公司法第二十三条另有规定！第577条同上"), (2, "没有引用"), (3, "民法典第一条、第二条；第一条"), (4, "依照第九百九十九条处理"), (5, "公司法第 23 条\n第二十三条"),
)


def cn_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NUMBERS.df(spark).select("id", text.numeral(F.col("raw")).alias("value"))


def _fold_sql(src: str, key: str, raw: str, tag: str = "") -> str:
    """Recursive CTE ``folded`` (with a tag after it) with the value of each row's numerals."""
    ws = text.WS
    return f"""
bare{tag} AS (SELECT {key}, regexp_replace(regexp_replace(regexp_replace({raw}, '^第', ''), '条$', ''), '^{ws}+|{ws}+$', '', 'g') AS s FROM {src}),
fold{tag} AS (SELECT {key}, s, 1 AS i, 0::BIGINT AS total, 0::BIGINT AS section, 0::BIGINT AS unit, true AS ok FROM bare{tag}
  UNION ALL SELECT {key}, s, i + 1,
    CASE WHEN c = '万' THEN total + (section + unit) * 10000 ELSE total END,
    CASE WHEN c = '万' THEN 0 WHEN p IS NOT NULL THEN section + (CASE WHEN unit = 0 THEN 1 ELSE unit END) * p ELSE section END,
    CASE WHEN c = '万' OR p IS NOT NULL THEN 0 WHEN d >= 0 THEN d ELSE unit END,
    ok AND (c = '万' OR p IS NOT NULL OR d >= 0)
  FROM (SELECT *, CASE c WHEN '十' THEN 10 WHEN '百' THEN 100 WHEN '千' THEN 1000 END AS p, CASE WHEN c = '两' THEN 2 ELSE strpos('{text.NUMERALS}', c) - 1 END AS d FROM (SELECT *, substr(s, i, 1) AS c FROM fold{tag} WHERE i <= length(s)))),
folded{tag} AS (SELECT b.{key}, CASE WHEN regexp_matches(b.s, '^[0-9]+$') THEN TRY_CAST(b.s AS BIGINT) WHEN f.ok THEN f.total + f.section + f.unit END AS value FROM bare{tag} b LEFT JOIN fold{tag} f ON f.{key} = b.{key} AND f.i = length(b.s) + 1)"""


CN_NUMERAL = f"WITH RECURSIVE src AS {NUMBERS.sql()}, {_fold_sql('src', 'id', 'raw')} SELECT id, value FROM folded"


def norm_source_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark).select("id", text.norm_source(F.col("raw")).alias("name"))


NORM_SOURCE_NAME = f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(replace(raw, '中华人民共和国', ''), '{text.WS[:-1]}《》]', '', 'g'), '\\.md$', '', 'i'), '^{text.WS}+|{text.WS}+$', '', 'g') AS name FROM {NAMES.sql()}"""


def extract_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = QUESTIONS.df(spark).select("id", F.posexplode(text.references(F.col("q"))).alias("pos", "r"))
    return got.select("id", "pos", F.col("r.number").alias("number"), F.col("r.spelling").alias("spelling"))


def _mentions(fixture, col: str) -> str:
    """CTE chain up to ``m``: id, k (order), spelling and value of each reference."""
    return f"""src AS {fixture.sql()},
raw AS (SELECT id, unnest(l) AS hit, generate_subscripts(l, 1) AS k FROM (SELECT id, regexp_extract_all({col}, '{text.REFERENCE}') AS l FROM src)),
keyed AS (SELECT id, k, regexp_replace(hit, '\\s+', '', 'g') AS spelling, id * 1000 + k AS rid FROM raw),
{_fold_sql('keyed', 'rid', 'spelling')},
m AS (SELECT keyed.id, k, spelling, value AS number FROM keyed JOIN folded USING (rid) WHERE value > 0)"""


EXTRACT_REFS = f"""WITH RECURSIVE {_mentions(QUESTIONS, 'q')},
f AS (SELECT *, row_number() OVER (PARTITION BY id, number ORDER BY k) AS r FROM m)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS pos, number, spelling FROM f WHERE r = 1"""


def parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexer.signals(QUESTIONS.df(spark), "id", "q")
    pairs = F.transform("pairs", lambda p: F.concat_ws("#", p["source"], p["number"].cast("string")))
    return s.select("id", F.array_join("numbers", ",").alias("numbers"), F.array_join("names", ",").alias("names"), F.array_join(pairs, ",").alias("pairs"))


def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexer.citations(ANSWERS.df(spark), "id", "a").select("id", "number", "spelling", "source", "sentence")


def _tokens(fixture, col: str) -> str:
    """CTE chain ``t``: id, i, tok, kind, clause of each token, and the name that governs."""
    names = "|".join(sorted(text.KNOWN_SOURCES, key=lambda n: -len(n)))
    return f"""src AS {fixture.sql()},
tok AS (SELECT id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_extract_all({col}, '({names})|{text.REFERENCE}|[。；;！!？?\\n]|[\\s\\S]') AS l FROM src)),
kinds AS (SELECT *, CASE WHEN regexp_matches(tok, '^({names})$') THEN 'name' WHEN regexp_matches(tok, '^{text.REFERENCE}$') THEN 'ref' WHEN regexp_matches(tok, '^[。；;！!？?\\n]$') THEN 'end' ELSE 'char' END AS kind FROM tok),
t AS (SELECT *, coalesce(sum(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause FROM kinds)"""


PARSE_QUERY = f"""WITH RECURSIVE {_tokens(QUESTIONS, 'q')},
keyed AS (SELECT id, i, clause, regexp_replace(tok, '\\s+', '', 'g') AS spelling, id * 1000 + i AS rid FROM t WHERE kind = 'ref'),
{_fold_sql('keyed', 'rid', 'spelling')},
refs AS (SELECT k.id, k.i, k.clause, value AS number FROM keyed k JOIN folded USING (rid) WHERE value > 0),
chained AS (SELECT *, sum(CASE WHEN kind = 'name' OR regexp_matches(tok, '^[\\s和与及、,，/]$') THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS chain FROM t),
names AS (SELECT id, i, clause, chain, tok FROM chained WHERE kind = 'name'),
nearest AS (SELECT r.id, r.i, max(n.i) AS last_name FROM refs r JOIN names n ON n.id = r.id AND n.clause = r.clause AND n.i < r.i GROUP BY ALL),
governed AS (SELECT r.id, r.i, r.number, n2.i AS ni, n2.tok FROM refs r JOIN nearest x ON x.id = r.id AND x.i = r.i JOIN names n1 ON n1.id = r.id AND n1.i = x.last_name
  JOIN names n2 ON n2.id = r.id AND n2.clause = n1.clause AND n2.chain = n1.chain AND n2.i <= n1.i),
pairs AS (SELECT id, tok || '#' || number AS p, min(i * 1000 + ni) AS o FROM governed GROUP BY id, tok || '#' || number),
loose AS (SELECT id, number, min(i) AS o FROM refs r WHERE NOT EXISTS (SELECT 1 FROM nearest x WHERE x.id = r.id AND x.i = r.i) GROUP BY id, number),
named AS (SELECT id, tok, min(i) AS o FROM names GROUP BY id, tok)
SELECT id, coalesce((SELECT string_agg(number::VARCHAR, ',' ORDER BY o) FROM loose l WHERE l.id = src.id), '') AS numbers,
  coalesce((SELECT string_agg(tok, ',' ORDER BY o) FROM named n WHERE n.id = src.id), '') AS names,
  CASE WHEN EXISTS (SELECT 1 FROM named n WHERE n.id = src.id) THEN coalesce((SELECT string_agg(p, ',' ORDER BY o) FROM pairs p WHERE p.id = src.id), '') END AS pairs FROM src"""

EXTRACT_CITATIONS = f"""WITH RECURSIVE {_tokens(ANSWERS, 'a')},
keyed AS (SELECT id, i, clause, regexp_replace(tok, '\\s+', '', 'g') AS spelling, id * 1000 + i AS rid FROM t WHERE kind = 'ref'),
{_fold_sql('keyed', 'rid', 'spelling')},
refs AS (SELECT k.id, k.i, k.clause, spelling, value AS number FROM keyed k JOIN folded USING (rid) WHERE value > 0),
named AS (SELECT r.*, (SELECT max_by(n.tok, n.i) FROM t n WHERE n.kind = 'name' AND n.id = r.id AND n.clause = r.clause AND n.i < r.i) AS source,
  (SELECT string_agg(c.tok, '' ORDER BY c.i) FROM t c WHERE c.id = r.id AND c.clause = r.clause AND c.kind <> 'end') AS sentence FROM refs r),
d AS (SELECT *, row_number() OVER (PARTITION BY id, coalesce(source, ''), number ORDER BY i) AS r FROM named)
SELECT id, number, spelling, source, sentence FROM d WHERE r = 1"""


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), text.fingerprint(F.col("text")).alias("short"))


CONTENT_HASH = "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha1(text), 1, 16) AS short FROM documents"


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct character pairs of each kind every document has."""
    tables = [codes.members(p) for _, p in _KINDS]

    def run(batches):
        for rb in batches:
            c, edges = codes.code_points(rb.column("text"))
            for a, b in codes.stretches(edges):
                counts = [codes.distinct_pairs(*codes.without(c[edges[a] : edges[b]], edges[a : b + 1] - edges[a], t)) for t in tables]
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(a, b - a), *(pa.array(n.astype("int64")) for n in counts)], ["doc_id", *(n for n, _ in _KINDS)])

    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n, _ in _KINDS)]))


def strip_sql(expr: str, leave_out: str) -> str:
    p = leave_out.replace('\\"', '"').replace("'", "''")
    return f"regexp_replace({expr}, '{p}', '', 'g')"


def pairs_sql(column: str) -> str:
    """Of a column that is stripped already: an expression would be evaluated for every pair."""
    return f"list_sort(list_distinct(list_transform(range(1, length({column})), lambda i: substr({column}, i::BIGINT, 2))))"


_KINDS = (("citation", text.PAIRS_CITATION), ("signal", text.PAIRS_SIGNAL), ("plain", text.PAIRS_PLAIN))
BIGRAMS = (
    "WITH s AS MATERIALIZED (SELECT doc_id, " + ", ".join(f"string_split({strip_sql('text', p)}, '') AS {n}" for n, p in _KINDS) + " FROM documents), "
    "p AS (SELECT doc_id, " + ", ".join(f"list_zip({n}, {n}[2:])[:len({n}) - 1] AS {n}" for n, _ in _KINDS) + " FROM s) "
    "SELECT doc_id, " + ", ".join(f"coalesce(len(list_distinct({n})), 0)::BIGINT AS {n}" for n, _ in _KINDS) + " FROM p"
)


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 20th benchmark passage the most similar other one by character pairs, among those that share one."""
    b = read(spark, sf_dir, "benchmark").select("item_id", text.char_pairs(F.col("text"), text.PAIRS_PLAIN).alias("g")).withColumn("n", F.size("g"))
    each = b.select("item_id", "n", F.explode("g").alias("pair"))
    asked = each.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("n").alias("m"), "pair")
    both = asked.join(each, "pair").filter("item_id <> query_id").groupBy("query_id", "item_id").agg(F.count("*").alias("c"), F.first("m").alias("m"), F.first("n").alias("n"))
    both = both.withColumn("jaccard", F.round(F.col("c") / (F.col("m") + F.col("n") - F.col("c")), 6))
    best = F.max_by(F.struct("item_id", "jaccard"), F.struct("jaccard", -F.col("item_id")))
    return both.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.item_id", "b.jaccard")


JACCARD_PAIRS = f"""WITH s AS MATERIALIZED (SELECT item_id, {strip_sql('text', text.PAIRS_PLAIN)} AS t FROM benchmark), b AS MATERIALIZED (SELECT item_id, {pairs_sql('t')} AS g FROM s),
j AS (SELECT q.item_id AS query_id, b.item_id, len(list_intersect(q.g, b.g)) AS c, round(len(list_intersect(q.g, b.g))::DOUBLE / len(list_distinct(list_concat(q.g, b.g))), 6) AS jaccard FROM b q JOIN b ON q.item_id <> b.item_id WHERE q.item_id % 20 = 0)
SELECT query_id, item_id, jaccard FROM j WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, item_id) = 1"""

QUERIES = {f.__name__: f for f in (cn_numeral, norm_source_name, extract_refs, parse_query, extract_citations, content_hash, bigrams, jaccard_pairs)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
