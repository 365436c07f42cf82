"""Texts in and out: contexts, rewrites, claims, event frames, tool-call fragments, injected defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions.text import WS, fingerprint, norm_source, trim_ws
from ..operators.verdicts import json_body
from ..sources import read

HITS = table("id int, rank int, source string, chapter string, article_no string, score double, document string", (1, 1, "民法典.md", "第一编", "第一条", 0.91234, "正文一"), (1, 2, "公司法.md", None, None, 0.5, "正文二"), (2, 1, "民法典.md", None, "第二条", 0.75, "正文三"))
REWRITES = table(
    "id int, raw string",
    (1, '{"queries": [{"law": "民法典", "query": "违约责任怎么承担"}, {"law": "《公司法》", "query": "股东查阅权的范围"}]}'), (2, "not json"), (3, '{"queries": [{"law": "刑法", "query": "正当防卫的条件"}, {"law": "民法典", "query": "短"}]}'),
    (4, '{"queries": [{"law": "民法典", "query": "问题一一一"}, {"law": "民法典", "query": "问题一一一"}, {"law": "民法典", "query": "问题二二二"}, {"law": "民法典", "query": "问题三三三"}]}'), (5, None),
    (6, '```json\n{"queries": [{"law": "民法典", "query": "围栏里的不算"}]}\n```'), (7, 'x {"queries": [{"law": "民法典", "query": "前面有字不算"}]}'), (8, '{"queries": [1, {"law": 3, "query": "四个字符"}, {"law": "公司法 .md", "query": "  四个字符  "}, {"law": "公司法"}]}'), (9, '{"queries": {"law": "民法典"}}'), (10, "[]"),
)
ALLOWED = ("民法典", "公司法")
CLAIMS = table(
    "id int, raw string",
    (1, '```json\n{"claims": [{"text": "甲", "verdict": "supported"}, {"text": "乙", "verdict": "unsupported", "evidence": "无"}, {"text": "丙", "verdict": "maybe"}]}\n```'), (2, 'x {"claims": []} y'), (3, '{"other": 1}'), (4, "?"), (5, '{"claims": [{"verdict": "supported"}]}'),
)
STREAM = table(
    "id int, raw string",
    (1, 'event: meta\ndata: {"a": 1}\n\nevent: token\ndata: {"t": "he"}\n\nevent: token\ndata: {"t": \ndata: "llo"}\n\nevent: done\ndata: {}'), (2, "event: status\nevent: error\ndata: {\"m\": 2}\n\ndata: {bad\n\n"), (3, ""),
)
FRAGMENTS = table("call string, seq int, idx int, name string, args string", ("x", 1, 0, "search", '{"q"'), ("x", 2, 0, None, ': "a"}'), ("x", 3, 2, "get", "{"), ("x", 4, 2, None, "}"), ("y", 1, 0, "list", ""))
NAMES = table("id int, name string", (1, "合同 范本(1).md"), (2, "../etc/passwd"), (3, "a" * 80 + ".md"), (4, "民法典.md"), (5, "x/y.md"), (6, "note.txt"), (7, "a\\b.md"))
BATCH = table("req string, idx int, dim int", ("a", 1, 4), ("a", 0, 4), ("b", 0, 4), ("c", 0, 4), ("c", 0, 4), ("d", 0, 3), ("d", 1, 4))
ASKED = table("req string, n int", ("a", 2), ("b", 2), ("c", 2), ("d", 2), ("e", 1))


def _lines(with_score: bool):
    score = [F.concat(F.lit("相关度："), F.format_string("%.3f", "score"))] if with_score else []
    head = F.concat_ws(" | ", F.concat(F.lit("来源："), "source"), F.concat(F.lit("章节："), "chapter"), F.concat(F.lit("条号："), "article_no"), *score)
    return F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), head, F.lit("\n"), F.col("document"))


def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = HITS.df(spark)
    block = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", _lines(s).alias("t")))), lambda x: x["t"]), "\n\n---\n\n")
    return h.groupBy("id").agg(block(True).alias("context"), block(False).alias("judge_context"))


def _head_sql(score: bool) -> str:
    tail = ", '相关度：' || printf('%.3f', score)" if score else ""
    return f"'[' || rank || '] ' || concat_ws(' | ', '来源：' || source, '章节：' || chapter, '条号：' || article_no{tail}) || chr(10) || document"


FORMAT_CONTEXT = f"SELECT id, string_agg({_head_sql(True)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, string_agg({_head_sql(False)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS judge_context FROM {HITS.sql()} GROUP BY id"


def parse_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of a formatted context, as they were."""
    c = format_context(spark, sf_dir).select("id", F.posexplode(F.split("context", r"\n\n---\n\n")).alias("pos", "b"))
    field = lambda n: F.nullif(F.regexp_extract("b", n + "：([^|\\n]*?)(?: \\||\\n)", 1), F.lit(""))
    return c.select("id", "pos", field("来源").alias("source"), field("条号").alias("article_no"), F.regexp_extract("b", r"(?s)^[^\n]*\n(.*)$", 1).alias("body")).filter("source is not null")


PARSE_CONTEXT = f"SELECT id, (rank - 1)::INTEGER AS pos, source, article_no, document AS body FROM {HITS.sql()}"


def parse_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten queries of allowed sources: 4 to 80 characters, at most two a source and four in all, each once.

    The reply must be JSON as it is: a fence or words around it make it unusable.
    """
    d = REWRITES.df(spark).withColumn("v", F.try_parse_json("raw"))
    q = d.select("id", F.posexplode(F.try_variant_get("v", "$.queries", "array<variant>")).alias("i", "q"))
    said = lambda path: F.when(F.schema_of_variant(F.try_variant_get("q", path, "variant")) == "STRING", F.try_variant_get("q", path, "string"))
    q = q.select("id", "i", norm_source(said("$.law")).alias("law"), trim_ws(said("$.query")).alias("query"))
    q = q.filter(F.col("law").isin(*ALLOWED) & F.char_length("query").between(4, 80))
    once = F.row_number().over(Window.partitionBy("id", "law", "query").orderBy("i"))
    q = q.withColumn("once", once).filter("once = 1").withColumn("per", F.row_number().over(Window.partitionBy("id", "law").orderBy("i"))).filter("per <= 2")
    return q.withColumn("all", F.row_number().over(Window.partitionBy("id").orderBy("i"))).filter("all <= 4").select("id", F.col("all").alias("n"), "law", "query")


_TRIM = f"'^{WS}+|{WS}+$', '', 'g'"
PARSE_REWRITES = f"""WITH j AS MATERIALIZED (SELECT id, raw::JSON AS j FROM {REWRITES.sql()} WHERE json_valid(raw)),
q AS (SELECT id, unnest(json_extract(j, '$.queries[*]')) AS q, generate_subscripts(json_extract(j, '$.queries[*]'), 1) AS i FROM j WHERE json_type(j, '$.queries') = 'ARRAY'),
p AS (SELECT id, i, regexp_replace(regexp_replace(regexp_replace(json_extract_string(q, '$.law'), '中华人民共和国|[《》]|{WS}', '', 'g'), '\\.md$', '', 'i'), {_TRIM}) AS law, regexp_replace(json_extract_string(q, '$.query'), {_TRIM}) AS query FROM q WHERE json_type(q, '$.law') = 'VARCHAR' AND json_type(q, '$.query') = 'VARCHAR'),
a AS (SELECT * FROM p WHERE law IN ('民法典', '公司法') AND length(query) BETWEEN 4 AND 80 QUALIFY row_number() OVER (PARTITION BY id, law, query ORDER BY i) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id, law ORDER BY i) <= 2)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS n, law, query FROM b QUALIFY n <= 4"""


def parse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a text and a known verdict; the rest of a list is dropped, a missing list is an error."""
    v = F.try_parse_json(json_body(F.coalesce("raw", F.lit(""))))
    d = CLAIMS.df(spark).withColumn("v", v).withColumn("c", F.try_variant_get("v", "$.claims", "array<struct<text:string,verdict:string,evidence:string>>"))
    kept = F.filter("c", lambda x: x["text"].isNotNull() & x["verdict"].isin("supported", "unsupported"))
    error = F.when(F.col("v").isNull(), "not json").when(F.col("c").isNull(), "no claims")
    return d.select("id", error.alias("error"), F.when(error.isNull(), F.size(kept)).alias("n"), F.when(error.isNull(), F.size(F.filter(kept, lambda x: x["verdict"] == "supported"))).alias("supported"))


PARSE_CLAIMS = f"""WITH t AS (SELECT id, regexp_replace(coalesce(raw, ''), {_TRIM}) AS t FROM {CLAIMS.sql()}), f AS (SELECT *, regexp_extract(t, '^```(?:json)?\\s*\\n?([\\s\\S]*?)\\n?```$', 1) AS f FROM t),
b AS (SELECT id, CASE WHEN f <> '' THEN regexp_replace(f, {_TRIM}) WHEN starts_with(t, '{{') THEN t ELSE nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') END AS b FROM f),
j AS MATERIALIZED (SELECT id, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM b), e AS (SELECT *, CASE WHEN j IS NULL THEN 'not json' WHEN json_type(j, '$.claims') IS DISTINCT FROM 'ARRAY' THEN 'no claims' END AS error FROM j),
c AS (SELECT id, unnest(json_extract(j, '$.claims[*]')) AS c FROM e WHERE error IS NULL), k AS (SELECT id, json_extract_string(c, '$.verdict') AS verdict FROM c WHERE json_type(c, '$.text') = 'VARCHAR' AND json_extract_string(c, '$.verdict') IN ('supported', 'unsupported'))
SELECT e.id, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM k WHERE k.id = e.id)::INTEGER END AS n, CASE WHEN error IS NULL THEN (SELECT count(*) FROM k WHERE k.id = e.id AND verdict = 'supported')::INTEGER END AS supported FROM e"""


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as an event frame, by the hash of the frame."""
    c = read(spark, sf_dir, "conversations")
    frame = F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.length("text").cast("string"), F.lit(":"), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\n\n"))
    return c.select("conv_id", "turn", fingerprint(frame).alias("frame"))


SSE_FRAMES = "SELECT conv_id, turn, substr(sha1('event: ' || role || chr(10) || 'data: ' || length(text) || ':' || replace(text, chr(10), '\\n') || chr(10) || chr(10)), 1, 16) AS frame FROM conversations"


def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a raw stream: the last name of a frame counts, its data lines are joined, bad JSON is skipped."""
    f = STREAM.df(spark).select("id", F.posexplode(F.split("raw", "\n\n")).alias("pos", "frame"))
    name = F.element_at(F.concat(F.array(F.lit("message")), F.regexp_extract_all("frame", F.lit(r"(?m)^event: ?(.*)$"), F.lit(1))), -1)
    data = F.array_join(F.regexp_extract_all("frame", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "")
    return f.select("id", "pos", name.alias("event"), data.alias("data")).filter((F.col("data") != "") & F.try_parse_json("data").isNotNull())


SSE_PARSE = f"""WITH f AS (SELECT id, unnest(string_split(raw, chr(10) || chr(10))) AS frame, generate_subscripts(string_split(raw, chr(10) || chr(10)), 1) - 1 AS pos FROM {STREAM.sql()}),
l AS (SELECT id, pos, unnest(string_split(frame, chr(10))) AS line, generate_subscripts(string_split(frame, chr(10)), 1) AS i FROM f),
g AS (SELECT id, pos, coalesce(arg_max(regexp_replace(substr(line, 7), '^ ', ''), i) FILTER (WHERE starts_with(line, 'event:')), 'message') AS event, coalesce(string_agg(regexp_replace(substr(line, 6), '^ ', ''), '' ORDER BY i) FILTER (WHERE starts_with(line, 'data:')), '') AS data FROM l GROUP BY id, pos)
SELECT id, pos::INTEGER AS pos, event, data FROM g WHERE data <> '' AND json_valid(data)"""


def assemble_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls from their streamed fragments; a gap in the numbering is an empty call."""
    f = FRAGMENTS.df(spark)
    per = f.groupBy("call", "idx").agg(F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "args"))), lambda x: x["args"]), "").alias("args"))
    slots = f.groupBy("call").agg(F.max("idx").alias("most")).select("call", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("idx"))
    return slots.join(per, ["call", "idx"], "left").select("call", "idx", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("args", F.lit("")).alias("args"))


ASSEMBLE_FRAGMENTS = f"""WITH f AS {FRAGMENTS.sql()}, p AS (SELECT call, idx, max(name) AS name, string_agg(args, '' ORDER BY seq) AS args FROM f GROUP BY ALL), s AS (SELECT call, unnest(range(max(idx) + 1))::INTEGER AS idx FROM f GROUP BY call)
SELECT s.call, s.idx, coalesce(name, '') AS name, coalesce(args, '') AS args FROM s LEFT JOIN p USING (call, idx)"""


def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_replace("name", r"(?i)\.md$", "")
    return NAMES.df(spark).select("id", F.substring(F.regexp_replace(base, r"[^A-Za-z0-9_一-龥-]", "_"), 1, 60).alias("safe"))


SANITIZE_NAME = f"SELECT id, substr(regexp_replace(regexp_replace(name, '\\.md$', '', 'i'), '[^A-Za-z0-9_一-龥-]', '_', 'g'), 1, 60) AS safe FROM {NAMES.sql()}"


def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = ~F.contains("name", F.lit("..")) & ~F.contains("name", F.lit("/")) & ~F.contains("name", F.lit("\\")) & F.endswith("name", F.lit(".md"))
    return NAMES.df(spark).select("id", ok.alias("allowed"))


PATH_GUARD = f"SELECT id, strpos(name, '..') = 0 AND strpos(name, '/') = 0 AND strpos(name, chr(92)) = 0 AND name LIKE '%.md' AS allowed FROM {NAMES.sql()}"


def batch_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each batched response is whole: as many rows as asked, every index once, one dimension."""
    per = BATCH.df(spark).groupBy("req").agg(F.count("*").alias("got"), F.countDistinct("idx").alias("places"), F.max("idx").alias("last"), F.countDistinct("dim").alias("dims"))
    ok = (F.col("got") == F.col("n")) & (F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1) & (F.col("dims") == 1)
    return ASKED.df(spark).join(per, "req", "left").select("req", F.coalesce(ok, F.lit(False)).alias("whole"))


BATCH_REORDER = f"""WITH p AS (SELECT req, count(*) AS got, count(DISTINCT idx) AS places, max(idx) AS last, count(DISTINCT dim) AS dims FROM {BATCH.sql()} GROUP BY req)
SELECT req, coalesce(got = n AND places = n AND last = n - 1 AND dims = 1, false) AS whole FROM {ASKED.sql()} LEFT JOIN p USING (req)"""

QUERIES = {f.__name__: f for f in (format_context, parse_context, parse_rewrites, parse_claims, sse_frames, sse_parse, assemble_fragments, sanitize_name, path_guard, batch_reorder)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
