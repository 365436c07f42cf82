"""Vector search, pinning, coverage and caches on ``embeddings`` and ``documents``.

A vector's label serves as its source and its id as its number.  Queries are the
rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import caches, folds, topk
from ..sources import read

K = 5


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), F.col("vec_id").alias("number"), "embedding")


def questions(spark: SparkSession, sf_dir: str, named: int = 0) -> DataFrame:
    """Every 20th vector; it names its own source and ``named`` - 1 following ones, and asks for the number after its own."""
    e = read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    names = F.array(*(F.concat(F.lit("s"), ((F.col("label") + i) % 10).cast("string")) for i in range(named))) if named else F.array().cast("array<string>")
    number = F.col("vec_id") + 1
    pair = F.array(F.struct(F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), number.alias("number")))
    paired = F.lit(bool(named)) & (F.col("vec_id") % 40 == 0)
    return e.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), names.alias("names"), F.lit(None).cast("string").alias("source_filter"),
        F.when(paired, F.array().cast("array<bigint>")).otherwise(F.array(number)).alias("numbers"), F.when(paired, pair).alias("pairs"), F.col("label"),
    )


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = topk.scores(questions(spark, sf_dir), items(spark, sf_dir), K)
    return got.select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), F.col("pool_rank").alias("rank"))


def topk_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("source_filter", F.concat(F.lit("s"), F.col("label").cast("string")))
    got = topk.scores(q, items(spark, sf_dir), 2)
    return got.select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), F.col("pool_rank").alias("rank"))


def pinned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.pinned(questions(spark, sf_dir, 1), items(spark, sf_dir)).select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.hybrid(questions(spark, sf_dir, 1), items(spark, sf_dir), K).select("query_id", "rank", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), "exact")


_SCORED = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, 's' || label AS own, vec_id + 1 AS number, vec_id % 40 = 0 AS paired FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT vec_id, embedding::DOUBLE[] AS v, 's' || label AS source FROM embeddings),
s AS (SELECT query_id, vec_id, own, source, number, paired, round(coalesce(list_cosine_similarity(v, qv), 0), 9) AS cos FROM q, x)"""
VECTOR_TOPK = f"""WITH {_SCORED} SELECT query_id, vec_id, round(cos, 6) AS score, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY cos DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
TOPK_IN_SOURCE = f"""WITH {_SCORED} SELECT query_id, vec_id, round(cos, 6) AS score, row_number() OVER w AS rank FROM s WHERE source = own WINDOW w AS (PARTITION BY query_id ORDER BY cos DESC, vec_id) QUALIFY row_number() OVER w <= 2"""
_PINS = f"""{_SCORED},
b AS (SELECT *, round(cos + CASE WHEN source = own THEN 0.03 ELSE 0 END, 9) AS boosted, vec_id = number AND source = own AS exact FROM s)"""
PINNED_LOOKUP = f"WITH {_PINS} SELECT query_id, vec_id, round(boosted, 6) AS score FROM b WHERE exact"
HYBRID_TOPK = f"""WITH {_PINS} SELECT query_id, row_number() OVER w AS rank, vec_id, round(boosted, 6) AS score, exact FROM b WINDOW w AS (PARTITION BY query_id ORDER BY exact DESC, boosted DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def _ranked(spark: SparkSession, sf_dir: str, named: int) -> tuple[DataFrame, DataFrame]:
    q, x = questions(spark, sf_dir, named), items(spark, sf_dir)
    pool = topk.scores(q, x, K + 1)
    return topk.hybrid(q, x, K, pool), pool


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid results of queries that name two sources, with each represented where it was next in line."""
    q, x = questions(spark, sf_dir, 2), items(spark, sf_dir)
    top, pool = _ranked(spark, sf_dir, 2)
    rows = top.select("query_id", F.lit("result").alias("part"), F.col("rank").alias("place"), "ord", "exact").unionByName(
        pool.select("query_id", F.lit("pool").alias("part"), F.col("pool_rank").alias("place"), "ord", F.lit(False).alias("exact")))
    here = x.select("source").distinct()
    present = q.select("query_id", F.explode("names").alias("source")).join(here, "source", "left_semi").groupBy("query_id").agg(F.collect_set("source").alias("present"))
    rows = rows.join(x.select("ord", "source"), "ord").join(q.select("query_id", "names"), "query_id").join(present, "query_id")
    return folds.coverage(rows).withColumnRenamed("ord", "vec_id")


SOURCE_COVERAGE = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, 's' || label AS n1, 's' || (label + 1) % 10 AS n2, vec_id + 1 AS number, vec_id % 40 = 0 AS paired FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT vec_id, embedding::DOUBLE[] AS v, 's' || label AS source FROM embeddings),
s AS (SELECT query_id, vec_id, source, n1, n2, round(round(coalesce(list_cosine_similarity(v, qv), 0), 9) + CASE WHEN source IN (n1, n2) THEN 0.03 ELSE 0 END, 9) AS score,
  vec_id = number AND CASE WHEN paired THEN source = n1 ELSE source IN (n1, n2) END AS exact FROM q, x),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS place FROM s QUALIFY place <= 5),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
lack AS (SELECT query_id, n FROM (SELECT DISTINCT query_id, unnest([n1, n2]) AS n FROM top) l WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = l.query_id AND t.source = l.n) AND EXISTS (SELECT 1 FROM x WHERE x.source = l.n)),
cand AS (SELECT l.query_id, l.n, min_by(p.vec_id, p.place) AS vec_id FROM lack l JOIN pool p ON p.query_id = l.query_id AND p.source = l.n GROUP BY ALL),
slot AS (SELECT c.query_id, c.vec_id, max(t.rank) AS rank FROM cand c JOIN (SELECT *, count(*) OVER (PARTITION BY query_id, source) AS same FROM top) t ON t.query_id = c.query_id AND NOT t.exact AND t.same > 1 GROUP BY ALL)
SELECT t.query_id, t.rank::INTEGER AS rank, coalesce(sl.vec_id, t.vec_id) AS vec_id FROM top t LEFT JOIN slot sl ON sl.query_id = t.query_id AND sl.rank = t.rank"""


def merge_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits in each of two named sources, merged into the plain results."""
    q, x = questions(spark, sf_dir, 2), items(spark, sf_dir)
    base = topk.scores(questions(spark, sf_dir), x, K).select("query_id", F.lit("base").alias("part"), F.col("pool_rank").alias("place"), "ord")
    for i in range(2):
        own = q.withColumn("source_filter", F.col("names")[i]).withColumn("names", F.array().cast("array<string>"))
        hit = topk.scores(own, x, 2).join(own.select("query_id", F.col("source_filter").alias("part")), "query_id")
        base = base.unionByName(hit.select("query_id", "part", F.col("pool_rank").alias("place"), "ord"))
    rows = base.join(x.select("ord", "source"), "ord").join(q.select("query_id", "names"), "query_id").withColumn("exact", F.lit(False))
    return folds.rewrites(rows, K).withColumnRenamed("ord", "vec_id")


MERGE_REWRITES = """WITH RECURSIVE q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, ['s' || label, 's' || (label + 1) % 10] AS names FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT vec_id, embedding::DOUBLE[] AS v, 's' || label AS source FROM embeddings),
s AS MATERIALIZED (SELECT query_id, names, vec_id, source, round(coalesce(list_cosine_similarity(v, qv), 0), 9) AS cos FROM q, x),
b AS (SELECT query_id, list({'o': vec_id, 's': source} ORDER BY cos DESC, vec_id) AS base FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) <= 5) GROUP BY query_id),
h AS (SELECT query_id, list({'o': vec_id, 's': source} ORDER BY list_position(names, source), cos DESC, vec_id) AS hits FROM (SELECT * FROM s WHERE source IN (names[1], names[2]) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY cos DESC, vec_id) <= 2) GROUP BY query_id),
f(query_id, k, res, done) AS (SELECT query_id, 0, base, NULL::VARCHAR FROM b UNION ALL
  SELECT query_id, k + 1, CASE WHEN skip THEN res WHEN len(res) < 5 THEN list_append(res, hit) WHEN spare IS NOT NULL THEN list_concat(list_append(res[:spare - 1], hit), res[spare + 1:]) ELSE res END, CASE WHEN over OR (NOT skip AND len(res) >= 5 AND spare IS NULL) THEN hit.s ELSE done END
  FROM (SELECT *, over OR held AS skip FROM (SELECT f.query_id, f.k, f.res, f.done, h.hits[f.k + 1] AS hit, coalesce(f.done = h.hits[f.k + 1].s, false) OR len(list_filter(f.res, lambda r: r.s = h.hits[f.k + 1].s)) >= 2 AS over, len(list_filter(f.res, lambda r: r.o = h.hits[f.k + 1].o)) > 0 AS held,
    list_max(list_filter(range(1, least(len(b.base), len(f.res)) + 1), lambda i: len(list_filter(f.res, lambda r: r.s = f.res[i].s)) > 2)) AS spare FROM f JOIN h USING (query_id) JOIN b USING (query_id) WHERE f.k < len(h.hits)))),
l AS (SELECT query_id, arg_max(res, k) AS res FROM f GROUP BY query_id)
SELECT query_id, unnest(range(1, len(res) + 1))::INTEGER AS rank, unnest(res).o AS vec_id FROM l"""


def rerank_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned items keep their place; the others are ordered anew by a model's score (here: the reverse of the old)."""
    top = topk.hybrid(questions(spark, sf_dir, 1), items(spark, sf_dir), K)
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.when(F.col("exact"), F.col("rank")).otherwise(-F.col("rank")))
    return top.select("query_id", F.row_number().over(order).alias("rank"), F.col("ord").alias("vec_id"))


RERANK_PINNED = f"""WITH {_PINS}, h AS (SELECT query_id, row_number() OVER w AS r, vec_id, exact FROM b WINDOW w AS (PARTITION BY query_id ORDER BY exact DESC, boosted DESC, vec_id) QUALIFY row_number() OVER w <= 5)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, CASE WHEN exact THEN r ELSE -r END) AS rank, vec_id FROM h"""


def retrieve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 20, reranked by the cosine without the boost, cut to 5."""
    q, x = questions(spark, sf_dir, 1), items(spark, sf_dir)
    pool = topk.hybrid(q, x, 20).join(x.select("ord", "embedding"), "ord").join(q.select("query_id", "qv"), "query_id")
    pool = pool.withColumn("model", F.round(topk.cosine(F.col("qv"), F.col("embedding")), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc(F.when(F.col("exact"), F.lit(0.0)).otherwise(F.col("model"))), "rank")
    return pool.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= K).select("query_id", F.col("r").alias("rank"), F.col("ord").alias("vec_id"), F.round("model", 6).alias("model"))


RETRIEVE_RERANK = f"""WITH {_PINS}, h AS (SELECT query_id, row_number() OVER w AS r, vec_id, exact, cos FROM b WINDOW w AS (PARTITION BY query_id ORDER BY exact DESC, boosted DESC, vec_id) QUALIFY row_number() OVER w <= 20)
SELECT query_id, row_number() OVER o AS rank, vec_id, round(cos, 6) AS model FROM h WINDOW o AS (PARTITION BY query_id ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE cos END DESC, r) QUALIFY row_number() OVER o <= 5"""


def corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a kind and a document: every 7th is a heading, and a vector's document is the text of its id (blank for every 11th)."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 11 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("document"))
    kind = F.when(F.col("ord") % 7 == 0, "heading").otherwise("article")
    return items(spark, sf_dir).withColumn("kind", kind).join(d, "ord", "left")


def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid results without headings, and of the five those whose document is not blank."""
    x = corpus_items(spark, sf_dir)
    return topk.non_empty(topk.hybrid(questions(spark, sf_dir, 1), x, K), x, K).select("query_id", "rank", F.col("ord").alias("vec_id"))


_KINDED = """x AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, 's' || label AS source, CASE WHEN d.doc_id % 11 = 0 THEN ' ' ELSE d.text END AS document FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 7 <> 0)"""
RETRIEVE_FILTERED = f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, 's' || label AS own, vec_id + 1 AS number FROM embeddings WHERE vec_id % 20 = 0), {_KINDED},
s AS (SELECT query_id, vec_id, document, round(round(coalesce(list_cosine_similarity(v, qv), 0), 9) + CASE WHEN source = own THEN 0.03 ELSE 0 END, 9) AS score, vec_id = number AND source = own AS exact FROM q, x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)
SELECT query_id, rank, vec_id FROM r WHERE trim(coalesce(document, '')) <> ''"""


def retrieve_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: a pool of 20 without headings and blanks, reranked by the plain cosine behind the pinned, cut to five, named sources covered."""
    q, x = questions(spark, sf_dir, 2), corpus_items(spark, sf_dir)
    pool = topk.non_empty(topk.hybrid(q, x, 20), x, 20)
    model = pool.select("query_id", "ord").join(x.select("ord", "embedding"), "ord").join(q.select("query_id", "qv"), "query_id")
    model = model.select("query_id", "ord", F.round(topk.cosine(F.col("qv"), F.col("embedding")), 9).alias("model"))
    merged = topk.reranked(pool, model, K)
    rows = merged.filter(F.col("rank") <= K).withColumn("part", F.lit("result")).unionByName(merged.withColumn("part", F.lit("pool"))).select("query_id", "part", F.col("rank").alias("place"), "ord", "exact")
    here = merged.join(x.select("ord", "source"), "ord").select("query_id", "source").distinct()
    present = q.select("query_id", F.explode("names").alias("name")).join(here, "query_id").filter(F.contains("source", F.col("name"))).groupBy("query_id").agg(F.collect_set("name").alias("present"))
    rows = rows.join(x.select("ord", "source"), "ord").join(q.select("query_id", "names"), "query_id").join(present, "query_id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    return folds.coverage(rows).withColumnRenamed("ord", "vec_id")


RETRIEVE_COVERED = f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, 's' || label AS n1, 's' || (label + 1) % 10 AS n2, vec_id + 1 AS number, vec_id % 40 = 0 AS paired FROM embeddings WHERE vec_id % 20 = 0), {_KINDED},
c AS (SELECT query_id, vec_id, document, source, n1, n2, round(coalesce(list_cosine_similarity(v, qv), 0), 9) AS cos, vec_id = number AND CASE WHEN paired THEN source = n1 ELSE source IN (n1, n2) END AS exact FROM q, x),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, round(cos + CASE WHEN source IN (n1, n2) THEN 0.03 ELSE 0 END, 9) DESC, vec_id) AS first FROM c QUALIFY first <= 20),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, CASE WHEN exact THEN first END, cos DESC, first) AS rank FROM s WHERE trim(coalesce(document, '')) <> ''),
top AS (SELECT * FROM m WHERE rank <= 5), sized AS (SELECT query_id, count(*) AS n FROM top GROUP BY query_id),
lack AS (SELECT DISTINCT m.query_id, m.source AS n FROM m JOIN sized USING (query_id) WHERE m.source IN (m.n1, m.n2) AND sized.n >= 2 AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = m.query_id AND t.source = m.source)
  AND EXISTS (SELECT 1 FROM m a WHERE a.query_id = m.query_id AND a.source = m.n1) AND EXISTS (SELECT 1 FROM m a WHERE a.query_id = m.query_id AND a.source = m.n2)),
cand AS (SELECT l.query_id, l.n, arg_min(m.vec_id, m.rank) AS vec_id, min(m.rank) AS rank FROM lack l JOIN m ON m.query_id = l.query_id AND m.source = l.n GROUP BY ALL),
slot AS (SELECT c.query_id, c.vec_id, max(t.rank) AS rank FROM cand c JOIN sized z ON z.query_id = c.query_id AND c.rank - 1 <= z.n JOIN (SELECT *, count(*) OVER (PARTITION BY query_id, source) AS same FROM top) t ON t.query_id = c.query_id AND NOT t.exact AND t.same > 1 GROUP BY ALL)
SELECT t.query_id, t.rank::INTEGER AS rank, coalesce(sl.vec_id, t.vec_id) AS vec_id FROM top t LEFT JOIN slot sl ON sl.query_id = t.query_id AND sl.rank = t.rank"""


def dim_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose length is not the most common one."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"))
    usual = e.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).select(F.col("dim").alias("usual"))
    return e.join(F.broadcast(usual)).groupBy((F.col("dim") == F.col("usual")).alias("fits")).agg(F.count("*").alias("n"))


DIM_VIOLATIONS = """WITH e AS (SELECT vec_id, len(embedding) AS dim FROM embeddings), u AS (SELECT dim AS usual FROM e GROUP BY dim ORDER BY count(*) DESC, dim LIMIT 1)
SELECT dim = usual AS fits, count(*) AS n FROM e, u GROUP BY 1"""


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"), "n_chars")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts looked up in a cache of even ids, then in one of ids divisible by 3."""
    d = _hashed(spark, sf_dir)
    one = d.filter("doc_id % 2 = 0").groupBy("k").agg(F.max("n_chars").alias("v"))
    two = d.filter("doc_id % 3 = 0").groupBy("k").agg(F.max("n_chars").alias("v"))
    return caches.lookup(d.select("k").distinct(), one, two, "k", "v")


CACHE_LOOKUP = """WITH d AS (SELECT doc_id, md5(text) AS k, n_chars FROM documents),
a AS (SELECT k, max(n_chars) AS v FROM d WHERE doc_id % 2 = 0 GROUP BY k), b AS (SELECT k, max(n_chars) AS v FROM d WHERE doc_id % 3 = 0 GROUP BY k)
SELECT k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'miss' END AS state FROM (SELECT DISTINCT k FROM d) LEFT JOIN a USING (k) LEFT JOIN b USING (k)"""


def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hashed(spark, sf_dir)
    return caches.prune(d.groupBy("k").agg(F.count("*").alias("n")), d.filter("doc_id % 2 = 1"), "k")


CACHE_PRUNE = "WITH d AS (SELECT doc_id, md5(text) AS k FROM documents) SELECT k, count(*) AS n FROM d WHERE k IN (SELECT k FROM d WHERE doc_id % 2 = 1) GROUP BY k"


def cache_evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 newest events, as an entry cache keeps them."""
    return caches.keep_newest(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", 2000, "event_id").select("event_id")


CACHE_EVICT_LRU = "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 2000"


def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hashed(spark, sf_dir).select("k")
    have = _hashed(spark, sf_dir).filter("doc_id % 2 = 0").select("k").distinct()
    return caches.upsert(have, d, "k").groupBy("k").agg(F.count("*").alias("n"))


INCREMENTAL_UPSERT = "SELECT DISTINCT md5(text) AS k, 1::BIGINT AS n FROM documents"


def lookup_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources that have a number, as a hash join on it (here: orders by their customer's number)."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), "o_orderkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), "c_nationkey")
    return o.join(c, "number").groupBy("number", "c_nationkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


LOOKUP_BY_NUMBER = "SELECT c_custkey AS number, c_nationkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"

QUERIES = {
    f.__name__: f
    for f in (vector_topk, topk_in_source, pinned_lookup, hybrid_topk, source_coverage, merge_rewrites, rerank_pinned, retrieve_rerank, retrieve_filtered, retrieve_covered, dim_violations, cache_lookup, cache_prune, cache_evict_lru, incremental_upsert, lookup_by_number)
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
