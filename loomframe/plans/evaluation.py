"""Evaluation queries on benchmark, documents, labels, embeddings and inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import text
from ..functions.text import norm_source
from ..operators import decisions, evalkit, topk
from ..operators.errors import TRANSIENT_CODES, TRANSIENT_NAMES
from ..sources import read
from .parsing import pairs_sql, strip_sql
from .retrieval import _PINS, K, items, questions

CLAIMS = table("id string, claims int, supported int, failed boolean", ("a", 4, 4, False), ("b", 3, 2, False), ("c", 0, 0, False), ("d", None, None, True), ("e", 5, 5, False))
MUTANTS = table("id string, kind string, judge boolean, chk boolean", ("a", "fabricated_cite", True, True), ("b", "fabricated_cite", False, True), ("c", "article_swap", False, False), ("d", "article_swap", True, False), ("e", "unsupported_append", True, False))
KINDS = table("kind string", ("fabricated_cite",), ("distorted_number",), ("article_swap",), ("unsupported_append",))
JUDGES = table("id string, ood boolean, first boolean, second boolean, f1 double, f2 double", ("a", True, True, True, 0.9, 0.9), ("b", True, True, False, 0.8, 0.6), ("c", False, False, False, 1.0, 0.5), ("d", False, True, None, 0.7, None), ("e", True, False, True, 0.5, 0.75))
CALLS = table("id int, outcome string, cached boolean, prompt int, completion int, latency int", (1, "judged", False, 100, 10, 1400), (2, "judged", True, 0, 0, 3), (3, "parse_failure", False, 120, 12, 1800), (4, "skipped", False, 0, 0, None), (5, "judged", False, 90, 9, 1200))
POLICY = table(
    "id int, stratum string, ood boolean, hard_skip boolean, abstained boolean, judged boolean, answerable boolean, named double",
    (1, "in", False, True, False, False, None, None), (2, "in", False, False, False, True, True, 0.6), (3, "in", False, False, True, True, True, 0.4), (4, "adjacent", True, False, False, True, True, 0.42), (5, "adjacent", True, False, False, True, False, None),
    (6, "unrelated", True, False, True, False, None, None), (7, "unrelated", True, False, False, False, None, None), (8, "adjacent", True, False, False, True, True, 0.6),
)
FLOORS = table("name string, metric string, floor double", ("overall", "hit_5", 0.5), ("overall", "mrr", 1.01), ("s1", "hit_5", 0.1), ("nobody", "hit_5", 0.0))
NAMED = table("id int, source string, number int", (1, "《民法典》", 577), (1, "公司法", 23), (2, "民法典.md", 1))
EXPECTED = table("id int, source string, number int", (1, "民法典", 577), (2, "民法典", 2), (2, "民法典", 1), (3, "公司法", 3))
ERRORS = table("id int, name string, code string", (1, "TimeoutError", None), (2, "AbortError", "X"), (3, "Error", "ECONNRESET"), (4, "Error", "E404"), (5, "TypeError", "ENOTFOUND"), (6, None, None))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, source, expected vectors (the next two of the same label) and their ranks among the best 5 others."""
    x = items(spark, sf_dir)
    nxt = Window.partitionBy("source").orderBy("ord")
    want = x.select(F.col("ord").alias("query_id"), F.array(F.lead("ord", 1).over(nxt), F.lead("ord", 2).over(nxt)).alias("w"))
    want = want.select("query_id", F.explode("w").alias("want")).filter("want is not null")
    q = questions(spark, sf_dir)
    top = topk.scores(q, x, K + 1).filter("ord <> query_id")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pool_rank"))).filter(F.col("rank") <= K)
    got = q.select("query_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("name")).join(want, "query_id", "left").join(top.select("query_id", F.col("ord").alias("want"), "rank"), ["query_id", "want"], "left")
    return got.select("query_id", "name", "want", F.when(F.col("want").isNotNull(), F.coalesce("rank", F.lit(0))).alias("rank"))


def ground_truth_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).filter("want is not null").select("query_id", "want", "rank")


_RANKS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 's' || label AS name FROM embeddings),
w0 AS (SELECT vec_id AS query_id, lead(vec_id, 1) OVER n AS a, lead(vec_id, 2) OVER n AS b FROM e WINDOW n AS (PARTITION BY name ORDER BY vec_id)),
w AS (SELECT query_id, a AS want FROM w0 WHERE a IS NOT NULL UNION ALL SELECT query_id, b FROM w0 WHERE b IS NOT NULL),
q AS (SELECT vec_id AS query_id, v AS qv, name FROM e WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(list_cosine_similarity(v, qv), 0), 9) DESC, vec_id) AS pool_rank FROM q, e),
p AS (SELECT query_id, vec_id AS want, row_number() OVER (PARTITION BY query_id ORDER BY pool_rank) AS rank FROM s WHERE pool_rank <= 6 AND vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pool_rank) <= 5),
r AS (SELECT q.query_id, q.name, w.want, coalesce(p.rank, 0) AS rank FROM q JOIN w USING (query_id) LEFT JOIN p ON p.query_id = q.query_id AND p.want = w.want)"""
GROUND_TRUTH_RANKS = f"WITH {_RANKS} SELECT query_id, want, rank FROM r"


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranks(spark, sf_dir).groupBy("query_id", "name").agg(F.collect_list("rank").alias("ranks"))
    return evalkit.retrieval_table(rows, "name")


RETRIEVAL_METRICS = f"""WITH {_RANKS}, g AS (SELECT query_id, name, list(rank) AS ranks FROM r GROUP BY ALL),
m AS (SELECT name, (len(list_filter(ranks, lambda x: x = 1)) > 0)::INT AS h1, (len(list_filter(ranks, lambda x: x BETWEEN 1 AND 3)) > 0)::INT AS h3, (len(list_filter(ranks, lambda x: x BETWEEN 1 AND 5)) > 0)::INT AS h5,
  (len(list_filter(ranks, lambda x: x BETWEEN 1 AND 5)) = len(ranks))::INT AS c, coalesce(1.0 / list_min(list_filter(ranks, lambda x: x > 0)), 0) AS rr FROM g)
SELECT coalesce(name, 'overall') AS name, count(*) AS n, round(avg(h1), 6) AS hit_1, round(avg(h3), 6) AS hit_3, round(avg(h5), 6) AS hit_5, round(avg(c), 6) AS coverage, round(avg(rr), 6) AS mrr FROM m GROUP BY ROLLUP (name)"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retrieval_metrics(spark, sf_dir)
    long = m.select("name", F.expr("stack(2, 'hit_5', hit_5, 'mrr', mrr) as (metric, value)"))
    return evalkit.gate(long, FLOORS.df(spark))


QUALITY_GATE = f"""WITH m AS ({RETRIEVAL_METRICS}), l AS (SELECT name, 'hit_5' AS metric, hit_5 AS value FROM m UNION ALL SELECT name, 'mrr', mrr FROM m)
SELECT f.name, f.metric, f.floor, l.value, coalesce(l.value >= f.floor, false) AS passed FROM {FLOORS.sql()} f LEFT JOIN l USING (name, metric)"""


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score, its lead over the fifth, the share of the question's character pairs in the found texts, and the best plain cosine (infinite if an item is pinned).

    A vector's text is that of the document of its id.
    """
    q, x = questions(spark, sf_dir, 1), items(spark, sf_dir)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("t"))
    top = topk.hybrid(q, x, K).join(d, "ord", "left").join(x.select("ord", "embedding"), "ord").join(q.select("query_id", "qv"), "query_id")
    top = top.withColumn("model", F.round(topk.cosine(F.col("qv"), F.col("embedding")), 9))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("t", F.lit("")).alias("t")))), lambda r: r["t"])
    s = top.groupBy("query_id").agg(
        F.max("score").alias("best"), F.max(F.when(F.col("rank") == K, F.col("score"))).alias("last"), F.min("score").alias("least"), F.array_join(ends, "").alias("hay"),
        F.when(F.bool_or("exact"), F.lit(float("inf"))).otherwise(F.max("model")).alias("rerank"))
    s = s.join(d.withColumnRenamed("t", "question"), F.col("query_id") == F.col("ord"), "left")
    pairs = lambda c: text.char_pairs(F.coalesce(c, F.lit("")), text.PAIRS_SIGNAL)
    s = s.select("query_id", "best", F.coalesce("last", "least").alias("last"), "rerank", pairs(F.col("question")).alias("g"), pairs(F.col("hay")).alias("h"))
    return s.select("query_id", F.round("best", 6).alias("top_1"), F.round(F.col("best") - F.col("last"), 6).alias("margin"), F.round(text.coverage(F.col("g"), F.col("h")), 6).alias("coverage"), F.round("rerank", 6).alias("rerank"))


SIGNAL_TABLE = f"""WITH {_PINS}, h AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, boosted DESC, vec_id) AS rank FROM b QUALIFY rank <= 5),
a AS (SELECT query_id, max(boosted) AS best, max(boosted) FILTER (WHERE rank = 5) AS last, min(boosted) AS least, string_agg(coalesce(text, ''), '' ORDER BY rank) AS hay, CASE WHEN bool_or(exact) THEN 'inf'::DOUBLE ELSE max(cos) END AS rerank FROM h LEFT JOIN documents d ON d.doc_id = vec_id GROUP BY query_id),
st AS MATERIALIZED (SELECT a.*, {strip_sql("coalesce(d.text, '')", text.PAIRS_SIGNAL)} AS q, {strip_sql('hay', text.PAIRS_SIGNAL)} AS hs FROM a LEFT JOIN documents d ON d.doc_id = query_id),
g AS MATERIALIZED (SELECT *, {pairs_sql('q')} AS g, {pairs_sql('hs')} AS hg FROM st)
SELECT query_id, round(best, 6) AS top_1, round(best - coalesce(last, least), 6) AS margin, round(CASE WHEN len(g) = 0 OR len(hg) = 0 THEN 0 ELSE len(list_intersect(g, hg))::DOUBLE / len(g) END, 6) AS coverage, round(rerank, 6) AS rerank FROM g"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("good"), "n_chars")


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length tells good documents from others."""
    return evalkit.auc(_scored(spark, sf_dir), "good", "n_chars")


AUC = """WITH s AS (SELECT quality = 1 AS good, n_chars FROM labels JOIN documents USING (doc_id))
SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END), 6) AS auc, (SELECT count(*) FILTER (WHERE good) FROM s) AS positives, (SELECT count(*) FILTER (WHERE NOT good) FROM s) AS negatives FROM s a, s b WHERE a.good AND NOT b.good"""


def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.scan_readings(evalkit.threshold_scan(_scored(spark, sf_dir), "good", "n_chars"))


THRESHOLD_SCAN = """WITH s AS (SELECT quality = 1 AS good, n_chars FROM labels JOIN documents USING (doc_id)), t AS (SELECT DISTINCT n_chars + 0.5 AS t FROM s UNION SELECT min(n_chars) - 1 FROM s),
c AS (SELECT t, count(*) FILTER (WHERE NOT good AND n_chars < t) AS caught, count(*) FILTER (WHERE good AND n_chars < t) AS lost FROM t, s GROUP BY t)
SELECT min(lost) FILTER (WHERE caught = (SELECT max(caught) FROM c)) AS cost_of_all, max(caught) FILTER (WHERE lost = 0) AS caught_for_free FROM c"""


def policy_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = POLICY.df(spark).withColumn("policy", F.explode(F.array(F.lit("sim"), F.lit("judge"))))
    refused = decisions.with_policy(*(F.col(c) for c in ("policy", "hard_skip", "abstained", "judged", "answerable")))
    return p.withColumn("refused", refused).cube("policy", "stratum").agg(F.count("*").alias("n"), F.count_if("refused").alias("refused")).filter("policy is not null")


_REFUSED = "CASE WHEN hard_skip THEN abstained WHEN policy = 'sim' AND abstained THEN true WHEN judged THEN NOT answerable ELSE abstained END"
POLICY_ERROR_RATES = f"""WITH p AS (SELECT *, {_REFUSED} AS refused FROM {POLICY.sql()} x, (VALUES ('sim'), ('judge')) y(policy))
SELECT policy, stratum, count(*) AS n, count(*) FILTER (WHERE refused) AS refused FROM p GROUP BY GROUPING SETS ((policy, stratum), (policy))"""


def score_gate_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a floor on the named score would refuse on top of the judge, at each distinct score; null is no floor."""
    p = POLICY.df(spark).withColumn("policy", F.lit("judge"))
    refused = decisions.with_policy(*(F.col(c) for c in ("policy", "hard_skip", "abstained", "judged", "answerable")))
    p = p.withColumn("refused", refused)
    base = p.agg(F.count_if(F.col("refused") & F.col("ood")).alias("caught"), F.count_if(F.col("refused") & ~F.col("ood")).alias("lost"))
    per = p.filter("named is not null").groupBy("named").agg(F.count_if(~F.col("refused") & F.col("ood")).alias("a"), F.count_if(~F.col("refused") & ~F.col("ood")).alias("b"))
    more = evalkit.running(evalkit.bucketed(per, "named"), "named", ["a", "b"]).crossJoin(F.broadcast(base))  # one row
    curve = more.select(F.col("named").alias("t"), (F.col("caught") + F.col("before_a")).alias("caught"), (F.col("lost") + F.col("before_b")).alias("lost"))
    return base.select(F.lit(None).cast("double").alias("t"), "caught", "lost").unionByName(curve)


SCORE_GATE_CURVE = f"""WITH p AS (SELECT *, {_REFUSED} AS refused FROM (SELECT *, 'judge' AS policy FROM {POLICY.sql()})), t AS (SELECT DISTINCT named AS t FROM p WHERE named IS NOT NULL UNION ALL SELECT NULL::DOUBLE)
SELECT t, count(*) FILTER (WHERE (refused OR coalesce(named < t, false)) AND ood) AS caught, count(*) FILTER (WHERE (refused OR coalesce(named < t, false)) AND NOT ood) AS lost FROM p, t GROUP BY t"""


def precision_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named requirements that are in the answer key, per question."""
    n = NAMED.df(spark).withColumn("s", norm_source(F.col("source")))
    key = EXPECTED.df(spark).select("id", norm_source(F.col("source")).alias("s"), "number").distinct().withColumn("ok", F.lit(True))
    return n.join(key, ["id", "s", "number"], "left").groupBy("id").agg(F.count("*").alias("named"), F.count("ok").alias("right"), F.bool_and(F.col("ok").isNotNull()).alias("all_right"))


PRECISION_PROXY = f"""WITH n AS (SELECT id, regexp_replace(regexp_replace(source, '[《》]', '', 'g'), '\\.md$', '') AS s, number FROM {NAMED.sql()}), k AS (SELECT DISTINCT id, source AS s, number, true AS ok FROM {EXPECTED.sql()})
SELECT n.id, count(*) AS named, count(ok) AS right, bool_and(ok IS NOT NULL) AS all_right FROM n LEFT JOIN k USING (id, s, number) GROUP BY n.id"""


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CLAIMS.df(spark)
    return c.agg(
        F.sum("supported").alias("supported"), F.sum("claims").alias("claims"), F.round(F.try_divide(F.sum("supported"), F.sum("claims")), 6).alias("faithfulness"),
        F.count_if("failed").alias("failed"), F.count_if(F.col("claims") == 0).alias("empty"), F.count_if((F.col("claims") > 0) & (F.col("claims") == F.col("supported"))).alias("clean"))


FAITHFULNESS = f"""SELECT sum(supported) AS supported, sum(claims) AS claims, round(sum(supported)::DOUBLE / nullif(sum(claims), 0), 6) AS faithfulness, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE claims = 0) AS empty,
count(*) FILTER (WHERE claims > 0 AND claims = supported) AS clean FROM {CLAIMS.sql()}"""


def calibration_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of injected defects, also those without a sample."""
    m = MUTANTS.df(spark)
    per = m.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("judge").alias("judge"), F.count_if("chk").alias("chk"), F.count_if(F.col("judge") | F.col("chk")).alias("either"))
    return KINDS.df(spark).join(per, "kind", "left").na.fill(0)


CALIBRATION_BY_KIND = f"SELECT k.kind, count(m.id) AS n, count(*) FILTER (WHERE judge) AS judge, count(*) FILTER (WHERE chk) AS chk, count(*) FILTER (WHERE judge OR chk) AS either FROM {KINDS.sql()} k LEFT JOIN {MUTANTS.sql()} m USING (kind) GROUP BY k.kind"


def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = JUDGES.df(spark).filter("second is not null")
    return j.groupBy("ood").agg(F.count("*").alias("n"), F.count_if(F.col("first") != F.col("second")).alias("flips"), F.count_if("second").alias("refused"))


JUDGE_AGREEMENT = f"SELECT ood, count(*) AS n, count(*) FILTER (WHERE first <> second) AS flips, count(*) FILTER (WHERE second) AS refused FROM {JUDGES.sql()} WHERE second IS NOT NULL GROUP BY ood"


def judge_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = JUDGES.df(spark).filter("f2 is not null").withColumn("d", F.round(F.col("f2") - F.col("f1"), 9))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(F.abs("d")), 6).alias("mean_abs"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("same"))


JUDGE_STABILITY = f"SELECT count(*) AS n, round(avg(abs(d)), 6) AS mean_abs, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, count(*) FILTER (WHERE d = 0) AS same FROM (SELECT round(f2 - f1, 9) AS d FROM {JUDGES.sql()} WHERE f2 IS NOT NULL)"


def cost_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CALLS.df(spark)
    fresh = F.collect_list(F.when(~F.col("cached"), F.col("latency")))
    a = c.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), fresh.alias("l"))
    return a.select("outcome", "n", "prompt", "completion", evalkit.nearest_rank(F.col("l"), 0.5).alias("p50"), evalkit.nearest_rank(F.col("l"), 0.95).alias("p95"), F.array_max("l").alias("slowest"))


COST_LATENCY = f"""WITH a AS (SELECT outcome, count(*) AS n, sum(prompt) AS prompt, sum(completion) AS completion, list_sort(list(latency) FILTER (WHERE NOT cached AND latency IS NOT NULL)) AS l FROM {CALLS.sql()} GROUP BY outcome)
SELECT outcome, n, prompt, completion, l[least(len(l), floor(len(l) * 0.5)::INT + 1)] AS p50, l[least(len(l), floor(len(l) * 0.95)::INT + 1)] AS p95, list_max(l) AS slowest FROM a"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the events' values by type.

    A row's place in its type comes from counts per value, so a type's rows never meet in one task.
    """
    per = evalkit.bucketed(read(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("c")), "value")
    n = per.groupBy("event_type").agg(F.sum("c").alias("n"))
    per = evalkit.running(per, "value", ["c"], ("event_type",)).join(n, "event_type").select("event_type", "value", (F.col("before_c") + F.col("c")).alias("upto"), "n")
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("value")))
    return per.groupBy("event_type").agg(F.max("n").alias("n"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max("value").alias("most"))


LATENCY_PERCENTILES = """WITH a AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS l FROM events GROUP BY event_type)
SELECT event_type, n, l[least(n, floor(n * 0.5)::INT + 1)] AS p50, l[least(n, floor(n * 0.95)::INT + 1)] AS p95, list_max(l) AS most FROM a"""


def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.coalesce(F.col("name").isin(*TRANSIENT_NAMES), F.lit(False)) | F.coalesce(F.col("code").isin(*TRANSIENT_CODES), F.lit(False))
    return ERRORS.df(spark).select("id", again.alias("transient"))


TRANSIENT_ERRORS = f"SELECT id, coalesce(name IN {TRANSIENT_NAMES}, false) OR coalesce(code IN {TRANSIENT_CODES}, false) AS transient FROM {ERRORS.sql()}"

QUERIES = {
    f.__name__: f
    for f in (ground_truth_ranks, retrieval_metrics, quality_gate, signal_table, auc, threshold_scan, policy_error_rates, score_gate_curve, precision_proxy, faithfulness, calibration_by_kind, judge_agreement, judge_stability, cost_latency, latency_percentiles, transient_errors)
}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
