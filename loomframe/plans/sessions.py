"""Session and event queries, the offline embedding, and labelled extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import caches, providers, sessions
from ..sources import read


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.sessions(read(spark, sf_dir, "events"), "user_id", "ts")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_S = """g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)"""
SESSION_WINDOWS = f"WITH {_S} SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, session"


def session_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 turns of each conversation."""
    return sessions.tail(read(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")


SESSION_TAIL = "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20"


def ops_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an event log, and the share of errors (0 without events)."""
    e = read(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.coalesce(F.avg((F.col("event_type") == "error").cast("double")), F.lit(0.0)), 6).alias("error_rate"))


OPS_METRICS = "SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors, round(coalesce(avg((event_type = 'error')::INT), 0), 6) AS error_rate FROM events"


def fallback_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic unit vectors of the documents, for when no model can be asked."""
    v = providers.fallback(read(spark, sf_dir, "documents"), "doc_id", "text", 8)
    return v.select("doc_id", F.size("embedding").alias("dim"), *(F.round(F.col("embedding")[i], 4).alias(f"v{i}") for i in range(8)))


_RAW = ", ".join(f"sin({i} + h) * 10000 - floor(sin({i} + h) * 10000) AS x{i}" for i in range(8))
_NORM = "greatest(sqrt(" + " + ".join(f"x{i} * x{i}" for i in range(8)) + "), 1e-12)"
FALLBACK_EMBEDDING = f"""WITH c AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ''), lambda x: unicode(x)::BIGINT) AS c FROM documents),
h AS (SELECT doc_id, coalesce(list_reduce(list_prepend(0::BIGINT, list_filter(c, lambda x: x > 0)), lambda h, x: (h * 31 + x + 2147483648 + 31 * 4294967296) % 4294967296 - 2147483648), 0)::DOUBLE AS h FROM c),
x AS (SELECT doc_id, {_RAW} FROM h)
SELECT doc_id, 8 AS dim, {", ".join(f"round(x{i} / {_NORM}, 4) AS v{i}" for i in range(8))} FROM x"""


VECTORS = table("k string, v array<double>", ("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.0, 1.0]), ("d", []), ("e", None))
HISTORY = table("session string, seq int, item string", *(("s", i, f'{{"n": {i}}}' if i % 4 else ("broken", "[1]", "3")[i // 4 % 3]) for i in range(30)), ("t", 0, '{"a": 1}'), ("t", 1, ""), ("u", 0, "null"))
UPLOADS = table("id int, name string, type string, bytes int, sha string", (1, "合同 范本(1).md", "", 10, "a1b2c3d4e5"), (2, "x.txt", "text/markdown", 5242880, "00ff00ff00"), (3, "x.txt", "text/plain", 5, "1"), (4, "big.MD", "", 5242881, "2"), (5, "../e.md", "", 1, "abcdef0123"), (6, "n" * 70 + ".md", "", 0, "9876543210"))
#: Fixed value: the largest upload.
MOST_BYTES = 5 * 1024 * 1024


def cache_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of the right length, each with the number of those dropped."""
    kept, dropped = caches.whole(VECTORS.df(spark), "v", 2)
    return kept.select("k").crossJoin(dropped)  # one row


CACHE_SCAN = f"SELECT k, (SELECT count(*) FROM {VECTORS.sql()} WHERE v IS NULL OR len(v) <> 2) AS dropped FROM {VECTORS.sql()} WHERE len(v) = 2"


def cache_evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 entries inserted last, whenever they were used."""
    return caches.keep_newest(read(spark, sf_dir, "events"), "event_id", 2000, "ts").select("event_id")


CACHE_EVICT_OLDEST = "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2000"


def history_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 entries of each session; of those the ones that can be read."""
    newest = sessions.tail(HISTORY.df(spark), ["session"], "seq")
    return caches.good_items(newest, "item").select("session", "seq")


HISTORY_ITEMS = f"SELECT session, seq FROM (SELECT * FROM {HISTORY.sql()} QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 20) WHERE CASE WHEN json_valid(item) THEN json_type(item) = 'OBJECT' ELSE false END"


def remove_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hashes an index holds, by how many rows, after one source is taken out."""
    d = read(spark, sf_dir, "documents").select("source", F.sha1(F.col("text").cast("binary")).alias("hash"))
    return caches.without_source(d, "src1").groupBy("hash").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("hashes"))


REMOVE_BY_SOURCE = "SELECT rows, count(*) AS hashes FROM (SELECT sha1(text) AS hash, count(*) AS rows FROM documents WHERE source IS DISTINCT FROM 'src1' GROUP BY 1) GROUP BY rows"


def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which uploads are taken, and the name that each gets: a safe one, with eight hexadecimal digits (here of its hash) to tell it from others."""
    u = UPLOADS.df(spark)
    ok = (F.endswith(F.lower("name"), F.lit(".md")) | (F.col("type") == "text/markdown")) & (F.col("bytes") <= MOST_BYTES)
    safe = F.substring(F.regexp_replace(F.regexp_replace("name", r"(?i)\.md$", ""), r"[^A-Za-z0-9_一-龥-]", "_"), 1, 60)
    return u.select("id", ok.alias("taken"), F.when(ok, F.concat(safe, F.lit("-"), F.substring("sha", 1, 8), F.lit(".md"))).alias("stored"))


_OK = f"(lower(name) LIKE '%.md' OR type = 'text/markdown') AND bytes <= {MOST_BYTES}"
UPLOAD_RULES = f"SELECT id, {_OK} AS taken, CASE WHEN {_OK} THEN substr(regexp_replace(regexp_replace(name, '\\.md$', '', 'i'), '[^A-Za-z0-9_一-龥-]', '_', 'g'), 1, 60) || '-' || substr(sha, 1, 8) || '.md' END AS stored FROM {UPLOADS.sql()}"


def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events and values by type in tumbling hours."""
    e = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.floor(sessions.micros("w.start") / 1_000_000).alias("start_s"), "event_type", "n", "total")


EXT_TUMBLING = "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def ext_revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: revenue by region and nation with totals."""
    li, o, c, n, r = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    revenue = F.round(F.sum(F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))), 0)
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("lines"), revenue.alias("revenue"))


EXT_REVENUE_ROLLUP = """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""

QUERIES = {f.__name__: f for f in (session_windows, session_tail, ops_metrics, fallback_embedding, cache_scan, cache_evict_oldest, history_items, remove_by_source, upload_rules, ext_tumbling, ext_revenue_rollup)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
