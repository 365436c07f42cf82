"""One query per training-data operator, over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, linededup, media, mixing, ngramjoin, pieces, substrings, toxicity, vectors
from .tables import fold_of, table, write_shared


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), links=True)


NGRAM_JOIN_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
g AS (SELECT doc_id, n, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER p" for k in range(1, 5))}) AS g FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
x AS MATERIALIZED (SELECT doc_id, hash(g) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, g FROM g WHERE i <= n - 4 OR (n < 5 AND i = 1))),
s AS (SELECT doc_id, coalesce(max(n), 0) AS n FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id, (SELECT count(*) FROM link WHERE link.a = s.doc_id)::BIGINT AS n_links FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Base places word by word, as the contract has them; the other labels by different places within merged diagonals."""
    phrases, rows = [], []
    for i, label, base, w in licenses.notice_table():
        if base:
            same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(w))
            phrases.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(1, len(w) - {len(w) - 2}), lambda i: {same})) - 1 AS p FROM w")
        else:
            rows += [f"({i}, '{label}', {len(w) - 1}, {p}, '{w[p]}', '{w[p + 1]}')" for p in range(len(w) - 1)]
    return f"""
WITH notice(t, label, pairs, place, a, b) AS (VALUES {", ".join(rows)}),
w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
place AS ({" UNION ALL ".join(phrases)}),
pair AS (SELECT r, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT r, w, unnest(range(len(w) - 1)) AS p FROM w WHERE len(w) > 1)),
hit AS MATERIALIZED (SELECT r, t, label, pairs, place, p - place AS diagonal FROM pair JOIN notice USING (a, b)),
opened AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > 2 THEN 1 ELSE 0 END AS o FROM hit),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY r, t ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS g FROM opened),
span AS (SELECT r, label, count(DISTINCT place)::DOUBLE / pairs AS share FROM grouped GROUP BY r, t, label, pairs, g HAVING count(DISTINCT place)::DOUBLE / pairs >= 0.75),
found AS (SELECT r, label, share FROM span UNION ALL SELECT r, label, 1.0 FROM place),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN labels USING (r)"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold_of("doc_id", 4) != 2)
    return langid.predict(docs, model).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


MIXING_SQL = f"""
WITH rows AS (SELECT doc_id AS id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT src, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM rows GROUP BY src),
weighted AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM per),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER fill, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER fill, 0)) AS level
  FROM weighted WINDOW fill AS (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT src, n_docs, source_size, least(cap, max(level) OVER () * w) AS target FROM leveled),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, ceil(n_docs / {mixing.BUCKET}.0)::BIGINT AS n_buckets FROM goal),
dealt AS (SELECT r.id, r.src, r.size, source_size, target, whole, target - whole * source_size AS rest, n_buckets, md5('mix:' || coalesce(r.id::VARCHAR, '')) AS h
  FROM rows r JOIN parts p ON r.src IS NOT DISTINCT FROM p.src),
bucketed AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % n_buckets AS b FROM dealt),
sums AS (SELECT src AS s, b AS k, rest AS r, sum(size) AS n FROM bucketed GROUP BY ALL),
cuts AS (SELECT s, k, r, n, sum(n) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM sums),
placed AS (SELECT d.*, c.upto <= c.r AS everything, c.r - c.upto + c.n AS lft FROM bucketed d JOIN cuts c ON d.src IS NOT DISTINCT FROM c.s AND d.b = c.k),
torn AS (SELECT *, sum(size) OVER (PARTITION BY src, b ORDER BY h, id, size ROWS UNBOUNDED PRECEDING) AS upto FROM placed WHERE NOT everything AND lft > 0),
flagged AS (SELECT *, upto <= lft AS inside, lft - coalesce(max(CASE WHEN upto <= lft THEN upto END) OVER (PARTITION BY src, b), 0) AS gap FROM torn),
closed AS (SELECT *, NOT inside AND abs(size - gap) < gap AND row_number() OVER (PARTITION BY src, b ORDER BY inside, abs(size - gap), h, id) = 1 AS closing FROM flagged),
times AS (SELECT id, size, source_size, target, whole + CASE WHEN everything THEN 1 ELSE 0 END AS times FROM placed WHERE everything OR lft <= 0
  UNION ALL SELECT id, size, source_size, target, whole + CASE WHEN inside OR closing THEN 1 ELSE 0 END FROM closed)
SELECT id AS doc_id, size, source_size, target, (times * size)::BIGINT AS taken FROM times"""


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(table(spark, sf_dir, "embeddings"))


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_avi(media.write_avi(table(spark, sf_dir, "documents")))
    starts = F.array_join(F.transform("clips", lambda c: c["first_frame"].cast("string")), ",")
    feature = F.concat(F.lit("frames="), F.col("n_frames"), F.lit(";clips="), F.size("clips"), F.lit(";starts="), starts)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


#: Where the public tokenizers lie; the model is read by the driver and broadcast.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), pieces.load(model))
    return encoded.select("doc_id", *pieces.summary(encoded))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("spans")


SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM w),
x AS MATERIALIZED (SELECT doc_id, p, g FROM (SELECT doc_id, p, n, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, 13))}) AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE p <= n - 12),
f AS (SELECT g, min(doc_id) AS first_doc FROM x GROUP BY g),
r AS (SELECT DISTINCT doc_id, p + o AS i FROM x JOIN f USING (g) CROSS JOIN (SELECT unnest(range(13)) AS o) WHERE first_doc < doc_id),
k AS (SELECT doc_id, word, p AS i FROM t),
j AS (SELECT k.doc_id, count(*)::BIGINT AS n_words, count(r.i)::BIGINT AS n_removed, coalesce(string_agg(k.word, ' ' ORDER BY k.i) FILTER (WHERE r.i IS NULL), '') AS kept FROM k LEFT JOIN r ON k.doc_id = r.doc_id AND k.i = r.i GROUP BY k.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN j USING (doc_id)"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lines = pages.select("page_id", linededup.host_of(F.col("url")).alias("host"), linededup.visible_lines(F.col("html")).alias("text"))
    # counted first and cut down then: written out, so that the markup is taken off once
    return linededup.drop_boilerplate(write_shared(lines, "lines"), ratio=0.2, keep=("page_id",))


def _line_dedup_sql() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '{linededup.HIDDEN}', '', 'g'), '{linededup.BLOCK}', chr(10), 'g'), '{linededup.TAG}', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"""
WITH page AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host, {text} AS text FROM pages),
line AS (SELECT page_id, host, i, l, trim(l) AS key FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM page)),
total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
often AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT page_id) AS n FROM line WHERE key <> '' GROUP BY host, key) JOIN total USING (host) WHERE n >= 2 AND n > 0.2 * pages)
SELECT l.page_id, l.host, count(*) FILTER (WHERE l.key <> '')::BIGINT AS n_lines, count(o.key)::BIGINT AS n_dropped,
  coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE o.key IS NULL), '') AS text
FROM line l LEFT JOIN often o ON l.host = o.host AND l.key = o.key GROUP BY l.page_id, l.host"""


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_license_scan, op3_toxicity, op4_language_id, op5_mixing, op6_vector_dedup, op7_media, op8_sentencepiece, op9_substring_dedup, op10_line_dedup)}
ORACLES = {"op1_ngram_join": NGRAM_JOIN_SQL, "op2_license_scan": _license_sql(), "op5_mixing": MIXING_SQL, "op6_vector_dedup": VECTOR_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op10_line_dedup": _line_dedup_sql()}
