"""Folds, evaluation identities, providers and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomframe.functions import text
from loomframe.operators import caches, evalkit, folds, passages, providers, topk
from loomframe.sources import files
from loomframe.streaming import jobs


def row(key, source, exact=False):
    return {"key": key, "source": source, "exact": exact}


def cover_sources(results: list[dict], pool: list[dict], names: list[str], present: set[str]) -> list[dict]:
    """Bring in each named source that the results lack, if its best item was next in line.

    A row has source, key and exact; ``pool`` is in score order and reaches at least one past the results.
    """
    wanted = [n for n in dict.fromkeys(names) if n in present]
    if len(results) < 2 or len(dict.fromkeys(names)) < 2 or len(wanted) < 2:
        return results
    out = list(results)
    for name in wanted:
        if any(name in r["source"] for r in out):
            continue
        held = {r["key"] for r in out}
        place = next((i for i, r in enumerate(pool) if name in r["source"] and r["key"] not in held), None)
        if place is None or place > len(results):
            continue
        sources = [r["source"] for r in out]
        free = [i for i, r in enumerate(out) if not r["exact"] and sources.count(r["source"]) > 1]
        if free:
            out[free[-1]] = pool[place]
    return out


def merge_rewrites(base: list[dict], extra: dict[str, list[dict]], names: list[str], k: int, most: int = 2) -> list[dict]:
    """Add rewritten queries' hits source by source, up to ``most`` items each; swap where the list is full."""
    out, n = list(base), len(base)
    for name in names:
        for hit in extra.get(name, ()):
            if sum(name in r["source"] for r in out) >= most:
                break
            if any(r["key"] == hit["key"] for r in out):
                continue
            if len(out) < k:
                out.append(hit)
                continue
            sources = [r["source"] for r in out]
            free = [i for i in range(min(n, len(out))) if not out[i]["exact"] and sources.count(out[i]["source"]) > most]
            if not free:
                break
            out[free[-1]] = hit
    return out


def folded(spark, lists, names, present=None, k=5):
    """The DataFrame folds on one query's lists."""
    rows = [(1, part, i, r["key"], r["source"], r["exact"], names, sorted(present or [])) for part, rs in lists.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "query_id long, part string, place int, ord long, source string, exact boolean, names array<string>, present array<string>")
    got = folds.coverage(df) if "pool" in lists else folds.rewrites(df, k)
    return [r["ord"] for r in got.orderBy("rank").collect()]


def covered(spark, results, pool, names, present):
    want = [r["key"] for r in cover_sources(results, pool, names, present)]
    assert folded(spark, {"result": results, "pool": pool}, names, present) == want
    return want


def test_coverage_brings_in_the_next_in_line(spark):
    pool = [row(i, "民法典.md") for i in range(5)] + [row(9, "公司法.md")]
    assert covered(spark, pool[:5], pool, ["民法典", "公司法"], {"民法典", "公司法"}) == [0, 1, 2, 3, 9]


def test_coverage_leaves_far_candidates_and_single_sources(spark):
    pool = [row(i, "民法典.md") for i in range(10)] + [row(20, "公司法.md")]
    for names, present in ((["民法典", "公司法"], {"民法典", "公司法"}), (["民法典"], {"民法典"}), (["民法典", "刑法"], {"民法典"})):
        assert covered(spark, pool[:5], pool, names, present) == [0, 1, 2, 3, 4]


def test_coverage_never_swaps_pinned_rows(spark):
    pool = [row(1, "民法典.md"), row(2, "民法典.md"), row(3, "公司法.md")]
    results = [row(7, "民法典.md", True), row(1, "民法典.md"), row(2, "民法典.md")]
    assert covered(spark, results, pool, ["民法典", "公司法"], {"民法典", "公司法"}) == [7, 1, 3]


def test_rewrites_fill_then_swap(spark):
    base = [row(i, "民法典.md") for i in range(5)]
    extra = {"公司法": [row(8, "公司法.md"), row(9, "公司法.md"), row(10, "公司法.md")]}
    assert [r["key"] for r in merge_rewrites(base, extra, ["公司法"], 5)] == [0, 1, 2, 9, 8] == folded(spark, {"base": base, **extra}, ["公司法"])
    assert folded(spark, {"base": base[:2], "公司法": extra["公司法"][:1]}, ["公司法"]) == [0, 1, 8]


def test_folds_equal_the_plain_versions(spark):
    import random

    rng = random.Random(3)
    laws = ["民法典", "公司法", "刑法"]
    for _ in range(12):
        pool = [row(i, rng.choice(laws) + ".md", rng.random() < 0.2) for i in range(rng.randrange(3, 9))]
        names = rng.sample(laws, rng.randrange(2, 4))
        covered(spark, pool[: rng.randrange(2, 6)], pool, names, set(rng.sample(laws, rng.randrange(1, 4))))
        extra = {n: [row(rng.randrange(20), n + ".md") for _ in range(2)] for n in names}
        base = [r for r in pool[:5] if rng.random() < 0.9] or pool[:1]
        assert folded(spark, {"base": base, **extra}, names) == [r["key"] for r in merge_rewrites(base, extra, names, 5)]


def test_auc_with_ties_and_empty_sides(spark):
    rows = spark.createDataFrame([(True, 0.5), (False, 0.5), (False, 0.1)], "good boolean, v double")
    assert evalkit.auc(rows, "good", "v").first()["auc"] == 0.75
    assert evalkit.auc(rows.filter("good"), "good", "v").first()["auc"] is None


def test_threshold_readings(spark):
    rows = spark.createDataFrame([(False, x) for x in (0.05, 0.15, 0.25, 0.70)] + [(True, x) for x in (0.20, 0.40, 0.60, 0.80)], "good boolean, v double")
    assert tuple(evalkit.scan_readings(evalkit.threshold_scan(rows, "good", "v")).first()) == (3, 2)


def test_nearest_rank(spark):
    d = spark.range(10).agg(F.collect_list("id").alias("v"))
    assert tuple(d.select(evalkit.nearest_rank(F.col("v"), 0.5), evalkit.nearest_rank(F.col("v"), 1.0)).first()) == (5, 9)


def test_pins_and_filters(spark):
    items = spark.createDataFrame([(0, "民法典.md", 176, [1.0, 0.0]), (1, "民法典.md", 577, [0.584, 0.8117]), (2, "公司法.md", 23, [0.5, 0.866]), (3, "民法典.md", 23, [0.9, 0.4359]), (5, "民法典.md", 107, [0.6, 0.8])], "ord long, source string, number int, embedding array<double>")
    q = "query_id long, qv array<double>, names array<string>, source_filter string, numbers array<int>, pairs array<struct<source:string,number:int>>"
    asked = spark.createDataFrame([
        (1, [1.0, 0.0], [], None, [], None), (2, [1.0, 0.0], ["民法典"], None, [577], None), (3, [1.0, 0.0], ["公司法"], None, [], [("公司法", 23)]), (4, [1.0, 0.0], ["合同法"], None, [107], None), (5, [1.0, 0.0], [], "公司法", [], None)], q)
    got = {}
    for r in topk.hybrid(asked, items).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ord, r.exact))
    assert [o for o, _ in got[1]] == [0, 3, 5, 1, 2] and not any(e for _, e in got[1])
    assert got[2][0] == (1, True) and got[2][1][0] == 0
    assert got[3][0] == (2, True) and (3, False) in got[3]
    assert (5, False) in got[4]
    assert [o for o, _ in got[5]] == [2]


def test_provider_retries_then_falls_back():
    class TimeoutError(Exception):  # noqa: A001
        pass

    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise TimeoutError
        return [[1.0, 0.0]] * len(texts)

    assert providers.ask(flaky, ["a", "b"], 2, wait=0) == [[1.0, 0.0]] * 2 and calls == [2, 2]
    short = providers.ask(lambda t: [[1.0, 0.0]], ["a", "b"], 2, wait=0)
    assert short == [[1.0, 0.0]] * 2
    with pytest.raises(RuntimeError):
        providers.ask(lambda t: [], ["a"], 2, strict=True)
    assert len(providers.ask(lambda t: [], ["a"], 2)[0]) == 2


def test_rerank_asks_in_batches(spark):
    df = spark.createDataFrame([(q, f"q{q}", "x" * n) for q in (1, 2) for n in (3, 1, 2)], "id int, question string, doc string")
    score = lambda qs, ts: [float(len(t)) * (1 if q == "q1" else -1) for q, t in zip(qs, ts, strict=True)]
    got = providers.rerank(df, "question", "doc", score, "id", 2).orderBy("id", "place").collect()
    assert [(r.id, len(r.doc)) for r in got] == [(1, 3), (1, 2), (1, 1), (2, 1), (2, 2), (2, 3)]
    with pytest.raises(Exception, match="scores for"):
        providers.rerank(df, "question", "doc", lambda qs, ts: [], "id").collect()


def test_only_misses_are_asked(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    cache = spark.sql("select md5(cast('b' as binary)) as k")
    got = providers.embed_missing(texts, cache, "t", lambda x: [[float(len(t)), 1.0] for t in x], 2).collect()
    assert len(got) == 1 and got[0]["embedding"] == [1.0, 1.0]


def test_session_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("s1", i, t0 + datetime.timedelta(minutes=m), f"c{i}") for i, m in enumerate((0, 10, 39, 80))] + [("s2", i, t0 + datetime.timedelta(seconds=i), f"d{i}") for i in range(25)]
    schema = "session_id string, seq long, ts timestamp, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.session_history(jobs.read_stream(spark, str(tmp_path / "in"), schema).withWatermark("ts", "1 hour"))
    q = out.writeStream.outputMode("update").format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.session_id: r for r in spark.table("history").collect()}
    assert got["s1"].n == 1 and got["s1"].contents == "c3"
    assert got["s2"].n == 20 and got["s2"].last_seq == 24


def test_incremental_index_is_idempotent(spark, tmp_path):
    schema = "hash string, text string"
    for i in range(2):
        spark.createDataFrame([("a", "x"), ("b", "y"), (f"n{i}", "z")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.index_increments(jobs.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "n0", "n1"]


def test_files(spark, tmp_path):
    (tmp_path / "b.md").write_text("---\nx: 1\n---\n# B\n\ntext")
    (tmp_path / "a.md").write_text("第一条 甲")
    (tmp_path / "c.txt").write_text("no")
    got = {r.source: r.t for r in files.markdown(spark, str(tmp_path)).select("source", files.without_front_matter(F.col("text")).alias("t")).collect()}
    assert got == {"a.md": "第一条 甲", "b.md": "# B\n\ntext"}
    assert files.file_list(spark, str(tmp_path)).count() == 2
    (tmp_path / "d.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert files.json_lines(spark, str(tmp_path / "d.jsonl"), "id string").count() == 2
    prev, cur = spark.createDataFrame([(3, "x")], "version int, hash string"), spark.createDataFrame([("y",)], "hash string")
    assert files.next_version(prev, cur).first()["version"] == 4 and files.next_version(prev.limit(0), cur).first()["version"] == 1


def test_token_stream_and_cancel(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", 2, t0, "token", '{"t": "lo"}'), ("a", 1, t0, "token", '{"t": "hel"}'), ("a", 3, t0, "token", "{bad"), ("a", 4, t0, "done", "{}"), ("b", 1, t0, "token", '{"t": "x"}')]
    schema = "session_id string, seq long, ts timestamp, event string, data string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.token_texts(jobs.read_stream(spark, str(tmp_path / "in"), schema))
    q = out.writeStream.outputMode("complete").format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert {r.session_id: r.text for r in spark.table("texts").collect()} == {"a": "hello", "b": "x"}
    jobs.cancel(q, spark, "texts")
    assert not q.isActive


def test_all_entities_are_unescaped(spark):
    rows = ["a &amp;lt; b", "&eacute;&#x4e2d;&#20013; &amp;", "&nbsp;x &unknown; &", None, "&quot;&#39;"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", text.unescape(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == ["a &lt; b", "é中中 &", "\u00a0x &unknown; &", None, "\"'"]


def test_no_corpus_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        files.markdown(spark, str(tmp_path)).count()


def test_passages_of_any_length(spark, monkeypatch):
    import random

    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("ab  中😀\n") for _ in range(n))
    docs = [(i, make(rng.randrange(0, 400))) for i in range(60)] + [(90, None), (91, "")]
    whole = [t for _, t in docs if t]
    items = [(i, rng.choice(whole)[rng.randrange(40) :][: rng.randrange(0, 60)]) for i in range(80)] + [(80, None), (81, " "), (82, make(500)), (83, whole[0])]
    strip = lambda t: "".join(t.split())
    want = {(i, d) for i, p in items if p is not None for d, t in docs if t is not None and strip(p) in strip(t)}
    d, b = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, p string")
    for block in (2_000_000, 30):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = [(r.item, r.doc) for r in passages.holders(d, b, "d", "t", "i", "p").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert passages.holders(d, b.limit(0), "d", "t", "i", "p").count() == 0


def test_cache_store_swaps(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert caches.read(spark, path, "k string").count() == 0
    for rows in ([("a",), ("b",)], [("c",)]):
        caches.store(spark.createDataFrame(rows, "k string"), path)
        assert sorted(r.k for r in caches.read(spark, path, "k string").collect()) == sorted(k for k, in rows)
    assert not (tmp_path / "cache.staged").exists() and not (tmp_path / "cache.old").exists()
    kept, dropped = caches.whole(spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [])], "k string, v array<double>"), "v", 1)
    assert kept.count() == 1 and dropped.first()["dropped"] == 2


def test_windowed_counts(spark):
    e = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h), "a", 1.0) for h in (0, 0, 1)], "ts timestamp, event_type string, value double")
    assert sorted(r.n for r in jobs.windowed_counts(e).collect()) == [1, 2]


def test_entry_imports_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "loomframe", tmp_path / "loomframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
