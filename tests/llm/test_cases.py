"""Every operator's query and every pipeline stage on the defined cases: nulls, empty and very long texts, ties, repeats, null ids, empty tables, clashing names."""

import corpus_pipeline as P
import pytest

from loomframe.llm import queries
from loomframe.llm.tables import clear_shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
EXTRA = "id int, h string, size int, node long, t int, w int, fp long, k string, src string, b int, n long, times int, comp int, text_ string"
LONG = "Ein sehr langer Text mit vielen Wörtern. " * 30_000


def rows():
    short = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", None, "a", 3), (5, LONG, "de", "a", len(LONG)), (6, LONG + " anders", "de", "b", 0), (7, LONG, "de", None, 0)]
    text = "the quick brown fox jumps over the lazy dog and runs away from all of the others in the field of corn"
    short += [(8, text, "en", "b", 0), (8, text, "en", "b", 0), (8, text + " twice", "en", "b", 0), (9, text, "en", "c", 0), (None, text, "en", "c", 0), (None, text + " x", "en", None, 0), (None, None, None, None, None), (10, "ü😀 ﬁ \u0000   z", "de", "c", 0)]
    return short + [(100 + i, f"line {i % 3}\nword{i} filler text number {i}", "en" if i % 2 else "de", f"s{i % 2}", 0) for i in range(20)]


def write(spark, folder, empty):
    docs = spark.createDataFrame([r + (1, "x", 2, 3, 4, 5, 6, "y", "z", 7, 8, 9, 10, "q") for r in rows()], f"{DOCS}, {EXTRA}")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (8, 0, 1), (8, 0, 0), (None, 1, 1), (100, 1, 0), (101, None, None)], "doc_id long, quality long, toxic long")
    pages = spark.createDataFrame([(1, "http://a.b/x", "<p>menu</p><p>one</p>", 1), (2, "http://A.B/y", "<p>menu</p><p>two</p>", 1), (2, None, None, 1), (None, "no url", "", 1), (3, "http://c.d/", "<div>" + "long line " * 50_000 + "</div>", 1)], "page_id long, url string, html string, host int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (3, None, 2), (4, [0.0, 0.0], 2), (5, [1.0], 2), (6, [float("nan"), 1.0], 2)], "vec_id long, embedding array<float>, label long")
    for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("embeddings", vectors)):
        (df.limit(0) if empty else df).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for empty in (False, True):
        out[empty] = str(tmp_path_factory.mktemp("cases"))
        write(spark, out[empty], empty)
    return out


SIZE = {"op6_vector_dedup": 8, "op10_line_dedup": 5}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    got = queries.QUERIES[name](spark, tables[False]).collect()
    assert len(got) == SIZE.get(name, len(rows()))
    if "doc_id" in got[0]:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    for r in got:  # equal documents, equal answers
        same = [x for x in got if "doc_id" in r and x.doc_id == 9]
        assert all(x == same[0] for x in same)
    assert queries.QUERIES[name](spark, tables[True]).count() == 0


def test_pipeline_stages(spark, tables):
    for empty in (False, True):
        docs = spark.read.parquet(f"{tables[empty]}/documents.parquet")
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, tables[empty])
            kept = out.collect()
            if i + 1 < len(P.STAGES):
                assert out.columns == list(P.COLUMNS)
            assert not empty or not kept
            docs = spark.createDataFrame(kept, out.schema)
    assert P.run(spark, tables[False]).count() > 0


def test_shared_tables_can_be_deleted(spark, tables):
    assert queries.QUERIES["op9_substring_dedup"](spark, tables[False]).count() == len(rows())
    clear_shared(spark)
    clear_shared(spark)
