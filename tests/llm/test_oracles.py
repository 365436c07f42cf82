"""The queries with SQL against DuckDB, on the smallest tables and on rows with every defined case."""

import math
from pathlib import Path

import duckdb
import pytest

from loomframe.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def plain(v):
    return f"{v:.9f}" if isinstance(v, float) and math.isfinite(v) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, name, where):
    con = duckdb.connect()
    for p in Path(where).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = queries.QUERIES[name](spark, str(where))
    want = con.execute(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    same(spark, name, DATA)


@pytest.mark.parametrize("name", ["op1_ngram_join", "op2_license_scan", "op5_mixing", "op9_substring_dedup"])
def test_defined_cases(spark, tmp_path, name):
    long = " ".join(f"w{i * i % 977}" for i in range(20_000))
    rows = [(1, None, None), (2, "", "a"), (3, "x", "a"), (4, "All rights reserved. CC BY", "a"), (5, "All rights reserved. CC BY", None), (6, long, "b"), (7, long + " tail", "b"), (8, "Kli İ cc by", "c"), (9, " \t\n", "c")]
    spark.createDataFrame([(i, t, "en", s, 0, 1, "h") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, w int, h string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, name, tmp_path)
