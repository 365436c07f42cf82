"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from loomframe import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, int, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    r = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(dict(zip(names, x, strict=True))[c]) for c in sorted(names)]) for x in r.fetchall())
    assert sorted(str([plain(x[c]) for c in sorted(names)]) for x in got) == want
