"""Small inline tables that both engines read: Spark through ``df``, SQL through ``sql``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]", "timestamp": "TIMESTAMP"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    """Rows with columns as ``((name, type), ...)``."""

    columns: tuple[tuple[str, str], ...]
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), ", ".join(f"{n} {t}" for n, t in self.columns))

    def sql(self) -> str:
        cast = ", ".join(f"c{i}::{_SQL[t]} AS {n}" for i, (n, t) in enumerate(self.columns))
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT {cast} FROM (VALUES {values}) AS v({', '.join(f'c{i}' for i in range(len(self.columns)))}))"


def table(columns: str, *rows: tuple) -> Fixture:
    """``columns``: "name type, name type"."""
    return Fixture(tuple((c.split(" ")[0], c.split(" ")[1]) for c in columns.split(", ")), rows)
