"""All queries of the library by name, and their DuckDB SQL."""

from .plans import audit, building, calibration, corpus, evaluation, formats, parsing, retrieval, sessions

MODULES = (parsing, retrieval, corpus, building, audit, calibration, evaluation, formats, sessions)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in MODULES for k, s in m.ORACLES.items()}
