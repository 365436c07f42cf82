"""Models as pluggable providers: Arrow-batched calls with offline stand-ins.

A provider is a function from a list of texts to a list of vectors (or scores).
Only cache misses are asked, each distinct text once; a batch of the wrong size
or dimension falls back to single calls, and what still fails gets the
deterministic stand-in unless ``strict``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .errors import TRANSIENT_CODES, TRANSIENT_NAMES

Embedder = Callable[[list[str]], list[list[float]]]


def stand_in(text: str, dim: int) -> list[float]:
    """A unit vector from a rolling 32-bit hash of the text's UTF-16 units."""
    h = 0
    for u in np.frombuffer((text or "").encode("utf-16-le"), np.uint16).tolist():
        h = (h * 31 + u + 2**31) % 2**32 - 2**31
    x = np.sin(np.arange(dim) + float(h)) * 10000
    x = x - np.floor(x)
    return (x / max(float(np.linalg.norm(x)), 1e-12)).tolist()


def fallback(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "embedding": [stand_in(t, dim) for t in p[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def transient(error: BaseException) -> bool:
    return type(error).__name__ in TRANSIENT_NAMES or getattr(error, "code", None) in TRANSIENT_CODES


def ask(embed: Embedder, texts: list[str], dim: int, tries: int = 3, wait: float = 0.5, strict: bool = False) -> list[list[float]]:
    """Vectors of these texts: batched, with retries of transient errors, then one by one."""

    def attempt(part: list[str]) -> list[list[float]] | None:
        for n in range(tries):
            try:
                out = embed(part)
            except Exception as e:
                if not transient(e) or n + 1 == tries:
                    return None
                time.sleep(wait * 4**n)
                continue
            return out if len(out) == len(part) and all(len(v) == dim and all(map(math.isfinite, v)) for v in out) else None
        return None

    whole = attempt(texts)
    if whole is not None:
        return whole
    out = []
    for t in texts:
        one = attempt([t]) if len(texts) > 1 else None
        if one is None and strict:
            raise RuntimeError("embedding failed and no stand-in is allowed")
        out.append(one[0] if one else stand_in(t, dim))
    return out


def embed_missing(texts: DataFrame, cache: DataFrame, text: str, embed: Embedder, dim: int, batch: int = 16, strict: bool = False) -> DataFrame:
    """New cache entries (k, embedding): each distinct text that the cache does not have, asked once."""
    k = F.md5(F.col(text).cast("binary"))
    new = texts.select(k.alias("k"), F.col(text).alias("t")).dropDuplicates(["k"]).join(cache.select("k"), "k", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for a in range(0, len(p), batch):
                some = p.iloc[a : a + batch]
                yield pd.DataFrame({"k": some["k"], "embedding": ask(embed, some["t"].tolist(), dim, strict=strict)})

    return new.mapInPandas(run, "k string, embedding array<double>")


Scorer = Callable[[list[str], list[str]], list[float]]


def rerank(pairs: DataFrame, question: str, text: str, score: Scorer, group: str, batch: int = 32) -> DataFrame:
    """``pairs`` with ``model``, the score of question and text, and ``place`` by it within ``group``; nothing is cut off.

    The model is asked in batches inside the executors.  An answer with another number of scores than pairs is an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out: list[float] = []
            for a in range(0, len(p), batch):
                some = p.iloc[a : a + batch]
                got = score(some[question].tolist(), some[text].tolist())
                if len(got) != len(some):
                    raise ValueError(f"the model gave {len(got)} scores for {len(some)} pairs")
                out += got
            yield p.assign(model=np.array(out, float))

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", model double"
    scored = pairs.mapInPandas(run, schema)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("model"), text)))
