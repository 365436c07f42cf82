"""Which documents hold which passages verbatim, white space aside.

The passages are a stated set of queries.  Of each, two hashes reach the driver: of its
first 2**k characters (at most 32), which a scan looks for at every place of a document by a
rolling hash, and of the whole, which decides a candidate at once.  A hit
carries the characters that it found, and these are compared with the passage after an equi-join,
so no hash decides a result.  Passages beyond ``BLOCK`` are scanned for block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, text

#: Passages looked for in one scan: about 64 MB of hashes.
BLOCK = 2_000_000


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        c, edges = codes.code_points(rb.column("p"))
        n = np.diff(edges)
        some = np.flatnonzero(n)
        roll, start, size = codes.Rolling(c), edges[:-1][some], n[some]
        lead = np.minimum(32, 1 << (np.frexp(size)[1] - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [rb.column("item").take(pa.array(some)), pa.array(lead), pa.array(roll.of(start, lead).view(np.int64)), pa.array(size.astype(np.int64)), pa.array(roll.of(start, size, 1).view(np.int64))],
            ["item", "lead", "head", "size", "whole"])


class _Wanted:
    """Passages by the length of their lead, sorted by its hash."""

    def __init__(self, item, lead, head, size, whole):
        self.by = {}
        for n in np.unique(lead).tolist():
            at = np.flatnonzero(lead == n)
            at = at[np.argsort(head[at], kind="stable")]
            may = np.zeros(1 << 20, bool)
            may[(head[at] >> codes.U(44)).astype(np.int64)] = True
            self.by[n] = (head[at], size[at], whole[at], item[at], may)


def _scan(held, space: np.ndarray):
    def run(batches):
        wanted = held.value
        for rb in batches:
            c, edges = codes.code_points(rb.column("t"))
            for a, b in codes.stretches(edges):
                part, own = codes.without(c[edges[a] : edges[b]], edges[a : b + 1] - edges[a], space)
                roll = codes.Rolling(part)
                docs, items, at, size = [], [], [], []
                for n, (head, sizes, whole, item, may) in wanted.by.items():
                    if len(part) < n:
                        continue
                    h = roll.of(np.arange(len(part) - n + 1), n)
                    place = np.flatnonzero(may[(h >> codes.U(44)).astype(np.int64)])
                    lo, hi = (np.searchsorted(head, h[place], side) for side in ("left", "right"))
                    count = hi - lo
                    place, k = np.repeat(place, count), np.repeat(lo, count)
                    k = k + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
                    doc = np.searchsorted(own, place, "right") - 1
                    fits = np.flatnonzero(place + sizes[k] <= own[doc + 1])
                    fits = fits[roll.of(place[fits], sizes[k[fits]], 1) == whole[k[fits]]]
                    docs.append(doc[fits])
                    items.append(item[k[fits]])
                    at.append(place[fits])
                    size.append(sizes[k[fits]])
                if docs and sum(map(len, docs)):
                    docs, items, at, size = map(np.concatenate, (docs, items, at, size))
                    _, first = np.unique(np.stack((docs, items)), axis=1, return_index=True)
                    found = [part[i : i + n].tobytes().decode("utf-32-le") for i, n in zip(at[first].tolist(), size[first].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rb.column("doc").take(pa.array(docs[first] + a)), pa.array(items[first]), pa.array(found, pa.string())], ["doc", "item", "found"])

    return run


def holders(docs: DataFrame, passages: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """(item, doc): each passage with the documents that hold it.  An empty passage is in every document; null texts hold nothing."""
    spark = docs.sparkSession
    p = passages.select(F.col(item_id).cast("long").alias("item"), text.strip_ws(F.col(item_text)).alias("p")).filter("p is not null")
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("t")).filter("t is not null")
    told = p.mapInArrow(_hashes, "item long, lead long, head long, size long, whole long")
    blocks = max(1, -(-passages.count() // BLOCK))
    space = codes.members(text.WS)
    found = None
    for i in range(blocks):
        part = told.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).toArrow()
        held = spark.sparkContext.broadcast(_Wanted(*(part.column(c).to_numpy().view(np.int64 if c in ("item", "lead", "size") else np.uint64) for c in ("item", "lead", "head", "size", "whole"))))
        hit = d.mapInArrow(_scan(held, space), "doc long, item long, found string")
        found = hit if found is None else found.unionByName(hit)
    same = found.join(p, "item").filter(F.col("found") == F.col("p")).select("item", "doc")
    empty = p.filter("p = ''").select("item")
    return same.unionByName(empty.crossJoin(d.select("doc"))) if empty.head(1) else same
