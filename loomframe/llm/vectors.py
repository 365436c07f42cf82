"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors are one class from the start, told by 128 bits of hash.  Classes are cut into blocks
by a tree of splits along the leading ``LEAD`` principal components.  A box in ``BOX`` components is drawn around all
vectors of each block, and a vector goes only to blocks whose box is near enough: the squared gaps of all components add up.  Within a pair of blocks, tiles of vectors sorted along these
components are compared: tiles whose boxes lie too far apart are skipped; else
products are summed over the leading components first, the rest is bounded by
the product of the suffix norms, and a pair is given up as soon as it cannot reach the
threshold.  What survives all steps is decided by the cosine of the given
components in double precision.  Any basis and any splits give the same links, so they may come from
a sample; the comparison reads every vector.

Pairs are never returned: a task returns for each class how many vectors it
links to and one link into a spanning forest of what it found.

Blocks hold about ``BLOCK`` vectors, so a task's memory is bounded; a hot vector
is one class.  How often a vector is copied is the number of boxes in its reach: few where the vectors
cluster, all of them at worst.

Defined cases: null, zero and non-finite vectors, and those with a null id, link with nothing; vectors
of different length are never linked, a very long one is like any other; a cosine of exactly the threshold links; rows that repeat an id are vectors of their own with its value;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import bucket_count, cut, few_parts, map_arrow

SAMPLE_ROWS = 20_000
BLOCK, LEAST_BLOCKS, TILE, LEAD, BOX = 16_384, 6, 512, 8, 32
STEPS = (16, 32)
SLACK = 1e-9


def principal(x: np.ndarray) -> np.ndarray:
    """Orthonormal directions of unit vectors, the widest first."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, v = np.linalg.eigh(u.T @ u - len(u) * np.outer(u.mean(0), u.mean(0)))
    return np.ascontiguousarray(v[:, ::-1])


class Tiles:
    """Vectors of one block in tiles along the leading components."""

    def __init__(self, x: np.ndarray, basis: np.ndarray):
        self.norm = np.linalg.norm(x, axis=1)
        y = (x / self.norm[:, None]) @ basis
        self.order = _kd(y, np.arange(len(y)), 0)
        self.x, self.y, self.norm = x[self.order], y[self.order], self.norm[self.order]
        self.tail = [np.sqrt(np.maximum((self.y[:, s:] ** 2).sum(1), 0)) for s in STEPS]
        self.edges = list(range(0, len(y), TILE)) + [len(y)]
        lead = min(LEAD, y.shape[1])
        self.low = np.array([self.y[a:b, :lead].min(0) for a, b in zip(self.edges, self.edges[1:], strict=False) if b > a])
        self.high = np.array([self.y[a:b, :lead].max(0) for a, b in zip(self.edges, self.edges[1:], strict=False) if b > a])


def _kd(y: np.ndarray, rows: np.ndarray, axis: int) -> np.ndarray:
    """Rows in an order whose runs of TILE lie close together."""
    if len(rows) <= TILE:
        return rows
    axis %= min(LEAD, y.shape[1])
    rows = rows[np.argsort(y[rows, axis], kind="stable")]
    mid = (len(rows) // TILE + 1) // 2 * TILE
    return np.concatenate((_kd(y, rows[:mid], axis + 1), _kd(y, rows[mid:], axis + 1)))


class Cells:
    """Splits of the space along the leading components into ``blocks`` cells of about equal share of a sample."""

    def __init__(self, y: np.ndarray, blocks: int):
        lead = min(LEAD, y.shape[1])
        self.splits: list[tuple[int, float, int, int]] = []  # component, bound, and where either side goes on (a cell: -1 - its number)
        low, high = [], []

        def grow(rows: np.ndarray, want: int, lo: np.ndarray, hi: np.ndarray) -> int:
            part = y[rows, :lead]
            spread = part.max(0) - part.min(0) if len(rows) > 1 else np.zeros(lead)
            axis = int(spread.argmax()) if lead else 0
            cut = float(np.quantile(part[:, axis], (want // 2) / want)) if want > 1 and len(rows) > 1 else 0.0
            left = rows[part[:, axis] < cut] if want > 1 and len(rows) > 1 else rows[:0]
            if not len(left) or len(left) == len(rows):
                low.append(lo)
                high.append(hi)
                return -len(low)
            here = len(self.splits)
            self.splits.append((axis, cut, 0, 0))
            below, above = hi.copy(), lo.copy()
            below[axis] = above[axis] = cut
            a = grow(left, want // 2, lo, below)
            b = grow(rows[part[:, axis] >= cut], want - want // 2, above, hi)
            self.splits[here] = (axis, cut, a, b)
            return here

        self.root = grow(np.arange(len(y)), blocks, np.full(lead, -np.inf), np.full(lead, np.inf))
        self.low, self.high = np.array(low), np.array(high)
        self.axes = lead

    def of(self, y: np.ndarray) -> np.ndarray:
        """Each vector's cell."""
        at = np.full(len(y), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]).tolist():
                axis, cut, a, b = self.splits[node]
                here = inner[at[inner] == node]
                at[here] = np.where(y[here, axis] < cut, a, b)
        return -1 - at

    def boxes(self, y: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(cell, component, least, most) of these vectors."""
        own, out = self.of(y), []
        for c in np.unique(own).tolist():
            part = y[own == c]
            out += [(c, k, float(lo), float(hi)) for k, (lo, hi) in enumerate(zip(part.min(0), part.max(0), strict=True))]
        return out


class Reach:
    """Which cells a vector may link into: those whose box, drawn around all their vectors, is near enough."""

    def __init__(self, cells: Cells, boxes: list[tuple[int, int, float, float]], wide: int, threshold: float):
        n = len(cells.low)
        self.cells, self.far = cells, 2 - 2 * threshold + SLACK
        self.low, self.high = np.full((n, wide), np.inf), np.full((n, wide), -np.inf)
        for c, k, lo, hi in boxes:
            self.low[c, k], self.high[c, k] = lo, hi
        self.near = []
        for c in range(n):
            if self.low[c, 0] > self.high[c, 0]:
                self.near.append([])
                continue
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(self.low - self.high[c], self.low[c] - self.high), 0)
            self.near.append(np.flatnonzero((gap**2).sum(1) <= self.far).tolist())

    def within(self, y: np.ndarray, cell: int) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[cell] - y, y - self.high[cell]), 0)
        return np.flatnonzero((gap**2).sum(1) <= self.far)

    def pairs(self) -> int:
        return sum(j >= i for i, js in enumerate(self.near) for j in js)


def linked(a: Tiles, b: Tiles, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the given order) of all pairs with cosine of at least ``threshold``; each once if ``same``."""
    out_a, out_b, far = [], [], 2 - 2 * threshold + SLACK
    for i in range(len(a.low)):
        gap = np.maximum(np.maximum(b.low - a.high[i], a.low[i] - b.high), 0)
        ra = slice(a.edges[i], a.edges[i + 1])
        for j in np.flatnonzero((gap**2).sum(1) <= far).tolist():
            if same and j < i:
                continue
            rb = slice(b.edges[j], b.edges[j + 1])
            dots = a.y[ra, : STEPS[0]] @ b.y[rb, : STEPS[0]].T
            p, q = np.nonzero(dots + a.tail[0][ra, None] * b.tail[0][None, rb] >= threshold - SLACK)
            if same and i == j:
                p, q = p[q > p], q[q > p]
            dot, p, q = dots[p, q], p + ra.start, q + rb.start
            for k, s in enumerate(STEPS):
                if not len(p):
                    break
                stop = STEPS[k + 1] if k + 1 < len(STEPS) else a.y.shape[1]
                dot = dot + np.einsum("ij,ij->i", a.y[p, s:stop], b.y[q, s:stop])
                rest = a.tail[k + 1][p] * b.tail[k + 1][q] if k + 1 < len(STEPS) else 0.0
                ok = dot + rest >= threshold - SLACK
                dot, p, q = dot[ok], p[ok], q[ok]
            if len(p):
                ok = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q]) >= threshold
                out_a.append(a.order[p[ok]])
                out_b.append(b.order[q[ok]])
    z = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (z, z)


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A root of each of n places under these links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        while not (new[new] == new).all():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def _compare(basis, threshold: float):
    def one(rows: pa.Table):
        ids, count, side = (rows.column(c).to_numpy() for c in ("rep", "n", "side"))
        x = rows.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        v = basis.value[0]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = bool(rows.column("same")[0].as_py())
        if not len(left) or not (same or len(right)):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["a", "b", "n"])
        a = Tiles(x[left], v)
        p, q = linked(a, a if same else Tiles(x[right], v), threshold, same)
        p, q = left[p], left[q] if same else right[q]
        n = np.bincount(p, count[q], len(ids)) + np.bincount(q, count[p], len(ids))
        hit = np.flatnonzero(n)
        root = ids[_forest(len(ids), p, q)]
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(root[hit]), pa.array(n[hit].astype(np.int64))], ["a", "b", "n"])

    def run(batches):
        held, now = [], None
        for rb in batches:
            key = rb.column("key").to_numpy(zero_copy_only=False)
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(edge, edge[1:], strict=False):
                if e == s:
                    continue
                if held and key[s] != now:
                    yield one(pa.Table.from_batches(held))
                    held = []
                now = key[s]
                held.append(rb.slice(s, e - s))
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def _unit(rb: pa.RecordBatch, v: np.ndarray) -> np.ndarray:
    """The vectors of a batch at length one, in these components."""
    x = rb.column("embedding").flatten().to_numpy().astype(np.float64).reshape(rb.num_rows, -1)
    return (x @ v) / np.linalg.norm(x, axis=1, keepdims=True)


def _boxes(held):
    def run(batches):
        for rb in batches:
            v, cells = held.value
            got = cells.boxes(_unit(rb, v[:, :BOX]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["cell", "k", "low", "high"])

    return run


def _deal(held):
    """Each class goes to the pairs of its own cell and those that it may link into."""

    def run(batches):
        for rb in batches:
            v, reach = held.value
            y, g = _unit(rb, v[:, :BOX]), len(reach.near)
            block = reach.cells.of(y)
            for own in np.unique(block).tolist():
                rows = np.flatnonzero(block == own)
                for other in reach.near[own]:
                    at = rows if other == own else rows[reach.within(y[rows], other)]
                    if len(at):
                        i, j, part = min(own, other), max(own, other), rb.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), i * g + j, np.int64)), pa.array(np.full(len(at), int(own == j and i != j), np.int32)), pa.array(np.full(len(at), i == j)), *(part.column(c) for c in ("rep", "n", "embedding"))],
                            ["key", "side", "same", "rep", "n", "embedding"],
                        )

    return run


def dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, v).alias("embedding"))
    rows = rows.withColumn("h", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("k", F.when(F.col("h").isNotNull(), F.xxhash64(F.lit("second"), "embedding")))
    classes = cut(rows.filter("h is not null").groupBy("h", "k").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    links = None
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    for d, n in sorted(sizes.items()):
        own = classes.filter(F.size("embedding") == d)
        share = int((1 << 30) * min(1.0, SAMPLE_ROWS / n))
        some = own.filter(F.pmod(F.xxhash64("rep", F.lit("pca")), F.lit(1 << 30)) < share).select("embedding").toArrow().column("embedding").combine_chunks()
        x = some.flatten().to_numpy().astype(np.float64).reshape(-1, d)
        basis = principal(x) if len(x) > 1 else np.eye(d)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, d))
        cells = Cells(unit @ basis[:, : min(LEAD, d)], max(LEAST_BLOCKS, -(-n // BLOCK)))
        held = spark.sparkContext.broadcast((basis, cells))
        kind = dict(classes.dtypes)["embedding"]
        boxes = map_arrow(own.select("embedding"), _boxes(held), "cell int, k int, low double, high double").groupBy("cell", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        reach = Reach(cells, [tuple(r) for r in boxes.collect()], min(BOX, d), threshold)
        near = spark.sparkContext.broadcast((basis, reach))
        dealt = map_arrow(own.select("rep", "n", "embedding"), _deal(near), f"key long, side int, same boolean, rep long, n long, embedding {kind}")
        met = map_arrow(dealt.repartition(max(bucket_count(spark), reach.pairs()), "key").sortWithinPartitions("key"), _compare(held, threshold), "a long, b long, n long")
        links = met if links is None else links.unionByName(met)
    if links is None:
        return vectors.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    few = few_parts(spark, vectors)
    links = cut(links, few, deal=True)
    counts = links.groupBy("a").agg(F.sum("n").alias("more"))
    comp = components(links, parts=few).withColumnRenamed("component", "c")
    per = classes.select("h", "k", "rep", "n").join(counts, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    per = per.select("h", "k", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
    out = rows.select("id", "h", "k").join(per, ["h", "k"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("id").eqNullSafe(comp_id).alias("kept"))
