"""Embedding near-dedup against brute force."""

import numpy as np

from loomframe.llm import vectors


def brute(rows, threshold=0.9):
    fine = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(fine)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= threshold]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = dict.fromkeys(root, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i in root}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 40))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=40) * rng.choice((0.05, 0.3, 0.6)))]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, [0.0] * 40), (502, [float("nan")] * 40), (503, [float("inf")] + [1.0] * 39), (504, [None] + [1.0] * 39), (505, [2 * x for x in rows[1][1]])]
    df = spark.createDataFrame([(i, v, 3, "c") for i, v in rows], "vec_id long, embedding array<float>, n int, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.dedup(df).collect()}
    assert got == brute(rows)


def test_cells_cut_the_space_and_find_their_neighbours():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.1
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ vectors.principal(x)
    cells = vectors.Cells(y[:1000], 32)
    own = cells.of(y)
    assert set(own.tolist()) <= set(range(len(cells.low))) and len(cells.low) >= 24
    assert ((y[:, : cells.axes] >= cells.low[own]) & (y[:, : cells.axes] <= cells.high[own])).all()
    reach = vectors.Reach(cells, cells.boxes(y), 24, 0.9)
    links = np.argwhere(np.triu(y @ y.T >= 0.9, 1))
    copies = np.zeros((len(y), len(cells.low)), bool)
    for c in range(len(cells.low)):
        for other in reach.near[c]:
            rows = np.flatnonzero(own == c)
            copies[rows[reach.within(y[rows], other)], other] = True
    assert all(copies[a, own[b]] and copies[b, own[a]] for a, b in links.tolist())
    assert copies.sum(1).mean() < len(cells.low) / 4


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=16) * rng.choice((0.05, 0.25)))]) for i in range(240)]
    rows += [(300 + i, rows[i][1]) for i in range(5)] + [(i, [0.5] * 3) for i in (400, 401)] + [(None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, h int, k int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.dedup(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == brute([r for r in rows if r[0] not in (None, 400, 401)]) | {400: (1, 400, True), 401: (1, 400, False)}


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert vectors.dedup(df.limit(0)).count() == 0
    assert [tuple(r) for r in vectors.dedup(df).collect()] == [(1, 0, 1, True)]
