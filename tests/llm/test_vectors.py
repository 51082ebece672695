"""Top-k search and lattice near-duplicates against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webquarry.llm import lattice, registry, topk

NAN, INF = float("nan"), float("inf")


def plain_top(rows, k=10):
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[i] = min(good.get(i, v), v)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in good.items()}
    out = []
    for q, a in whole.items():
        if q % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(rows, spark, kind="array<float>", **options):
    docs = spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], f"vec_id long, embedding {kind}, q int, score double").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 100 == 0, **options).collect())


def test_top_k_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(420)]
    rows += [(500, rows[3][1]), (1000 + 1, rows[3][1]), (600, None), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [NAN] + [0.0] * 5), (701, [INF] + [0.0] * 5), (800, [0.0] * 6), (900, []), (None, rows[3][1])]
    rows += [(2000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(1100, [1.0, 2.0]), (1101, [0.5, 0.25]), (300, rows[300][1]), (5, rows[6][1]), (5, rows[5][1])]
    assert found(rows, spark) == plain_top(rows)
    assert found(rows, spark, k=3) == plain_top(rows, 3)


def test_top_k_in_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 16)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=4) / 4]) for i in range(500)]
    assert found(rows, spark) == plain_top(rows)


def test_top_k_of_large_numbers(spark):
    rows = [(i * 50, [1e9 * i, -3e7, 2.0**31 + i]) for i in range(12)]
    small = [(i * 50, [3e4 * i, 1e-3, -7e5]) for i in range(12)]
    assert found(small, spark, "array<double>") == plain_top(small)
    assert [r[:3] for r in found([(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [1.0, 1.0])], spark, "array<double>")] == [(0, 1, 1), (0, 2, 2)]
    assert len(found(rows, spark, "array<double>")) == 6 * 10


def test_top_k_of_nothing(spark):
    assert found([], spark) == []
    assert found([(0, [1.0])], spark) == []
    assert found([(0, [1.0]), (1, [2.0])], spark) == [(0, 1, 1, 2048 * 1024)]


def plain_links(rows, cosine=0.93):
    ids = [r[0] for r in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and l is not None for _, v, l in rows]
    n = len(rows)
    linked = [[] for _ in rows]
    for a in range(n):
        for b in range(a + 1, n):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.asarray(rows[k][1], float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    linked[a].append(b)
                    linked[b].append(a)
    out, seen = {}, {}
    for a in range(n):
        if a in seen:
            continue
        todo, group = [a], {a}
        while todo:
            for b in linked[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        least = min(ids[b] for b in group)
        for b in group:
            seen[b] = least
    return sorted((ids[a], len(linked[a]), seen[a], ids[a] == seen[a]) for a in range(n))


def vectors(rows, spark, kind="array<float>"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding {kind}, label int, n int, t string").repartition(3)


@pytest.mark.parametrize("cell", [8, lattice.CELL])
def test_links_and_components(spark, cell):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(25):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 12)):
            x = centre + rng.normal(size=32) * 0.12
            rows.append((i, [float(np.float32(z)) for z in x], int(rng.integers(0, 2))))
            i += 1
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(20)] + [(2000, [2 * x for x in rows[0][1]], rows[0][2])]
    rows += [(3000, rows[0][1], None), (3001, None, 1), (3002, [0.0] * 32, 1), (3003, [NAN] * 32, 1), (3004, [], 1), (3005, [None] * 32, 1), (3006, [INF] + [1.0] * 31, 1), (3007, rows[0][1][:8], 0)]
    got = sorted(tuple(r) for r in lattice.near_duplicates(vectors(rows, spark), cell=cell).collect())
    assert got == plain_links(rows)


def test_links_of_documents_vectors(spark):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in registry.QUERIES["op4_lattice"](spark, "/root/testdata/sf0.001").collect())
    assert got == plain_links(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * u
    label = np.zeros(len(x), np.int64)
    (hx, px), (hy, py) = lattice.cells(x, label), lattice.cells(y, label)
    met = (hx == hy) | (px == hy[:, :, None]).any(2) | (py == hx[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.95


def test_nearest_point_of_e8():
    rng = np.random.default_rng(5)
    around = lattice.roots()
    assert len(np.unique(around, axis=0)) == 240 and np.allclose((around**2).sum(1), 2)
    x = rng.normal(size=(500, 8)) * 3
    near = lattice.nearest(x)
    assert (np.abs(2 * near - np.rint(2 * near)) < 1e-9).all() and (near.sum(1) % 2 == 0).all()
    gap = ((x - near) ** 2).sum(1)
    assert gap.max() <= 1 + 1e-9
    assert (gap[:, None] <= (((x - near)[:, None] - around[None]) ** 2).sum(2) + 1e-9).all()


def test_vectors_of_different_lengths_in_one_cell():
    """A clash of cells loses no link."""
    vectors = [[1.0, 0.1], [1.0, 0.1, 0.0], [1.0, 0.2], [1.0, 0.2, 0.0]]
    n = len(vectors)
    columns = {"t": pa.array([0] * n, pa.int32()), "k": pa.array([5] * n), "_i": pa.array([0] * n), "_j": pa.array([0] * n), "_p": pa.array([0] * n), "home": pa.array([True] * n),
               "cid": pa.array(range(n)), "n": pa.array([1] * n), "v": pa.array(vectors), "homes": pa.array([[5]] * n), "probes": pa.array([[6]] * n)}
    (found,) = lattice._compared(0.93, 1, 1)(iter([pa.RecordBatch.from_pydict(columns)]))
    assert found.to_pydict() == {"cid": [0, 1, 2, 3], "near": [0, 1, 0, 1], "links": [1, 1, 1, 1]}


def test_no_vectors(spark):
    assert lattice.near_duplicates(vectors([], spark)).count() == 0
    assert [tuple(r) for r in lattice.near_duplicates(vectors([(1, None, None)], spark)).collect()] == [(1, 0, 1, True)]
    twice = lattice.near_duplicates(vectors([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], spark)).collect()
    assert [tuple(r) for r in twice] == [(1, 1, 1, True)] * 2
