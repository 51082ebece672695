"""Near-duplicate embeddings by lattice hashing: E8 points of random projections, neighbouring cells probed, cosines checked.

Method. In each of `TABLES` tables a unit vector is projected to eight dimensions by a seeded Gaussian matrix and decoded to the nearest point of
the E8 lattice: its home cell. It also probes the `PROBES` next cells among the 240 that surround the home. A pair is compared wherever the
home of one is the home or a probe of the other, and is a link if the labels are equal and the cosine in double precision is high enough.
At cosine 0.93, the worst case, about 0.97 of pairs are found; of those at 0.97 and more practically all.

Equal vectors of a label are one class from the start. A pair that meets in several cells counts in the first of them only, which both rows
tell from the cells they carry, so links are counted without listing pairs; a cell returns a row a vector. Hot cells are split into pairs of
parts of bounded size (`common.blocked`).

Defined results: null, empty and zero vectors, those with null or non-finite components, and rows with a null label link with nothing; vectors
of different lengths don't link; repeated rows are vectors that link; null ids never name a component that has another; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

COSINE = 0.93
TABLES = 4
PROBES = 3
#: Distance between lattice points, in units of the projection of a unit vector's component.
WIDTH = 1.4
SEED = 8
#: Rows of a cell that are compared at once with as many others.
CELL = 2048


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: where the sum is odd, the component furthest from its rounding goes the other way."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(gap[odd]).argmax(1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the whole points with an even sum and those moved by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hashed(label: np.ndarray, table: int, points: np.ndarray) -> np.ndarray:
    """64 bits of label, table and point."""
    out = label.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (table + 1) & (1 << 64) - 1)
    for k in range(8):
        out = (out ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


def cells(vectors: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (rows, tables) and probed cells (rows, tables, probes) of unit vectors."""
    around, homes, more = roots(), [], []
    for t in range(tables):
        matrix = np.random.default_rng([SEED, t, vectors.shape[1]]).normal(size=(vectors.shape[1], 8)) / width
        x = vectors @ matrix
        home = nearest(x)
        # the closest neighbours lie furthest along the rest; all are equally long
        next_to = np.argsort(-((x - home) @ around.T), axis=1, kind="stable")[:, :probes]
        homes.append(_hashed(label, t, home))
        more.append(_hashed(label[:, None], t, home[:, None, :] + around[next_to]))
    return np.stack(homes, 1), np.stack(more, 1)


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _addressed(tables: int, probes: int, width: float):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            lengths = pdf["v"].map(len)
            for n in sorted(lengths.unique()):
                own = pdf[lengths == n].reset_index(drop=True)
                home, more = cells(_unit(own["v"]), own["label"].to_numpy(np.int64) * 31 + n, tables, probes, width)
                yield pd.DataFrame({"cid": own["cid"], "n": own["n"], "v": own["v"], "homes": list(home), "probes": list(more.reshape(len(own), -1))})

    return run


def _compared(cosine: float, tables: int, probes: int):
    def run(batches):
        import pyarrow as pa

        for table in common.runs(batches, ["t", "k", "_i", "_j"]):
            t, k, i, j, p = (table[c].to_numpy() for c in ("t", "k", "_i", "_j", "_p"))
            cid, n, home = (table[c].to_numpy() for c in ("cid", "n", "home"))
            homes = table["homes"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
            more = table["probes"].combine_chunks().flatten().to_numpy().reshape(-1, tables, probes)
            vectors = table["v"].combine_chunks()
            at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            out = [], [], []
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(t)]):
                if e - s < 2 or not home[s:e].any():
                    continue
                part = vectors.slice(s, e - s)
                lengths = np.diff(part.offsets.to_numpy())
                sides = []
                # one length, but for a clash of hashes
                for size in np.unique(lengths):
                    of = lengths == size
                    x = np.zeros((e - s, size))
                    x[of] = _unit(part.take(pa.array(np.flatnonzero(of))).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                    sides.append((x, np.flatnonzero(of & home[s:e] & (p[s:e] == i[s])), np.flatnonzero(of & (p[s:e] == j[s]))))
                    if i[s] != j[s]:
                        sides.append((x, np.flatnonzero(of & home[s:e] & (p[s:e] == j[s])), np.flatnonzero(of & (p[s:e] == i[s]))))
                us, vs = [], []
                for x, left, right in sides:
                    for c in range(0, len(left), 512):
                        u, v = np.nonzero(x[left[c : c + 512]] @ x[right].T >= cosine)
                        u, v = left[c + u], right[v]
                        # each pair once, in the first table and way in which it meets
                        low = cid[s + u] < cid[s + v]
                        both = home[s + v]
                        u, v, low, both = (z[(cid[s + u] != cid[s + v]) & (low | ~both)] for z in (u, v, low, both))
                        a, b = np.where(low, u, v) + s, np.where(low, v, u) + s
                        way = np.where(both, 0, np.where(low, 1, 2)) + 3 * t[s]
                        first = np.full(len(u), 3 * tables)
                        for q in range(tables - 1, -1, -1):
                            first[(homes[b, q, None] == more[a, q]).any(1)] = 3 * q + 2
                            first[(homes[a, q, None] == more[b, q]).any(1)] = 3 * q + 1
                            first[homes[a, q] == homes[b, q]] = 3 * q
                        us.append(u[first == way])
                        vs.append(v[first == way])
                u, v = np.concatenate(us or [[]]).astype(int), np.concatenate(vs or [[]]).astype(int)
                if not len(u):
                    continue
                size = e - s
                weight = n[s:e]
                links = np.bincount(u, weight[v], size) + np.bincount(v, weight[u], size)
                root = common.local_roots(size, u, v)
                linked = np.flatnonzero(links)
                out[0].append(cid[s:e][linked])
                out[1].append(cid[s:e][root[linked]])
                out[2].append(links[linked].astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in out], names=["cid", "near", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("v"), F.col(label).alias("label")).withColumn("good", F.coalesce(good, F.lit(False)))
    slim = slim.withColumn("cid", F.when(F.col("good"), F.xxhash64("label", "v")))
    kind = slim.schema["v"].dataType.simpleString()
    classes = slim.where("good").groupBy("cid").agg(F.first("v").alias("v"), F.xxhash64(F.first("label")).alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    names = common.cut(classes.select("cid", "n", "least", "v", "label"))
    addressed = names.select("cid", "n", "v", "label").mapInPandas(_addressed(tables, probes, width), f"cid long, n long, v {kind}, homes array<long>, probes array<long>")
    addressed = common.cut(addressed)
    places = F.flatten(F.array(
        F.transform("homes", lambda k, t: F.struct(t.alias("t"), k.alias("k"), F.lit(True).alias("home"))),
        F.transform("probes", lambda k, t: F.struct(F.floor(t / probes).cast("int").alias("t"), k.alias("k"), F.lit(False).alias("home"))),
    ))
    keyed = addressed.withColumn("_c", F.explode(places)).select("_c.t", "_c.k", "_c.home", "cid")
    # cells are dealt by ids; vectors go only to those in which they are compared
    dealt = common.blocked(keyed, ["t", "k"], "cid", cell, some="home").join(addressed.select("cid", "n", "v", "homes", "probes"), "cid")
    order = ["t", "k", "_i", "_j"]
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compared(cosine, tables, probes), "cid long, near long, links long")
    found = common.cut(found)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = common.components(found, "cid", "near").withColumnRenamed("node", "cid")
    whole = names.select("cid", "n", "least").join(links, "cid", "left").join(parts, "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    firsts = whole.groupBy("part").agg(F.min("least").alias("first"))
    whole = whole.join(firsts, "part").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first")
    rows = slim.select("vec_id", "cid").join(whole, "cid", "left")
    component = F.coalesce("first", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
