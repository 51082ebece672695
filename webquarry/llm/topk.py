"""Exact top-k search by distributed histogram selection.

Method. Candidates are dealt to groups of bounded size by the hash of their id; every query visits every group, block by block, where all
scores are one matrix product. A pass counts each query's scores in `BINS` bins of its current range; bins are summed over the groups, the
bin that holds the k-th highest score becomes the next range, and after two or three passes that score is known exactly. A last pass keeps what
is above it and, of the scores that equal it, the smallest ids, and ranks them. Each group sends only the bins, and the ties, that can still
matter: no more than k of them a query.

Scale. A task holds one group of candidates and one batch of queries; queries are streamed. Group sizes go up to `GROUP` rows so that
queries are copied as seldom as possible. Nothing but the passes' common bound is collected.

Defined results: vectors that are null, empty or hold null or non-finite components, or whose scaled components aren't finite, take no part,
nor do rows without an id; of rows that repeat an id the least vector counts; only vectors of one length are compared; scores beyond 2**61
either way are clipped to it; fewer candidates than k give fewer rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm import common

K = 10
SCALE = 1024
BINS = 4096
#: Candidates of a group: no more than GROUP, no fewer than LEAST while there are tasks without one.
GROUP = 65_536
LEAST = 4096
#: Queries scored at once.
BLOCK = 256
_MOST = 1 << 61


def scaled(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double: whole numbers, exact as doubles at any size."""
    return np.floor(rows.astype(np.float64) * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    out = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(out, -_MOST, _MOST).astype(np.int64)


def _bound(scale: int):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [scaled(np.asarray(v), scale) for v in pdf["v"]]
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "top": [min(float(np.abs(r).max()), 2.0**62) for r in rows], "norm": [min(float(np.abs(r).sum()), 2.0**62) for r in rows]})

    return run


def _groups(batches, scale: int):
    """(candidates by length, query rows) for each block of queries; candidates of a group come before its queries."""
    group, held, parts = None, {}, []

    def gathered():
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {v.shape[1] for _, v in parts}:
            ids = np.concatenate([i for i, v in parts if v.shape[1] == length])
            rows = np.concatenate([v for _, v in parts if v.shape[1] == length])
            out[length] = (ids, rows)
        # a repeated id counts with its least vector
        every = np.concatenate([i for i, _ in out.values()])
        if len(np.unique(every)) < len(every):
            best: dict[int, tuple] = {}
            for ids, rows in out.values():
                for i, r in zip(ids.tolist(), rows.tolist()):
                    best[i] = min(best.get(i, (r,)), (r,))
            out = {n: (np.array([i for i, b in best.items() if len(b[0]) == n], np.int64), np.array([b[0] for b in best.values() if len(b[0]) == n])) for n in {len(b[0]) for b in best.values()}}
        made = {}
        for length, (ids, rows) in out.items():
            order = np.argsort(ids, kind="stable")
            made[length] = (ids[order], scaled(rows[order], scale))
        return made

    for batch in batches:
        g, kind, lengths = (np.asarray(batch.column(c)) for c in ("g", "kind", "n"))
        ids, values = np.asarray(batch.column("id")), batch.column("v")
        # a row of one group and kind after the other, of one length each
        edge = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (kind[1:] != kind[:-1]) | (lengths[1:] != lengths[:-1])])
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(g)]):
            if g[s] != group:
                group, held, parts = g[s], {}, []
            rows = np.asarray(values.slice(s, e - s).flatten()).reshape(e - s, lengths[s])
            if kind[s] == 0:
                parts.append((ids[s:e], rows))
                continue
            if parts:
                held, parts = gathered(), []
            if lengths[s] in held:
                for at in range(s, e, BLOCK):
                    stop = min(at + BLOCK, e)
                    yield held[lengths[s]], ids[at:stop], scaled(rows[at - s : stop - s], scale), batch.slice(at, stop - at)


def _scores(candidates, ids: np.ndarray, rows: np.ndarray):
    """Scores of a block of queries, and which of them count: not a query's own row."""
    known, vectors = candidates
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    counts = np.ones((len(ids), len(known)), bool)
    own = np.flatnonzero(known[at] == ids)
    counts[own, at[own]] = False
    return products(rows, vectors), counts


def _histogram(scale: int):
    def run(batches):
        import pyarrow as pa

        for candidates, ids, rows, batch in _groups(batches, scale):
            low, width, need = (np.asarray(batch.column(c))[:, None] for c in ("low", "width", "need"))
            scores, counts = _scores(candidates, ids, rows)
            counts &= (scores >= low) & (scores < low + width)
            bins = np.where(counts, scores - low, 0) // -(-width // BINS)
            q, c = np.nonzero(counts)
            table = np.bincount(q * BINS + bins[q, c], minlength=len(ids) * BINS).reshape(len(ids), BINS)
            above = table[:, ::-1].cumsum(1)[:, ::-1] - table
            q, b = np.nonzero((table > 0) & (above < need))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(b.astype(np.int64)), pa.array(table[q, b])], names=["q", "bin", "n"])

    return run


def _best(scale: int):
    def run(batches):
        import pyarrow as pa

        for candidates, ids, rows, batch in _groups(batches, scale):
            low, need = (np.asarray(batch.column(c)) for c in ("low", "need"))
            scores, counts = _scores(candidates, ids, rows)
            counts &= scores >= low[:, None]
            ties = counts & (scores == low[:, None])
            # candidates stand in the order of their ids
            counts &= ~ties | (ties.cumsum(1) <= need[:, None])
            q, c = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(candidates[0][c]), pa.array(scores[q, c])], names=["q", "vec", "score"])

    return run


def top_k(vectors: DataFrame, queries, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where the condition `queries` holds, the k best of all rows but its own."""
    whole = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    asked = queries & F.col(vec_id).isNotNull()
    rows = vectors.where(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v"), asked.alias("asked"))
    kind = rows.schema["v"].dataType.simpleString()
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n / min(GROUP, max(LEAST, n // (2 * cores)))))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), F.size("v").alias("n"), "id", "v", F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("width"), F.lit(0).cast("long").alias("need"))
    ask = rows.where("asked").groupBy("id").agg(F.min("v").alias("v"))
    top = rows.select("id", "v").mapInPandas(_bound(scale), f"id long, v {kind}, top double, norm double").agg(F.max("top")).first()[0] or 0.0
    normed = ask.mapInPandas(_bound(scale), f"id long, v {kind}, top double, norm double")
    # no score of a query is further from zero than the sum of its components times the largest component of all
    far = F.ceil(F.least(F.col("norm") * F.lit(top), F.lit(float(_MOST)))).cast("long")
    state = common.cut(normed.select("id", "v", (-far).alias("low"), (far * 2 + 1).alias("width"), F.lit(k).cast("long").alias("need")))

    def dealt(state: DataFrame) -> DataFrame:
        every = state.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        asks = every.select("g", F.lit(1).alias("kind"), F.size("v").alias("n"), "id", "v", "low", "width", "need")
        both = candidates.union(asks)
        return both.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind", "n")

    widest = state.agg(F.max("width")).first()[0] or 1
    while widest > 1:
        counts = dealt(state).mapInArrow(_histogram(scale), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc()))  # BINS rows a query at most
        found = counts.withColumn("upto", upto).join(state.select(F.col("id").alias("q"), "need"), "q")
        edge = found.where("upto >= need and upto - n < need").select("q", "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
        joined = state.join(edge, F.col("id") == F.col("q"), "left")
        step = F.expr(f"(width + {BINS - 1}) div {BINS}")
        # without an edge there are fewer than k candidates, all of them in the range, which stays
        low = F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.col("low") + F.col("bin") * step)
        width = F.when(F.col("bin").isNull(), F.col("width")).otherwise(step)
        state = common.cut(joined.select("id", "v", low.alias("low"), width.cast("long").alias("width"), F.coalesce("left", "need").alias("need")))
        widest = -(-widest // BINS)
    best = dealt(state).mapInArrow(_best(scale), "q long, vec long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec"))).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
