"""SimHash near-duplicates: fingerprints of word shingles, joined on pigeonhole blocks, checked by Hamming distance.

Method. A fingerprint of 64 bits is cut into five blocks; two fingerprints that differ in at most three bits agree on at least two whole
blocks, so each of the ten pairs of blocks (25 or 26 bits) is a join key, and no close pair is lost. Rows of one fingerprint are one
class from the start, whatever their number. A group of equal keys is compared in cells of bounded size (`common.blocked`); a cell
returns a spanning forest of its links, not its pairs. Classes are then put together by `common.components`.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is linked like any other; fewer words than
a shingle make one shingle; repeated rows and rows with a null id are rows like others, and null ids are never a component's id unless
it has no other; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: First bits and widths of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of a group that are compared at once with as many others.
CELL = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text, shingle hashes counted a megabyte of text at a time."""
    import xxhash

    ones, total, rest, short = np.zeros(64, np.int64), 0, [], True
    for words in common.word_chunks((text or "").encode().lower()):
        words = rest + words
        if len(words) >= shingle:
            short = False
            line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
            starts = [0, *ends]
            got = b"".join([xxhash.xxh64_digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])])
            bits = np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int32)
            total += len(bits)
            rest = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            rest = words
    if short and rest:
        return int(xxhash.xxh64_intdigest(b" ".join(rest), SEED))
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a long; with digest, the text's hash as well."""
    more = ["digest"] if digest else []

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.xxhash64(F.col(text)).alias(c) for c in more])
    rows = lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]
    return common.mapped(slim, lambda: rows, "fp long", ("doc_id", *more))


def _keys(fp):
    masks = [((1 << width) - 1) << first for first, width in BLOCKS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[
        F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(signed[a] | signed[b])).alias("k"))
        for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ])


def links(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all those of at most `distance` differing bits."""
    if not 0 <= distance <= 3:
        raise ValueError("five blocks find up to three differing bits")

    def forest(batches):
        import pyarrow as pa

        for table in common.runs(batches, ["t", "k", "_i", "_j"]):
            t, k, i, j, p = (table[c].to_numpy() for c in ("t", "k", "_i", "_j", "_p"))
            fp = table["fp"].to_numpy().view(np.uint64)
            new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            at = np.r_[np.flatnonzero(new), len(t)]
            # groups of one size are compared together
            left, right = [], []
            sizes = np.diff(at)
            for n in np.unique(sizes[sizes <= 16]):
                if n < 2:
                    continue
                rows = at[:-1][sizes == n][:, None] + np.arange(n)
                x = fp[rows]
                same = (i[rows[:, 0]] == j[rows[:, 0]])[:, None, None]
                near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= distance
                near &= same | (p[rows][:, :, None] != p[rows][:, None, :])
                g, q, r = np.nonzero(near & np.triu(np.ones((n, n), bool), 1))
                left.append(fp[rows[g, q]])
                right.append(fp[rows[g, r]])
            for s, e in ((s, e) for s, e in zip(at[:-1], at[1:]) if e - s > 16):
                x = fp[s:e]
                if i[s] == j[s]:
                    q, r = np.arange(len(x)), np.arange(len(x))
                else:
                    q, r = np.flatnonzero(p[s:e] == i[s]), np.flatnonzero(p[s:e] == j[s])
                found = [], []
                for c in range(0, len(q), 512):
                    u, v = np.nonzero(np.bitwise_count(x[q[c : c + 512], None] ^ x[None, r]) <= distance)
                    found[0].append(q[c + u])
                    found[1].append(r[v])
                root = common.local_roots(len(x), np.concatenate(found[0] or [[]]).astype(int), np.concatenate(found[1] or [[]]).astype(int))
                away = np.flatnonzero(root != np.arange(len(x)))
                left.append(x[away])
                right.append(x[root[away]])
            if left:
                a, b = (np.concatenate(z).astype(np.uint64).view(np.int64) for z in (left, right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("_k")).select("fp", "_k.t", "_k.k")
    cells = common.blocked(keyed, ["t", "k"], "fp", cell).select("t", "k", "_i", "_j", "_p", "fp")
    order = ["t", "k", "_i", "_j"]
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(forest, "a long, b long")


def _parts(classes: DataFrame, distance: int) -> DataFrame:
    """classes, a row for each fingerprint fp, with part: the same for all fingerprints of a component."""
    parts = common.components(links(classes.select("fp"), distance))
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs."""
    prints = common.cut(fingerprints(docs, doc_id, text, shingle))
    whole = _parts(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), distance)
    firsts = whole.groupBy("part").agg(F.min("first").alias("component_id"))
    names = whole.select("fp", "part").join(firsts, "part").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, all columns as they were: that of the smallest id, an id before none, then of the smallest text hash.

    A component's first is a minimum over its fingerprints' minima, so ids may be null or repeated. The small table of firsts is joined first, so
    that only the rows that stay, and rows equal to them in id and text, are made one; of those the one with the smallest hash of its other columns stays."""
    prints = common.cut(fingerprints(docs, doc_id, text, digest=True))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"))
    whole = _parts(prints.groupBy("fp").agg(F.min(row).alias("first")), DISTANCE)
    firsts = whole.groupBy("part").agg(F.min("first").alias("first"))
    keys = {"__none": F.col(doc_id).isNull(), "__name": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "__text": F.xxhash64(F.col(text))}
    firsts = firsts.select(F.col("first.none").alias("__none"), F.col("first.name").alias("__name"), F.col("first.digest").alias("__text"))
    near = docs.withColumns(keys).join(firsts, list(keys), "left_semi")
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    one = near.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*[F.col(c) for c in docs.columns])).alias("__row"))
    return one.select(*[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
