"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark, merged into maximal removal intervals.

Method. Words hash to 64 bits and each window of `window` words gets a polynomial hash from prefix sums (arithmetic modulo 2**64). To
ship few bytes a window, consecutive windows travel together: the key of a window is the least hash of the short shingles inside it, a
function of its words alone, so equal windows have equal keys, and a run of windows with one key is one row that carries their hashes as
bytes. Windows are equal when key and hash are. Rows are dealt by key; inside a task each hash keeps its smallest document, and windows
of larger ones become intervals, which are merged per document and joined to the texts once.

Skew. A first pass counts all keys. Keys above `max(HOT_ROWS, HOT_SHARE of all rows)`, of which there can be 1 / HOT_SHARE at most, are
a list of bounded size (8 bytes a key); their windows go another way: one row a window, the smallest document per window by a grouped
minimum that is combined before the shuffle, and a join back, whose hot partitions adaptive execution splits.

Defined results: a null or empty text has no words; a text of fewer words than a window loses nothing; a document with a null id is
neither a source nor cut; rows that repeat an id are one document and don't cut each other; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

WINDOW = 50
#: Words of the shingles whose least hash is a window's key.
SHINGLE = 8
#: Bytes of a window's hash beside its key of 64 bits.
HASH_BYTES = 6
HOT_ROWS = 4000
HOT_SHARE = 1e-6
#: Odd base of the polynomial, and the multipliers that mix its bits (fixed values of the hash).
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in common.word_chunks((text or "").encode())]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class _Powers:
    """Powers of the base and of its inverse, made once a task and longer when a text needs it."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


def window_hashes(words: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Hash of every `width` consecutive words (Rabin and Karp: the sum of word hashes times powers of a base)."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)], dtype=np.uint64)]
    return _mix((sums[width:] - sums[:-width]) * down[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out, step = np.minimum(out[:-step], out[step:]), step * 2
    return np.minimum(out[: len(x) - width + 1], out[width - step :][: len(x) - width + 1]) if step < width else out


def _windows(text: str | None, window: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Key and hash of each window of a text."""
    words = word_hashes(text)
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    short = min(SHINGLE, window)
    return _sliding_min(window_hashes(words, short, powers), window - short + 1), window_hashes(words, window, powers)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _merged(doc: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray):
    """Intervals [first, stop) of one document that touch or overlap, as one."""
    order = np.lexsort((first, row, doc))
    doc, row, first, stop = (x[order] for x in (doc, row, first, stop))
    # ends so far within a document: starts grow, and so do ends, as all windows are of one width or runs of such
    new = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (first[1:] > stop[:-1])]
    at = np.flatnonzero(new)
    return doc[at], row[at], first[at], np.maximum.reduceat(stop, at)


def _sources(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))


def _hot_keys(sources: DataFrame, window: int, hot_rows: int) -> np.ndarray:
    def count(batches):
        import pyarrow as pa

        powers = _Powers()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = [_windows(t, window, powers)[0] for t in batch.column(0).slice(k, 256).to_pylist()]
                keys, n = np.unique(np.concatenate([x[_starts(x)] for x in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], names=["k", "n"])

    counts = sources.select("text").mapInArrow(count, "k long, n int").groupBy("k").agg(F.sum("n").alias("n")).where(f"n > {hot_rows}")
    counts = common.cut(counts)
    # more than hot_rows rows each, and more than HOT_SHARE of them all: no more than 1 / HOT_SHARE keys
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.sort(np.array([r[0] for r in counts.where(F.col("n") > HOT_SHARE * total).select("k").collect()], np.int64).view(np.uint64))


def _cold(sources: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """doc, row, first, stop: words of runs of repeated windows whose key is not hot."""

    def ship(batches):
        import pyarrow as pa
        import xxhash

        powers = _Powers()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    keys, hashes = _windows(text, window, powers)
                    if not len(keys):
                        continue
                    at = _starts(keys)
                    size = np.diff(np.r_[at, len(keys)])
                    cold = ~_among(keys[at], hot)
                    out[0].append(keys[at][cold])
                    out[1].append(np.full(int(cold.sum()), doc, np.int64))
                    out[2].append(at[cold].astype(np.int32))
                    out[3].append(size[cold].astype(np.int32))
                    low = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                    out[4].append(low[np.repeat(cold, size)].tobytes())
                    out.append(np.full(int(cold.sum()), np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)), np.uint64))
                if not out[0]:
                    continue
                keys, docs, at, size = (np.concatenate(x) for x in out[:4])
                rows = np.concatenate(out[5:])
                ends = np.r_[0, np.cumsum(size, dtype=np.int64) * HASH_BYTES].astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(out[4]))])
                arrays = [pa.array(keys.view(np.int64)), pa.array(docs), pa.array(rows.view(np.int64)), pa.array(at), blobs]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "doc", "row", "first", "hashes"])

    def judge(batches):
        import pyarrow as pa

        for table in common.runs(batches, ["k"]):
            k = table["k"].to_numpy()
            doc, row, first = (table[c].to_numpy() for c in ("doc", "row", "first"))
            # only keys of several documents can hold repeated windows
            new = np.r_[True, k[1:] != k[:-1]]
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            several = (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at))[group]
            picked = np.flatnonzero(several)
            if not len(picked):
                continue
            blobs = pa.concat_arrays(table["hashes"].take(pa.array(picked)).chunks)
            ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
            low = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, HASH_BYTES)
            h = np.zeros((len(low), 8), np.uint8)
            h[:, :HASH_BYTES] = low
            h = h.view(np.uint64).ravel()
            size = np.diff(ends) // HASH_BYTES
            of = np.repeat(picked, size)
            start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((doc[of], h, group[of]))
            of, start, h = of[order], start[order], h[order]
            g = group[of]
            begin = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
            smallest = doc[of][begin][np.cumsum(begin) - 1]
            gone = doc[of] > smallest
            if not gone.any():
                continue
            of, start = of[gone], start[gone].astype(np.int64)
            got = _merged(doc[of], row[of], start, start + window)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2].astype(np.int32)), pa.array(got[3].astype(np.int32))], names=["doc", "row", "first", "stop"])

    shipped = sources.mapInArrow(ship, "k long, doc long, row long, first int, hashes binary")
    return shipped.repartition("k").sortWithinPartitions("k").mapInArrow(judge, "doc long, row long, first int, stop int")


def _hot(sources: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """The same for hot keys: one row a window, and a grouped minimum."""

    def ship(batches):
        import pyarrow as pa
        import xxhash

        powers = _Powers()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, hashes = _windows(text, window, powers)
                at = np.flatnonzero(_among(keys, hot))
                if len(at):
                    own = np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)
                    arrays = [pa.array(x) for x in (keys[at].view(np.int64), hashes[at].view(np.int64), np.full(len(at), doc, np.int64), np.full(len(at), own), at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["k", "h", "doc", "row", "first"])

    windows = common.cut(sources.mapInArrow(ship, "k long, h long, doc long, row long, first int"))
    least = windows.groupBy("k", "h").agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).where("_least < _most").drop("_most")
    again = windows.join(least, ["k", "h"]).where("doc > _least")
    return again.select("doc", "row", "first", (F.col("first") + window).cast("int").alias("stop"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc, row, spans: word intervals [first, stop) covered by windows that also start in a document of a smaller id.

    row is xxhash64 of the text, which tells rows of one id and different texts apart. Documents that lose nothing have no row."""
    sources = _sources(docs, doc_id, text)
    hot = _hot_keys(sources, window, hot_rows)
    found = _cold(sources, window, hot)
    if len(hot):
        found = found.union(_hot(sources, window, hot))
    return found.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("first", "stop"))).alias("spans"))


def covered(spans, n: int) -> np.ndarray:
    """Which of n words lie in the intervals."""
    edge = np.zeros(n + 1, np.int64)
    for first, stop in spans:
        edge[first] += 1
        edge[stop] -= 1
    return np.cumsum(edge[:n]) > 0


def _with_spans(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    spans = common.cut(repeated_spans(docs, doc_id, text, window)).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    return docs.join(spans, (F.col(doc_id).cast("long") == F.col("__doc")) & (F.xxhash64(F.col(text)) == F.col("__row")), "left").drop("__doc", "__row")


def _pairs(spans) -> list[tuple[int, int]]:
    return [] if spans is None else [(s["first"], s["stop"]) for s in spans]


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each row."""

    def rows(texts, spans_of):
        out = []
        for t, spans in zip(texts, spans_of):
            spans, sha, begin, gone, between = _pairs(spans), hashlib.sha256(), 0, 0, b""
            for words in common.word_chunks((t or "").encode()):
                kept = words
                if spans:
                    near = [(max(a - begin, 0), min(b - begin, len(words))) for a, b in spans if a < begin + len(words) and b > begin]
                    drop = covered(near, len(words))
                    gone += int(drop.sum())
                    kept = [w for w, d in zip(words, drop) if not d] if near else words
                begin += len(words)
                if kept:
                    sha.update(between + b" ".join(kept))
                    between = b" "
            out.append((begin, gone, sha.hexdigest()))
        return zip(*out)

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _with_spans(slim, "doc_id", "text", window).select("doc_id", "text", "__spans")
    return common.mapped(found, lambda: rows, "n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the intervals and the white space after each; all else as it was."""
    starts = [m.start() for m in re.finditer(common.WORD, text)]
    gone = covered(spans, len(starts))
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
    keep, at = [], 0
    for first, stop in edge:
        keep.append(text[at : starts[first]])
        at = starts[stop] if stop < len(starts) else len(text)
    return "".join(keep) + text[at:]


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages taken out of the texts, all other columns and all rows as they were."""

    @F.pandas_udf("string")
    def without(t, s):
        import pandas as pd

        return pd.Series([None if a is None else cut_text(a, _pairs(b)) for a, b in zip(t, s)], dtype=object)

    found = _with_spans(docs, doc_id, text, window)
    repeats = F.col("__spans").isNotNull()
    shorter = without(F.when(repeats, F.col(text)), F.col("__spans"))
    return found.withColumn(text, F.when(repeats, shorter).otherwise(F.col(text))).select(docs.columns)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
