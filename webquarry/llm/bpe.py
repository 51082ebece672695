"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest, and decoding.

Method. A text is cut by the vocabulary's pattern; each match is encoded by itself. First tier: hash-and-displace over the vocabulary (one
64-bit hash, a displacement a bucket, as many slots as tokens); the slot's bytes are compared, so a strange pre-token never passes.
Second tier: bytes as a doubly linked list, pairs of neighbours in a heap by rank and place; the best pair is joined, and pairs that are
no longer there are passed over when they come up, n log n for n bytes. A worker keeps what it has met in a table of bounded size.

The driver reads the rank file (its size is the vocabulary's) and broadcasts the hash; tasks read texts only.

Defined results: a null text is an empty one and has no ids; very long texts are matched and hashed piece by piece; repeated rows and
null ids are rows like others; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

#: Pre-tokens that a worker keeps with their ids.
MEMO = 400_000
#: Matches that are encoded at once.
PIECES = 1 << 16
#: Odd numbers that spread a displacement and mix it with a hash, and 64 bits (fixed values of the hash).
_STEP, _MIXER, _ALL = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, (1 << 64) - 1


class PerfectHash:
    """Place of each key among as many slots as keys: the key's hash and the displacement of its bucket, mixed, mod n."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        import xxhash

        n = self.n = len(keys)
        self.buckets = max(1, -(-n // per_bucket))
        for self.seed in range(100):
            h = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], np.uint64)
            if len(np.unique(h)) == n and self._displace(h):
                break
        else:
            raise ValueError("no displacement found; keys must differ")
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for value, key in enumerate(keys):
            slot = self._slot(xxhash.xxh64_intdigest(key, self.seed))
            self.keys[slot], self.values[slot] = key, value

    def _displace(self, h: np.ndarray) -> bool:
        n, step, mixer = self.n, np.uint64(_STEP), np.uint64(_MIXER)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order, sizes = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=self.buckets)
        ends, taken = np.cumsum(sizes), np.zeros(n, bool)
        moves = np.arange(1 << 20, dtype=np.uint64) * step
        self.moves = [0] * self.buckets
        for b in np.argsort(-sizes, kind="stable"):
            own = h[order[ends[b] - sizes[b] : ends[b]]][:, None]
            if len(own) < 2:
                break
            start, width = 0, 16
            while start < len(moves):
                slots = ((((own ^ moves[start : start + width]) * mixer) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(0)
                if good.any():
                    for d in np.flatnonzero(good):
                        if len(set(slots[:, d].tolist())) == len(own):
                            break
                    else:
                        good[:] = False
                if good.any():
                    taken[slots[:, d]] = True
                    self.moves[b] = start + int(d)
                    break
                start, width = start + width, min(width * 4, 4096)
            else:
                return False
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):  # a bucket of one key names its slot
            self.moves[b] = -1 - next(free)
        return True

    def _slot(self, h: int) -> int:
        move = self.moves[h % self.buckets]
        if move < 0:
            return -1 - move
        return (((h ^ move * _STEP & _ALL) * _MIXER & _ALL) >> 32) % self.n

    def find(self, key: bytes) -> int:
        """The key's number, -1 if it isn't one."""
        import xxhash

        slot = self._slot(xxhash.xxh64_intdigest(key, self.seed))
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    """Tokens by rank. Ranks need not be without gaps: ids are kept beside the hash's numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in tokens]
        self.hash = PerfectHash(tokens)
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a})

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        at = self.hash.find(piece)
        return (self.ids[at],) if at >= 0 else tuple(merged(piece, self.ranks))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by merging: lowest rank first, then the place furthest to the left."""
    n, get = len(piece), ranks.get
    # a node is its first byte: where it ends (-1: joined to the one before) and where the one before begins
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # the rank is that of the bytes from i to stop, so any two neighbours that make these may be joined
        if middle < 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (rank := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        j = before[i]
        if j >= 0 and (rank := get(piece[j:stop])) is not None:
            heapq.heappush(heap, (rank, j, stop))
    return [ranks[piece[i:e]] for i, e in enumerate(end) if e >= 0]


class _Memo(dict):
    """Ids of the pre-tokens met so far, by their text; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.encode = vocabulary.encode_piece

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        ids = self.encode(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def pieces(text: str, pattern):
    """Lists of matches, in order."""
    if len(text) < 1 << 20:
        yield pattern.findall(text)
        return
    found = (m[0] for m in pattern.finditer(text))
    while part := list(islice(found, PIECES)):
        yield part


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the whole texts' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        import regex

        memo, find = _Memo(shared.value), regex.compile(pattern)
        return lambda texts: [[[i for part in pieces(t or "", find) for i in chain.from_iterable(map(memo.__getitem__, part))] for t in texts]]

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(slim, make, "ids array<int>")


def decode(ids, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))


def digest(docs: DataFrame, vocabulary: Vocabulary, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the bytes decoded from the ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        import regex

        vocabulary, find = shared.value, regex.compile(pattern)
        memo, bytes_of, written = _Memo(vocabulary), vocabulary.bytes_of, {i: str(i) for i in vocabulary.bytes_of}

        def rows(texts):
            out = []
            for text in texts:
                n, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for part in pieces(text or "", find):
                    ids = list(chain.from_iterable(map(memo.__getitem__, part)))
                    if ids:
                        coded.update(("," if n else "").encode() + ",".join(map(written.__getitem__, ids)).encode())
                        decoded.update(b"".join(map(bytes_of.__getitem__, ids)))
                        n += len(ids)
                out.append((n, coded.hexdigest(), decoded.hexdigest()))
            return zip(*out)

        return rows

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(slim, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(docs: DataFrame) -> DataFrame:
    """The digest of docs by the public vocabulary for many languages."""
    import public_tokenizers

    return digest(docs, Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
