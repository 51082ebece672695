"""Alignment of two tokenizers over a corpus: inverted pair bitmaps with planes for multiplicity, and scores back to the documents.

Method. A text's tokens by both tokenizers end at byte offsets; offsets where both end cut them into groups, and the two tokens that end there
are a link. Documents are numbered densely in blocks of up to 65,536. For each pair of ids that is linked in a block, the documents are a
compressed bitmap: sorted 16-bit numbers while they are fewer than 4,096, else 65,536 bits. Plane 0 holds the documents of the pair, plane k
those in which bit k - 1 of the number of links less one is set. Bitmaps of one pair, plane and block are OR-merged where they are made;
blocks stand side by side. Popcounts of plane 0 sum up to documents, those of all planes, times their weight, to links. Then postings go
back: a pair's score is added to the documents that its planes name, and the documents of a block are put together again.

Scale. Texts are tokenized where they are read, one pass, chunk by chunk at single spaces, where neither tokenizer joins anything; a worker
keeps chunks with their groups and links in two generations of `MEMO`. A block is closed at 65,536 documents, `LINKS` links or `PAIRS` pairs, so a task's memory and
the rows that meet at a block are bounded, and a pair, however common, has a row a block and plane. Counts are combined before their
shuffle. The index is a table in the shared folder.

Defined results: a text that is null or empty, or that either tokenizer doesn't give back byte by byte, has zeros and an empty hash; strings of special
tokens are plain text; repeated rows and null ids are documents like others; very long texts are read a megabyte at a time; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common
from webquarry.llm.triebpe import byte_characters

#: Chunks in each of two generations that a worker keeps.
MEMO = 300_000
#: Documents, links and pairs at which a block is closed, and links that are sorted at once.
DOCS, LINKS, PAIRS, FLUSH = 1 << 16, 1 << 24, 500_000, 1 << 21
#: Documents from which a bitmap is one of bits, and its bytes.
DENSE, BYTES = 4096, 8192
#: Rows that are split into chunks at once, and new chunks that are encoded as one line.
ROWS, LINE = 128, 400
#: A pair of ids as one number: the first tokenizer's, then 16 bits of the second's.
_SHIFT = 16

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the chunks met so far."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        byte_of = {c: b for b, c in byte_characters().items()}
        vocabulary = json.loads(first)["model"]["vocab"]
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a[i] = bytes(map(byte_of.__getitem__, token))
        n = self.second.get_piece_size()
        if n > 1 << _SHIFT:
            raise ValueError("ids of the second tokenizer need more than 16 bits")
        pieces = [self.second.id_to_piece(i) for i in range(n)]
        self.b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.a, self.b))
        ids = [str(i) for i in range(max(len(self.a), n))]
        # an id and what follows it: another of its side, the other side, another group
        self.written = [[i + s for i in ids] for s in ",|;"]
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def encode(self, lines: list[str]):
        """Ids of both tokenizers for each line, as arrays; None where the bytes differ from the line's."""
        found = self.first.encode_batch_fast([" " + x for x in lines], add_special_tokens=False)
        for line, a, b in zip(lines, found, self.second.encode(lines, num_threads=1)):
            a, want = a.ids, b" " + line.encode()
            if b"".join(map(self.a.__getitem__, a)) == want == b"".join(map(self.b.__getitem__, b)):
                yield np.array(a, np.int64), np.array(b, np.int64)
            else:
                yield None

    def aligned(self, a: np.ndarray, b: np.ndarray, stops: np.ndarray):
        """Parts of a line up to the byte offsets `stops`, where groups end: text of the groups, pairs as bytes, tokens of both sides."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        pairs = (a[last_a] << _SHIFT | b[last_b]).tobytes()
        # what follows each token, and the order of groups, in each the first side before the second
        after_a, after_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        after_a[last_a], after_b[last_b] = 1, 2
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids, after, written = np.concatenate([a, b])[order].tolist(), np.concatenate([after_a, after_b])[order].tolist(), self.written
        words = [written[s][i] for s, i in zip(after, ids)]
        groups = (np.searchsorted(shared, stops) + 1).tolist()
        tokens_a, tokens_b = ((np.searchsorted(x, stops) + 1).tolist() for x in (ends_a, ends_b))
        g, at, bt = 0, 0, 0
        for to, ta, tb in zip(groups, tokens_a, tokens_b):
            yield "".join(words[at + bt : ta + tb])[:-1].encode(), pairs[8 * g : 8 * to], ta - at, tb - bt
            g, at, bt = to, ta, tb

    def learn(self, chunks: set[str]) -> dict[str, tuple | None]:
        """What `aligned` gives for each chunk, None for those that a tokenizer doesn't give back."""
        young, old = self.young, self.old
        if len(young) + len(chunks) > MEMO:
            self.old, self.young = old, young = young, {}
        new = []
        for c in chunks:
            if c not in young:
                if c in old:
                    young[c] = old[c]
                else:
                    new.append(c)
        # chunks between two spaces are encoded many in a line; those with white space at an end, or long ones, by themselves
        whole = [len(c) > 100 or c != c.strip() for c in new]
        joined, single = [c for c, w in zip(new, whole) if not w], [[c] for c, w in zip(new, whole) if w]
        parts = [joined[at : at + LINE] for at in range(0, len(joined), LINE)] + single
        while parts:
            again = []
            for part, both in zip(parts, self.encode([" ".join(p) for p in parts])):
                if both is not None:
                    stops = np.cumsum([len(c.encode()) + 1 for c in part])
                    young.update(zip(part, self.aligned(*both, stops)))
                elif len(part) > 1:
                    again += [[c] for c in part]
                else:
                    young[part[0]] = None
            parts = again
        return young

    def texts(self, texts: list[str | None]):
        """For each text (n_a, n_b, n_groups, hash of the groups, pairs as an array), None for those without tokens."""
        split = [_BETWEEN.split(t) if t and len(t) < 1 << 20 else None for t in texts]
        known = self.learn({c for chunks in split if chunks for c in chunks})
        for text, chunks in zip(texts, split):
            if not text:
                yield None
                continue
            if chunks is None:
                parts = (map(self.learn(set(part)).__getitem__, part) for part in _parts(text))
            else:
                if known is not self.young:
                    known = self.learn(set(chunks))
                parts = [map(known.__getitem__, chunks)]
            yield self._whole(text, parts)
            if chunks is None:
                known = None

    def _whole(self, text: str, parts):
        n_a = n_b = 0
        pairs, groups = [], hashlib.sha256()
        for found in parts:
            found = list(found)
            if None in found:  # the bytes of the whole text decide
                both = next(self.encode([text]))
                return both and self._whole(text, [self.aligned(*both, np.array([len(text.encode()) + 1]))])
            texts, codes, of_a, of_b = zip(*found)
            groups.update((b";" if n_a else b"") + b";".join(texts))
            pairs += codes
            n_a, n_b = n_a + sum(of_a), n_b + sum(of_b)
        codes = np.frombuffer(b"".join(pairs), np.int64)
        return n_a, n_b, len(codes), groups.hexdigest(), codes


def _parts(text: str):
    """Chunks of a very long text, in lists from about a megabyte each."""
    at = 0
    while at < len(text):
        found = _BETWEEN.search(text, at + (1 << 20))
        end = found.start() if found else len(text)
        yield _BETWEEN.split(text[at:end])
        at = end + 1


def bits(places: np.ndarray) -> bytes:
    """A bitmap of ascending 16-bit numbers."""
    if len(places) < DENSE:
        return places.astype("<u2").tobytes()
    full = np.zeros(BYTES * 8, np.uint8)
    full[places] = 1
    return np.packbits(full, bitorder="little").tobytes()


def places(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < BYTES:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def union(x: bytes, y: bytes) -> bytes:
    """OR of two bitmaps."""
    if len(x) + len(y) < BYTES:
        p, q = places(x), places(y)
        return x + y if not len(p) or not len(q) or p[-1] < q[0] else bits(np.union1d(p, q))
    if len(x) == len(y) == BYTES:
        return (np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8)).tobytes()
    return bits(np.union1d(places(x), places(y)))


class _Block:
    """Bitmaps of the documents of one block."""

    def __init__(self):
        self.docs = self.links = self.waiting = 0
        self.raw: list[tuple] = []
        self.maps: dict[tuple[int, int], bytes] = {}

    def add(self, pairs: np.ndarray | None) -> int:
        """The number of the document in the block."""
        if pairs is not None and len(pairs):
            codes, times = np.unique(pairs, return_counts=True)
            self.raw.append((codes, np.full(len(codes), self.docs, np.uint16), times))
            self.waiting += len(codes)
            self.links += len(codes)
            if self.waiting >= FLUSH:
                self.flush()
        self.docs += 1
        return self.docs - 1

    def full(self) -> bool:
        return self.docs >= DOCS or self.links >= LINKS or len(self.maps) >= PAIRS

    def flush(self) -> None:
        if not self.raw:
            return
        codes, docs, times = map(np.concatenate, zip(*self.raw))
        self.raw, self.waiting = [], 0
        order = np.argsort(codes, kind="stable")
        codes, docs, more = codes[order], docs[order], times[order] - 1
        self._store(codes, docs, 0)
        plane = 1
        while len(more):
            odd = (more & 1) > 0
            self._store(codes[odd], docs[odd], plane)
            left = more > 1
            codes, docs, more, plane = codes[left], docs[left], more[left] >> 1, plane + 1

    def _store(self, codes: np.ndarray, docs: np.ndarray, plane: int) -> None:
        maps, data = self.maps, docs.astype("<u2").tobytes()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        for code, s, e in zip(codes[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(codes)]):
            new, before = data[2 * s : 2 * e] if e - s < DENSE else bits(docs[s:e]), maps.get((code, plane))
            maps[code, plane] = new if before is None else union(before, new)


def index(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (block, place, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) and postings (pair, block, plane, bits), from one pass.

    first: path of a byte-level file of the tokenizers library; second: path of a sentencepiece model."""
    with open(first) as f, open(second, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made, number, block = _kept(*shared.value), TaskContext.get().partitionId() << 24, _Block()
        names = ["block", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "plane", "bits"]
        kinds = [pa.int64(), pa.int32(), None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]

        def postings(kind):
            block.flush()
            keys = list(block.maps)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                own = {"block": [number] * len(part), "pair": [k[0] for k in part], "plane": [k[1] for k in part], "bits": [block.maps[k] for k in part]}
                yield pa.RecordBatch.from_arrays([pa.array(own[n], t) if n in own else pa.nulls(len(part), t or kind) for n, t in zip(names, kinds)], names=names)

        known = None
        for batch in batches:
            known = batch.column("doc_id")
            for at in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(at, ROWS), []
                for k, found in enumerate(made.texts(part.column("text").to_pylist())):
                    n_a, n_b, n_groups, groups, pairs = found or (0, 0, 0, "", None)
                    rows.append((number, block.add(pairs), n_a, n_b, n_groups, groups))
                    if block.full():
                        yield from postings(known.type)
                        number, block = number + 1, _Block()
                blocks, order, *others = zip(*rows)
                columns = [blocks, order, part.column("doc_id"), *others]
                filled = [c if t is None else pa.array(c, t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*filled, *[pa.nulls(len(rows), t) for t in kinds[7:]]], names=names)
        if known is not None:
            yield from postings(known.type)

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    both = common.cut(slim.mapInArrow(run, f"block long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, plane int, bits binary"))
    rows = both.where("pair IS NULL").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    return rows, both.where("pair IS NOT NULL").select("pair", "block", "plane", "bits")


#: What a Python worker has learnt; the next task goes on with it.
_KEPT: dict[int, Aligner] = {}


def _kept(first: str, second: bytes) -> Aligner:
    key = hash((first, second))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Aligner(first, second)
    return _KEPT[key]


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, a, b, n_docs, n_links and best (no pair of its b has more links), from popcounts."""
    ones = F.when(F.length("bits") < BYTES, F.length("bits") / 2).otherwise(F.bitmap_count("bits")).cast("long")
    weight = F.when(F.col("plane") == 0, 1).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    counts = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, ones)).alias("n_docs"), F.sum(ones * weight).alias("n_links"))
    counts = common.cut(counts.select("pair", F.shiftright("pair", _SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "n_docs", "n_links"))
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, count_sum and n_best of the documents that hold a link: pairs' counts sent along their postings."""

    def gather(batches):
        import pyarrow as pa

        for table in common.runs(batches, ["block"]):
            # a table may hold several whole blocks
            block = table["block"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            weight = np.where((plane := table["plane"].to_numpy()) == 0, 1, np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64))
            links = table["n_links"].to_numpy() * weight
            best = np.where(table["best"].to_numpy(zero_copy_only=False), weight, 0)
            maps = table["bits"]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                sums = np.zeros((2, DOCS), np.int64)
                found = [places(m) for m in maps[s:e].to_pylist()]
                at, times = np.concatenate(found).astype(np.int64), [len(x) for x in found]
                np.add.at(sums[0], at, np.repeat(links[s:e], times))
                np.add.at(sums[1], at, np.repeat(best[s:e], times))
                held = np.flatnonzero(sums[0])
                arrays = [pa.array(np.full(len(held), block[s])), pa.array(held.astype(np.int32)), pa.array(sums[0][held]), pa.array(sums[1][held])]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "place", "count_sum", "n_best"])

    back = postings.join(counts.select("pair", "n_links", "best"), "pair").select("block", "plane", "bits", "n_links", "best")
    parts = back.repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(gather, "block long, place int, count_sum long, n_best long")


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each document."""
    rows, postings = index(docs, first, second, doc_id, text)
    found = scores(postings, pair_counts(postings))
    none = F.lit(0).cast("long")
    both = rows.join(found, ["block", "place"], "left")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
                       F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
