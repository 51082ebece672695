"""Token files: ids of whole documents as ORC, in ascending order of document ids, read back by stripes.

Format. A folder of ORC files, one shard of the id order each (partition column `shard`): doc_id, n_tokens and the array ids, rows sorted by
doc_id. ORC holds whole numbers run-length encoded, an index every 10,000 rows, stripes of `STRIPE` bytes that tasks read side by side, and a
Bloom filter on doc_id: a lookup reads the stripes whose bounds and filter let an id pass.

Scale. Bounds of the shards come from ranges of doc_id alone; texts are encoded where they are read, and only ids are shuffled, each shard to
one task of bounded size. The rows of one id, or of none, are dealt to several shards when they are many. Starts are running sums inside a shard plus the sums
of the shards before.

Defined results: a null text is an empty one and has the end id only; rows without an id come first; rows that repeat an id stand next to each
other, in any order; strings of special tokens have their ids where they are written exactly so; an empty table gives an empty file; other columns
are not looked at.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm import common
from webquarry.llm.triebpe import byte_characters

END = 1
#: Documents of a shard, about, and the number of shards from which they get larger instead.
SHARD, SHARDS = 8192, 20_000
#: Before all ids, and after all of the rest of a place.
_LEAST, _ALL = -(1 << 63) - 1, 1 << 63
STRIPE = 16 << 20
#: Words that a worker keeps with their ids, in each of two generations.
MEMO = 300_000
#: Bytes of text whose words are looked up at once.
LOOKUP = 4 << 20


def bounds(docs: DataFrame, doc_id: str, text: str = "text", shard: int = SHARD, most: int = SHARDS) -> list[tuple]:
    """The last place of each shard but the last, as (id, size and hash of the text, number): places are ordered like that, none before all ids.

    Ids are sorted by ranges, and a row a range comes back. An id, or none, with more rows than two shards has its rows sorted further;
    the number parts even equal rows."""
    n = docs.count()
    shard = max(shard, math.ceil(n / most))
    if n <= shard:
        return []
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    hot = slim.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard)
    hot = {r["id"]: r["n"] for r in hot.collect()}  # not more than half as many as there are shards
    order = ["id", "size", "hash", "number"]
    ranges = slim.select("id").where(F.col("id").isNotNull()).repartitionByRange(math.ceil(n / shard), "id")
    last = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("id")).collect()
    found = [(r["id"], _ALL, _ALL, _ALL) for r in last]
    if hot:
        rows = slim.where(F.col("id").isin([i for i in hot if i is not None]) | (F.col("id").isNull() & F.lit(None in hot)))
        rows = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
        ranges = rows.repartitionByRange(math.ceil(sum(hot.values()) / shard), *order)
        last = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct(*order)).alias("m")).select("m.*").collect()
        found += [(_LEAST if r["id"] is None else r["id"], r["size"], r["hash"], r["number"]) for r in last]
        if None in hot:
            found.append((_LEAST, _ALL, _ALL, _ALL))
    return sorted(set(found))[:-1]


class _Words(dict):
    """Ids of words, as little-endian bytes, by the words' bytes.

    Of two generations: when the young one is full it becomes the old one, from which words in use come back, so no more than twice
    MEMO words are kept.

    Letters or digits and marks next to each other are parted first, as the tokenizer's pattern does. New words of letters only are merged in
    one go, a space between them: each is one piece of the pattern, and the last token of a piece is one with the vocabulary's end mark. All other
    words go through the tokenizer one by one."""

    def __init__(self, tokenizer):
        self.tokenizer, self.old = tokenizer, {}
        told = json.loads(tokenizer.to_str())
        model = told["model"]
        # the same model without the steps that do nothing to such words
        self.merging = type(tokenizer).from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.characters = {b: c for b, c in byte_characters().items() if b != 32}
        self.mark = model["end_of_word_suffix"]
        self.last = np.zeros(max(model["vocab"].values()) + 1000, bool)
        self.last[[i for t, i in model["vocab"].items() if t.endswith(self.mark)]] = True

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some stretches of text, one after the other, and how many each has. A word is looked up once, however often it occurs."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(_parted(texts))
        own = words.flatten().dictionary_encode()
        distinct = own.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = [*map(self.get, distinct)]
        gaps = [k for k, ids in enumerate(known) if ids is None]
        self.learn([distinct[k] for k in gaps])
        for k in gaps:
            known[k] = self[distinct[k]]
        found = pa.array(known, pa.binary()).take(own.indices)
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(found) + 1] if ends else np.zeros(1, np.int32)
        values = np.frombuffer(data or b"", "<u4")[: ends[-1] // 4]
        return values, np.diff(ends[words.offsets.to_numpy()].astype(np.int64)) // 4

    def learn(self, missing: list[bytes]) -> None:
        if len(self) + len(missing) > MEMO:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for w in missing:
            if (known := old.get(w)) is not None:
                self[w] = known
            else:
                new.append(w)
        self._encode(new)

    def _encode(self, new: list[bytes]) -> None:
        texts = [w.decode().lower() for w in new]
        plain = [_PLAIN.fullmatch(t) is not None for t in texts]
        joined, own = [k for k, p in enumerate(plain) if p], [k for k, p in enumerate(plain) if not p]
        parts = [joined[at : at + 500] for at in range(0, len(joined), 500)]
        lines = [" ".join([texts[k] for k in part]).encode().decode("latin-1").translate(self.characters) for part in parts]
        for part, found in zip(parts, self.merging.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            stops = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(stops) != len(part):
                own += part
                continue
            data, a = ids.tobytes(), 0
            for k, b in zip(part, stops):
                self[new[k]] = data[a:b]
                a = b
        for at in range(0, len(own), 1000):
            part = own[at : at + 1000]
            for k, found in zip(part, self.tokenizer.encode_batch_fast([new[k].decode() for k in part], add_special_tokens=False)):
                self[new[k]] = np.array(found.ids, "<u4").tobytes()


#: A word of letters below U+0180, in lower case: one piece of the tokenizer's pattern, and in normal form.
_PLAIN = re.compile("[a-zªµºß-öø-ſ]+")
#: Kinds of bytes: 1 for letters and digits, 2 for marks. No piece of the tokenizer's pattern holds one of each next to each other. Apostrophes,
#: which begin contractions, and the signs of special tokens are of no kind.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = 1
_KINDS[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2


def _parted(texts: list[bytes]):
    """The texts as an Arrow array, with a space between letters or digits and marks."""
    import pyarrow as pa

    data = np.frombuffer(b"".join(texts), np.uint8)
    kinds = _KINDS[data]
    # letters of Latin-1 end in a byte of their own: all after 0xC3 but those of the signs for times and division
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    kinds[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = 1
    cuts = np.flatnonzero(kinds[:-1] + kinds[1:] == 3) + 1
    ends = np.cumsum([0, *map(len, texts)])
    ends += np.searchsorted(cuts, ends, "left")
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.insert(data, cuts, 32)))


#: What a Python worker has learnt, by the tokenizer's text: the next task goes on with it.
_KEPT: dict[str, _Words] = {}


def _stretches(data: bytes | None) -> Iterator[bytes]:
    """A text, a megabyte at a time.

    A-Z are lowered here only where that is what the tokenizer does: its special tokens are found first, as they are written, and it joins letters with
    marks above and below them before it lowers letters, and not all lower letters have the forms of upper ones."""
    data = data or b""
    if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
        data = data.lower()
    return common.stretches(data)


def _encoded(words: _Words, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, one after the other, each with its end id, and how many each has; about `LOOKUP` bytes are split into words at once."""
    sizes, runs, owners, held, n = np.zeros(len(texts), np.int64), [], [], [], 0

    def look() -> None:
        values, found = words.ids(held)
        runs.append(values)
        np.add.at(sizes, owners, found)
        owners.clear()
        held.clear()

    for k, text in enumerate(texts):
        for part in _stretches(text):
            owners.append(k)
            held.append(part)
            n += len(part)
            if n >= LOOKUP:
                look()
                n = 0
    if held:
        look()
    values = np.concatenate(runs) if runs else np.zeros(0, "<u4")
    return np.insert(values, np.cumsum(sizes), end), sizes + 1


def encode(docs: DataFrame, path: str, edges: list[tuple], doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """shard, doc_id, n_tokens, ids, crc: the whole texts by a tokenizer of the tokenizers library, the end id after each.

    White space has no ids in the vocabulary and separates pieces, so words are encoded once and looked up from then on."""
    with open(path) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    # an id whose rows fill several shards needs the rest of its place
    split = any(e[1] != _ALL for e in edges)
    last = np.array([e[0] for e in edges if e[0] != _LEAST], np.int64)

    def shards(part) -> np.ndarray:
        if not split:
            known = part.column("doc_id")
            return np.where(known.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(last, known.fill_null(0).to_numpy(), "left"))
        places = zip(*(part.column(c).to_pylist() for c in ("doc_id", "size", "hash", "number")))
        return np.array([bisect_left(edges, (_LEAST if i is None else i, *rest)) for i, *rest in places])

    def run(batches):
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if shared.value not in _KEPT:
            _KEPT.clear()
            _KEPT[shared.value] = _Words(Tokenizer.from_str(shared.value))
        words = _KEPT[shared.value]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            # rows of some megabytes of text go on at a time
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends // LOOKUP)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                values, sizes = _encoded(words, texts.slice(a, b - a).to_pylist(), end)
                stops = np.r_[0, np.cumsum(sizes)]
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(values.view("<i4")))
                sums = [zlib.crc32(values[i:j].data) for i, j in zip(stops[:-1], stops[1:])]
                arrays = [pa.array(shards(part).astype(np.int32)), part.column("doc_id"), pa.array(sizes), lists, pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "doc_id", "n_tokens", "ids", "crc"])

    places = [F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("hash"), F.monotonically_increasing_id().alias("number")]
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(places if split else []))
    return slim.mapInArrow(run, "shard int, doc_id long, n_tokens long, ids array<int>, crc long")


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> None:
    """Write the documents' ids as a folder of ORC files."""
    edges = bounds(docs, doc_id, text, shard)
    encoded = encode(docs, tokenizer, edges, doc_id, text)
    ordered = encoded.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "crc").drop("crc")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(STRIPE), "compression": "zstd"}
    ordered.write.options(**options).partitionBy("shard").orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids, shard; filters on doc_id prune files and stripes by their metadata."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>, shard int").orc(folder)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document's first), n_tokens, ids_crc32 of what the files hold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("ids")
            ends, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(values[a:b].data) for a, b in zip(ends[:-1], ends[1:])]
            arrays = [batch.column("shard"), batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "doc_id", "n_tokens", "ids_crc32"])

    found = common.cut(read(spark, folder).select("shard", "doc_id", "ids").mapInArrow(run, "shard int, doc_id long, n_tokens long, ids_crc32 long"))
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row a shard
    inside = Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    return found.join(before, "shard").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """doc_id, ids of some documents, by the files' metadata."""
    return read(spark, folder).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_folder(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return positions(spark, folder)
