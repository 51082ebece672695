"""BPE with word ends by a prefix trie: the last token of every shared prefix is found once, depth first, and words follow from it.

Method. In a BPE whose tokens each come from one merge of earlier ones, a list of tokens is the encoding of its text exactly if every two
neighbours stay apart when they alone are merged. So the encoding of a prefix is the encoding of a shorter prefix and one more token, and
a prefix needs but one number, its last token. Distinct words go into a trie in order, so that a depth-first walk meets each prefix once:
a new node takes the longest token that ends there and stays apart from the last token of the node where it begins. A word's last
character is a symbol of its own (it holds the mark of a word's end), hence a leaf; its ids are read back from leaf to root.

Two tokens stay apart if no merge joins a part at the right edge of the first with a part at the left edge of the second before either
part has been merged with its own neighbour. Answers are kept by pair.

Scale. No shuffle: texts are encoded where they are read. A worker keeps words, pairs and trie nodes from batch to batch up to `MEMO`,
`PAIRS` and `NODES`, then begins anew; longer words than `LONG` go through the same states without being kept. The tokenizer's
file, whose size is the vocabulary's, is the only thing sent to the tasks.

Defined results: a null text is an empty one and has no ids; the strings of special tokens have their ids, as in the library, before any
letter is lowered; very long texts are read a megabyte at a time; repeated rows and null ids are rows like others; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from struct import pack

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

#: Words in each of two generations and pieces, trie nodes and pairs of tokens that a worker keeps.
MEMO, NODES, PAIRS = 300_000, 600_000, 1_000_000
#: Characters of a piece from which it isn't kept.
LONG = 200
#: Rows that are split into words at once.
ROWS = 128

#: Pieces of a word of characters below U+0180 in lower case, as the tokenizer's pattern finds them: contractions, letters, one number, others
#: (fixed values of the vocabulary's format).
_LETTERS, _NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: Any character that the pattern above isn't made for: later ones, and white space that is no ASCII.
_STRANGE = re.compile("[\u0085 ]|[^\u0000-ſ]")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable ones of Latin-1 themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Model:
    """Vocabulary and merges of a tokenizer file, with the test for tokens that stay apart."""

    def __init__(self, text: str):
        told = json.loads(text)
        model = told["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in [*self.ids.items(), *self.special.items()]}
        self.merges: dict[tuple[int, int], int] = {}
        #: (left, right, rank) of the merge that makes a token
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            a, b, token = self.ids[a], self.ids[b], self.ids[a + b]
            if token in self.made or any(self.made.get(x, (0, 0, -1))[2] >= rank for x in (a, b)):
                raise ValueError("each token must come from one merge of earlier tokens")
            self.merges[a, b], self.made[token] = rank, (a, b, rank)
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.ids)
        self.sizes = {i: len(t.removesuffix(self.mark)) for t, i in self.ids.items()}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts at an edge of a token (0: left, 1: right), each with the rank of the merge that takes it up."""
        found = self._edges.get((token, side))
        if found is None:
            found, until, part = [], len(self.merges), token
            while True:
                found.append((part, until))
                if part not in self.made:
                    break
                until, part = self.made[part][2], self.made[part][side]
            self._edges[token, side] = found
        return found

    def apart(self, s: int, t: int) -> bool:
        """Whether the text of s and t, merged by itself, is s and t again."""
        known = self._apart.get((s, t))
        if known is None:
            rank_of, left = self.merges.get, self._edge(t, 0)
            # of merges with one rank the one further to the left comes first
            known = not any(
                rank < a_until and rank <= b_until
                for a, a_until in self._edge(s, 1) for b, b_until in left if (rank := rank_of((a, b))) is not None)
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            self._apart[s, t] = known
        return known


class Trie:
    """Prefixes of the pieces met so far, each with its last token; a node is known by its prefix, its parent by the prefix less a character."""

    def __init__(self, model: Model):
        self.model = model
        self.last: dict[str, int] = {}

    def _token(self, piece: str, end: int, last, mark: str = "") -> int:
        """Last token of piece[:end], where last(n) is that of piece[:n]."""
        get, apart = self.model.ids.get, self.model.apart
        for start in range(max(0, end - self.model.longest), end):
            token = get(piece[start:end] + mark if mark else piece[start:end])
            if token is not None and (start == 0 or apart(last(start), token)):
                return token
        raise ValueError(f"no token ends {piece[max(0, end - 20):end]!r}")

    def encode(self, pieces) -> dict[str, list[int]]:
        """Ids of distinct pieces (of the characters that stand for bytes), each prefix worked out once.

        In sorted order: pieces come as in a depth-first walk, so that only the nodes below the prefix shared with the piece before are new."""
        mark, sizes, known = self.model.mark, self.model.sizes, self.last
        out: dict[str, list[int]] = {}
        for piece in sorted(pieces):
            inner = len(piece) - 1
            if inner <= LONG:
                def last(n, piece=piece):
                    return known[piece[:n]]

                d = inner
                while d and piece[:d] not in known:
                    d -= 1
                for end in range(d + 1, inner + 1):
                    known[piece[:end]] = self._token(piece, end, last)
            else:
                lasts = [-1]
                last = lasts.__getitem__
                for end in range(1, inner + 1):
                    lasts.append(self._token(piece, end, last))
            at, ids = len(piece), [self._token(piece, len(piece), last, mark)]
            while at := at - sizes[ids[-1]]:
                ids.append(last(at))
            out[piece] = ids[::-1]
        return out


class Words:
    """Ids of words without white space, as little-endian bytes, by the words' bytes; of two generations, so that words in use stay."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.model = Model(text)
        self.trie = Trie(self.model)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: ids by piece; the string of a special token is a piece of its own, which no other piece equals
        self.of_piece: dict[str, bytes] = {t: pack("<I", i) for t, i in self.model.special.items()}
        self.tokenizer = Tokenizer.from_str(text)
        self.characters = byte_characters()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.model.special, key=len, reverse=True))) + ")") if self.model.special else None

    def pieces(self, word: str) -> list[str]:
        """The pieces that are merged by themselves, in the characters that stand for bytes."""
        if _STRANGE.search(word):  # normal form and classes of characters are the tokenizer's own
            return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]
        return [p.encode().decode("latin-1").translate(self.characters) for p in _PIECES.findall(word.lower())]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids by word, for the words asked for at least."""
        young, old, of_piece, special = self.young, self.old, self.of_piece, self.model.special
        if len(young) + len(words) > MEMO:
            self.old, self.young = old, young = young, {}
        new: dict[bytes, list[str]] = {}
        for w in words:
            if w not in young:
                known = old.get(w)
                if known is not None:
                    young[w] = known
                    continue
                text = w.decode()
                if "<" in text and self.specials:
                    new[w] = [x for part in self.specials.split(text) for x in ([part] if part in special else self.pieces(part))]
                else:
                    new[w] = self.pieces(text)
        if new:
            if len(self.trie.last) > NODES:
                self.trie.last.clear()
            if len(of_piece) > MEMO:
                of_piece.clear()
                of_piece.update((t, pack("<I", i)) for t, i in special.items())
            asked = {x for found in new.values() for x in found if x not in of_piece}
            for piece, ids in self.trie.encode(asked).items():
                of_piece[piece] = pack(f"<{len(ids)}I", *ids)
            for w, found in new.items():
                young[w] = b"".join([of_piece[x] for x in found])
        return young


#: What a Python worker has learnt, by the tokenizer's text: the next task goes on with it.
_KEPT: dict[str, Words] = {}


def _kept(text: str) -> Words:
    if text not in _KEPT:
        _KEPT.clear()
        _KEPT[text] = Words(text)
    return _KEPT[text]


def _ids(words: Words, texts: list[str | None]):
    """For each text its ids as little-endian bytes, in parts of about a megabyte of text."""
    split = [[*common.word_chunks((t or "").encode())] if len(t or "") < 1 << 20 else None for t in texts]
    known = words.learn({w for chunks in split if chunks for chunk in chunks for w in chunk})
    for text, chunks in zip(texts, split):
        if chunks is None:
            yield (b"".join(map(words.learn(set(chunk)).__getitem__, chunk)) for chunk in common.word_chunks(text.encode()))
            known = words.young
        else:
            if known is not words.young:
                known = words.learn({w for chunk in chunks for w in chunk})
            yield (b"".join(map(known.__getitem__, chunk)) for chunk in chunks)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the whole texts' ids by the tokenizer file at `path`."""

    def rows(words, texts):
        import pyarrow as pa

        ids = [b"".join(parts) for parts in _ids(words, texts)]
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))}

    return _mapped(docs, path, doc_id, text, rows, "ids array<int>")


def decode(ids: bytes, model: Model) -> bytes:
    """The tokens of ids (little-endian, of 32 bits), a space between each two, as a tokenizer without decoder writes them."""
    return b" ".join(map(model.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian ids of 32 bits), decoded_sha256 (of the text decoded from the ids)."""

    def rows(words, texts):
        import pyarrow as pa

        sizes, coded, decoded = [], [], []
        for parts in _ids(words, texts):
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in parts:
                if ids:
                    ids_hash.update(ids)
                    text_hash.update((b" " if n else b"") + decode(ids, words.model))
                    n += len(ids) // 4
            sizes.append(n)
            coded.append(ids_hash.hexdigest())
            decoded.append(text_hash.hexdigest())
        return {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(coded), "decoded_sha256": pa.array(decoded)}

    return _mapped(docs, path, doc_id, text, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, rows, schema: str) -> DataFrame:
    """doc_id and the columns that rows(words, texts) makes; ids stay Arrow's, so that whole numbers beside nulls are not touched."""
    with open(path) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        words = _kept(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = rows(words, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made.values()], names=["doc_id", *made])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {schema}")


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
