"""The trie encoder against the tokenizers library."""

import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from webquarry.llm import registry, triebpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    with open(PATH) as f:
        return triebpe.Words(f.read())


def same(words, library, texts):
    for text, parts in zip(texts, triebpe._ids(words, texts)):
        got = b"".join(parts)
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert triebpe.decode(got, words.model).decode() == library.decode(want, skip_special_tokens=False)


SIGNS = {
    "letters": "abcdefghijklmnopqrst ", "contractions": "aAbB'sStT <|>", "runs": ["a", "aa", "aaa", "b"],
    "latin": [chr(c) for c in range(0x20, 0x180)], "all": [chr(c) for c in range(1, 0x3000)],
    "marks": [chr(c) for c in range(0x300, 0x340)] + list("aeiouHTWYJhtwyjI "),
    "specials": ["<|endoftext|>", "<|ENDOFTEXT|>", "<|Endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", " ", "a", "H", "̱", "'S", "<", ">"],
    "far": [chr(c) for c in range(0x10000, 0x20000, 7)] + [" "],
}


@pytest.mark.parametrize("signs", SIGNS)
def test_random_texts(words, library, signs):
    rnd = random.Random(signs)
    same(words, library, ["".join(rnd.choices(SIGNS[signs], k=rnd.randint(0, 30))) for _ in range(1500)])


def test_edges(words, library):
    same(words, library, [None, "", " \n\t", "a" * 3000, "ab" * 2000 + " x", "word " * 250_000 + "Z" * 300, "H̱ T̈ İ K"])


def test_shared_prefixes_once(words):
    trie = triebpe.Trie(words.model)
    trie.encode({"running", "runner", "runs"})
    assert set(trie.last) == {"r", "ru", "run", "runn", "runni", "runnin", "runne"}


def test_little_memory(words, library, monkeypatch):
    for name in ("MEMO", "NODES", "PAIRS"):
        monkeypatch.setattr(triebpe, name, 50)
    with open(PATH) as f:
        small = triebpe.Words(f.read())
    rnd = random.Random(5)
    same(small, library, ["".join(rnd.choices("abcde ", k=60)) for _ in range(300)])


def test_rejects_other_vocabularies():
    with pytest.raises(ValueError):
        triebpe.Model('{"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "end_of_word_suffix": "", "merges": ["a b", "a b"]}}')


def test_query(spark, library):
    got = {r.doc_id: r for r in registry.QUERIES["op13_trie_bpe"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want


def test_nulls_and_large_ids(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b", 1), (None, "a b", 2), (None, None, 3), (5, "", 4), (5, "", 4)], "doc_id long, text string, ids long")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in triebpe.digest(docs.coalesce(1), PATH).collect())
    assert got == [(0, 0), (0, 2), (5, 0), (5, 0), (2**60 + 1, 2)]
    assert sorted(len(r.ids) for r in triebpe.encode(docs.coalesce(1), PATH).collect()) == [0, 0, 0, 2, 2]
    assert triebpe.digest(docs.limit(0), PATH).count() == 0
