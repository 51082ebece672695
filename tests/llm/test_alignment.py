"""Alignment of two tokenizers against a plain walk over both token lists."""

import hashlib
import os
import random
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers as public
import pytest

from webquarry.llm import alignment, registry

SF = "/root/testdata/sf0.001"
FIRST, SECOND = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
os.environ["TOKENIZERS_PARALLELISM"] = "false"


def aligner():
    with open(FIRST) as f, open(SECOND, "rb") as g:
        return alignment.Aligner(f.read(), g.read())


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(FIRST)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.bytes = aligner()

    def __call__(self, text):
        """n_a, n_b, n_groups, hash, list of (a, b) links; None without tokens."""
        if not text:
            return None
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        of_a, of_b = [self.bytes.a[i] for i in a], [self.bytes.b[i] for i in b]
        if not b"".join(of_a) == (" " + text).encode() == b"".join(of_b):
            return None
        ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
        shared, groups, links, i, j = sorted({*ends_a} & {*ends_b}), [], [], 0, 0
        for end in shared:
            ni, nj = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
            links.append((a[ni - 1], b[nj - 1]))
            i, j = ni, nj
        return len(a), len(b), len(shared), hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    def corpus(self, texts):
        """Rows of the whole operator."""
        found = [self(t) for t in texts]
        counts = Counter(x for f in found if f for x in f[4])
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        for f in found:
            if f is None:
                yield 0, 0, 0, 0, 0, 0, ""
            else:
                yield f[0], f[1], f[2], len(f[4]), sum(counts[x] == most[x[1]] for x in f[4]), sum(counts[x] for x in f[4]), f[3]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


SIGNS = {
    "prose": "abcdefg  hij.,'\nst", "latin": [chr(c) for c in range(0x20, 0x180)] + [" "] * 60, "all": [chr(c) for c in range(1, 0x3000)] + [" "] * 3000,
    "spaces": [chr(c) for c in range(0x1C, 0x22)] + ["▁", "a", "\xa0", " ", "\x85", " "],
    "specials": ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " ", "a", "\n"],
    "far": [chr(c) for c in [*range(0x4E00, 0x5000), *range(0x1F300, 0x1F600)]] + [" "] * 50,
}


@pytest.mark.parametrize("signs", SIGNS)
def test_random_texts(plain, signs):
    rnd, own = random.Random(signs), aligner()
    texts = ["".join(rnd.choices(SIGNS[signs], k=rnd.randint(0, 30))) for _ in range(1000)]
    texts += [None, "", " ", "ab \n" * 300_000 + "Z" * 300, "x▁y " * 300_000]
    for text, got in zip(texts, own.texts(texts)):
        want = plain(text)
        assert (got is None) == (want is None), text
        assert got is None or (got[:4] == want[:4] and got[4].tolist() == [a << 16 | b for a, b in want[4]]), text


def test_query(spark, plain):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.QUERIES["op11_alignment"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got == dict(zip([d for d, _ in rows], plain.corpus([t for _, t in rows])))


def test_small_blocks(spark, plain, monkeypatch):
    """Nulls, repeated rows and ids, large ids beside nulls, many repeats of a pair in a text, blocks of a few documents."""
    texts = ["the cat the cat the cat the dog", "a\nb", None, "", "x▁y", "the cat", "the cat", "zzz the cat " * 70, "the dog"]
    ids = [2**60 + 1, None, 3, 4, 5, 6, 6, None, 9]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, place long").coalesce(1)
    want = sorted((i or 0, *row) for i, row in zip(ids, plain.corpus(texts)))
    got = alignment.align(docs, FIRST, SECOND)
    assert sorted((r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in got.collect()) == want
    assert alignment.align(docs.limit(0), FIRST, SECOND).count() == 0


def test_pair_counts(spark, plain):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, "the cat")], "doc_id long, text string")
    rows, postings = alignment.index(docs, FIRST, SECOND)
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(postings).collect()}
    links = [plain(t)[4] for t in ("the cat the cat", "the cat")]
    assert got == {x: (sum(x in own for own in links), sum(own.count(x) for own in links)) for own in links for x in own}


def test_blocks_close_and_bitmaps_merge(monkeypatch):
    rnd, block, truth = random.Random(3), alignment._Block(), Counter()
    monkeypatch.setattr(alignment, "FLUSH", 500)
    for doc in range(20_000):
        pairs = rnd.choices(range(8), k=rnd.randint(0, 6)) + ([99] * 9 if doc % 1000 == 0 else [])
        block.add(np.array(pairs, np.int64))
        for p, n in Counter(pairs).items():
            truth[p, doc] = n
    block.flush()
    got = Counter()
    for (pair, plane), held in block.maps.items():
        assert len(held) in (alignment.BYTES, 2 * len(alignment.places(held)))
        for doc in alignment.places(held):
            got[pair, int(doc)] += 1 if plane == 0 else 1 << plane - 1
    assert got == truth
    monkeypatch.setattr(alignment, "PAIRS", 3)
    assert block.full()


@pytest.mark.parametrize("sizes", [(3, 5), (3000, 3000), (5000, 5), (5000, 60000)])
def test_union(sizes):
    rnd = random.Random(str(sizes))
    x, y = (sorted(rnd.sample(range(65536), n)) for n in sizes)
    both = alignment.union(alignment.bits(np.array(x)), alignment.bits(np.array(y)))
    assert alignment.places(both).tolist() == sorted({*x, *y})
