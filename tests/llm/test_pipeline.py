"""The whole pipeline against its stages written plainly, and stages on odd tables."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_dedup import groups, plain_fingerprint  # noqa: E402

from webquarry.llm import bpe, mixture  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_of_each_group(rows):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    group = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    return [r for r in rows if group[r["doc_id"]] == r["doc_id"]]


def without_repeats(rows, width=50):
    least = {}
    for r in rows:
        words = WORD.findall(r["text"])
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        words = list(WORD.finditer(r["text"]))
        gone = set()
        for i in range(len(words) - width + 1):
            if least[tuple(m[0] for m in words[i : i + width])] < r["doc_id"]:
                gone |= set(range(i, i + width))
        text = r["text"][: words[0].start()] if words else r["text"]
        for i, m in enumerate(words):
            if i not in gone:
                text += r["text"][m.start() : words[i + 1].start() if i + 1 < len(words) else None]
        out.append({**r, "text": text})
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    rows = without_repeats(one_of_each_group(rows))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in rows])
    taken = {d: n // size for d, size, n in c.execute(f"SELECT doc_id, size, taken FROM ({mixture.OP2_SQL}) WHERE size > 0").fetchall()}
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r["text"])
        row = (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        want[row] += taken.get(r["doc_id"], 0)
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and sum(got.values()) > 100


def test_stages_keep_columns_of_odd_tables(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "le chat est sur le tapis", "fr", None, 9), (3, "the cat sat on the mat", "en", "a", 9), (3, "the cat sat on the mat", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert {r["doc_id"] for r in last.collect()} == ({None, 3} if table is docs else set())
