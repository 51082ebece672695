"""Language identification, mixing and byte-level BPE: held-out accuracy, SQL, the public library and small odd tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from webquarry.llm import bpe, langid, mixture, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(2)
    texts = ["", " ", "\n\n \t x", "a" * 4000, "don't WON'T we're  12345 ", "éà 漢字 こんにちは 😀😀 <|endoftext|>", "ab " * 500, "\x1c\x85\xa0　."]
    return texts + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF), 10, 32])) for _ in range(200)) for _ in range(60)]


def test_perfect_hash(vocabulary):
    h = vocabulary.hash
    assert sorted(h.values) == list(range(h.n)) and all(h.keys)
    assert all(h.find(t) == i for i, t in enumerate(sorted(vocabulary.ranks, key=vocabulary.ranks.get)))
    assert h.find(b"no token of this kind") == -1
    for n in (1, 2, 3, 50):
        small = bpe.PerfectHash([str(i).encode() for i in range(n)])
        assert [small.find(str(i).encode()) for i in range(n)] == list(range(n)) and small.find(b"x") == -1


def test_ids_are_the_librarys(spark, vocabulary, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 1), (None, "x", 1)], "doc_id long, text string, ids int")
    got = {r[0]: r[1] for r in bpe.encode(docs, vocabulary, public_tokenizers.PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]
    assert got[-1] == []
    assert all(bpe.decode(got[i], vocabulary).decode() == t for i, t in enumerate(texts))


def test_digest_of_documents(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op6_byte_bpe"](spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d, t in rows:
        ids = library.encode_ordinary(t)
        assert got[d] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))


def test_digest_in_pieces(spark, vocabulary, library, monkeypatch):
    text = "Tion thé 12, " * 90_000  # over a million characters
    got = bpe.digest(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), vocabulary, public_tokenizers.PATTERN).collect()
    ids = library.encode_ordinary(text)
    assert [r["n_tokens"] for r in got] == [len(ids), 0]
    assert got[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_memo_stays_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    memo = bpe._Memo(vocabulary)
    assert [memo[f" {i}"] for i in range(500)] == [memo.encode(f" {i}".encode()) for i in range(500)]
    assert len(memo) <= 50


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.select("doc_id", "lang", "text").join(registry.QUERIES["op3_langid"](spark, "/root/testdata/sf0.01"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0


def test_kernel_against_brute_force():
    rows = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), ("a dog and a log", "en"), ("un chien et un sapin", "fr")]
    model = langid.fit(rows, landmarks=3)
    def grams(t):
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    chosen = [rows[k][0] for k in (0, 1, 2)]
    text = "The chat, the mat"
    a = grams(text.lower())
    want = [len(a & grams(c)) / (len(a) * len(grams(c))) ** 0.5 for c in chosen]
    assert model.kernel([langid.ngrams(text)])[0] == pytest.approx(want)
    assert [p[0] for p in model.predict([t for t, _ in rows])] == [l for _, l in rows]


def test_ngrams_in_pieces(monkeypatch):
    text = "Äbc déf\n" * 50
    whole = langid.ngrams(text).tolist()
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert langid.ngrams(text).tolist() == whole


def test_texts_without_language(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", "en"), (4, "the cat sat", "en"), (5, "le chat est", "fr"), (None, "the dog", None), (5, "le chat est", "fr"), (6, "the the " * 300_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.learnt(docs)
    got = langid.identify(docs, model).collect()
    assert {r[0]: r[1] for r in got if r[0] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and len(got) == len(rows)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept.collect()) == [(0, "en"), (4, "en"), (5, "fr"), (5, "fr"), (6, "en")]
    assert langid.learnt(docs.limit(0)) is None and langid.keep_identified(docs.limit(0)).count() == 0
    assert {r[1] for r in langid.identify(docs, None).collect()} == {"und"}


def test_languages_of_long_texts_are_learnt(spark):
    short = [(i, f"the cat sat on the mat and the dog {i}", "en") for i in range(20)]
    long = [(100 + i, "le chat est sur le tapis et le chien dort " * 600 + str(i), "fr") for i in range(20)]
    docs = spark.createDataFrame(short + long, "doc_id long, text string, lang string")
    assert {(r["doc_id"] >= 100, r["lang_pred"]) for r in langid.identify(docs, langid.learnt(docs)).collect()} == {(False, "en"), (True, "fr")}
    only = docs.where("lang = 'fr'")
    assert langid.learnt(only).languages == ["fr"] and langid.keep_identified(only).count() == 20
    unlabelled = spark.createDataFrame([(1, "le chat", None), (2, "12 !", None), (3, None, None)], docs.schema)
    assert [tuple(r) for r in langid.keep_identified(unlabelled).collect()] == [(1, "le chat", None)]


def sql_mix(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixture.OP2_SQL})").fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_mixture_is_its_sql(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "", *[f"s{i}" for i in range(rnd.randint(1, 40))], "Z", "é"]
    rows = [(i, rnd.choice([None, "", " \n", " ".join("w" * rnd.randint(1, 30))]), rnd.choice(sources[: rnd.randint(1, len(sources))])) for i in range(400)]
    rows += [(1000 + i, "a b c", "hot") for i in range(500)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, source string, size int, key string").repartition(3)
    got = sorted(tuple(r) for r in mixture.mix(docs).collect())
    assert got == sql_mix(rows)
    by = {r[0]: r[2] for r in rows}
    total = sum(r[1] for r in got)
    assert sum({by[r[0]]: r[3] for r in got}.values()) == pytest.approx(total)
    assert all(r[3] <= 3 * r[2] + 1e-6 and r[4] <= 3 * r[1] for r in got)
    for s in set(by.values()):
        own = [r for r in got if by[r[0]] == s]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= max(r[1] for r in own)
    taken = sorted(r["doc_id"] for r in mixture.mixed(docs).collect())
    assert taken == sorted(r[0] for r in got if r[1] for _ in range(r[4] // r[1]))


def test_rows_without_an_id_or_with_one_id_are_taken_one_by_one(spark):
    schema = "doc_id long, text string, source string"
    ten, other = "w " * 10, [(1000 + i, "w " * 10, "b") for i in range(3)]
    for d in (None, 7):
        docs = spark.createDataFrame([(d, ten, "a")] * 3 + other, schema).repartition(2)
        got = [tuple(r) for r in mixture.mix(docs, weights=(1, 3)).collect() if r["doc_id"] == d]
        assert {r[3] for r in got} == {15.0} and sorted(r[4] for r in got) == [0, 10, 10]
        assert mixture.mixed(docs, weights=(1, 3)).where("source = 'a'").count() == 2
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2, i]), "w " * rnd.randint(0, 9), rnd.choice([None, "a", "b", "c", "d", "e"])) for i in range(600)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    plain = lambda rs: sorted(rs, key=lambda r: tuple((x is None, x or 0) for x in r))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = plain(c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixture.OP2_SQL})").fetchall())
    assert plain(tuple(r) for r in mixture.mix(docs).collect()) == want
    assert mixture.mixed(docs).count() == sum(r[4] // r[1] for r in want if r[1])


def test_mixture_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixture.mix(spark.createDataFrame([], schema)).count() == 0
    empty = mixture.mix(spark.createDataFrame([(1, None, "a"), (None, "", None)], schema)).collect()
    assert [tuple(r)[1:] for r in empty] == [(0, 0, 0.0, 0), (0, 0, 0.0, 0)]
    one = mixture.mix(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], schema)).collect()
    assert [tuple(r) for r in one] == [(1, 2, 4, 4.0, 2)] * 2


def test_sources_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SMALL", 0)
    got = {tuple(r) for r in registry.QUERIES["op2_mixture"](spark, SF).collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in registry.QUERIES["op2_mixture"](spark, SF).collect()}


def test_many_languages_and_long_texts(spark):
    """Thousands of languages are no deep plan, and landmarks of very long texts no large model."""
    rows = [(k, f"word{k} text of {k}", f"l{k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_grams(langid.training_rows(docs, "doc_id", "text", "lang"))
    assert len(model.languages) == 3000 and model.presence.shape[1] == langid.LANDMARKS
    rnd = random.Random(3)
    long = [("".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(60_000)), f"l{k % 2}") for k in range(12)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(long)], "doc_id long, text string, lang string")
    model = langid.fit_grams(langid.training_rows(docs, "doc_id", "text", "lang"))
    assert model.presence.nbytes <= 4 * langid.VOCABULARY * langid.LANDMARKS < 100e6
    assert all(len(g) <= langid.GRAMS for g, _ in langid.training_rows(docs, "doc_id", "text", "lang"))


def test_query_of_languages_against_plain_kernels(spark):
    """The query's own result: n-grams as Python strings, the kernel and the regression written out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.lang_pred, r.score) for r in registry.QUERIES["op3_langid"](spark, SF).collect()}
    learn = langid.training_rows(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    model = langid.fit_grams(learn)
    code = lambda g: sum((ord(c) + 1) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    for row in docs.select("doc_id", "text").collect()[:60]:
        text = row.text.lower()
        present = {code(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1)}
        kernel = [len(present & set(model.grams[model.presence[:, j] > 0].tolist())) / (len(present) ** 0.5 * model.norms[j]) for j in range(len(model.norms))]
        values = np.array(kernel) @ model.weights
        assert got[row.doc_id][0] == model.languages[int(values.argmax())]
        assert got[row.doc_id][1] == pytest.approx(min(1, max(0, (values.max() + 1) / 2)), abs=1e-4)


def test_mixture_of_many_small_beside_huge_sources(spark):
    """Shares of words times sources go beyond a long."""
    rows = [(f"s{k:06d}", 1) for k in range(20_000)] + [("huge1", 10**15), ("huge2", 10**15)]
    found = {r.source: r.target for r in mixture.water_fill(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert len(found) == 20_002 and sum(found.values()) == pytest.approx(2 * 10**15 + 20_000, rel=1e-6)
