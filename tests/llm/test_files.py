"""License scans, token files and quality posteriors against brute force and the public library."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webquarry.llm import common, licenses, quality, registry, tokenfile

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, templates=licenses.TEMPLATES):
    words, at, base, labels, score = plain_words(text), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    all_kinds = {label: set(plain_words(template)) for label, template in templates.items()}
    for label, template in templates.items():
        t, kinds = plain_words(template), all_kinds[label]
        size, need = min(len(words), -(-len(t) * 5 // 4)), len(kinds) * licenses.THRESHOLD - 1e-9
        rivals = [k for k in all_kinds.values() if k != kinds and len(k & kinds) >= need]
        own = [kinds - k for k in rivals if kinds - k]
        foreign = set().union(*(k - kinds for k in rivals if kinds < k))
        blocks = (set(words[i : i + size]) for i in range(len(words) - size + 1))
        share = max((len(kinds & b) / len(kinds) for b in blocks if not b & foreign and all(b & o for o in own)), default=0)
        if share * len(kinds) >= need:
            labels.add(label)
            score = max(score, share)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score


def scan_texts():
    rnd = random.Random(6)
    filler = ["the", "of", "license", "software", "copy", "é1", "Free", "to", "in", "x-y", "use"]
    say = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    texts = [None, "", "...", "mit", "under the MIT license", "Under\nthe-MIT license under the mit license", "cc by nc cc by nc by nc", "éunder the mit license", "Apache License, Version 2.0", "cc by ncx", say(300)]
    for template in licenses.TEMPLATES.values():
        words = template.split()
        for drop in (0, 0.1, 0.19, 0.21, 0.4):
            kept = [w for w in words if rnd.random() >= drop]
            texts.append(f"{say(rnd.randint(0, 40))} {' '.join(kept)} {say(rnd.randint(0, 40))}")
        mixed = [w for x in words for w in ([x, rnd.choice(filler)] if rnd.random() < 0.3 else [x])]
        texts.append(" ".join(mixed))
        rnd.shuffle(words)
        texts.append(" ".join(words))
    return texts


def test_scan(spark):
    texts = scan_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "under the mit license", "x", 1)], "doc_id long, text string, labels string, score int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = plain_scan(t)
        assert got[i][:-1] == want[:-1], t
        assert got[i][-1] == pytest.approx(want[-1])
    assert got[None][1] == 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_creative_commons_told_apart(spark):
    notice = "This work is licensed under a Creative Commons {} 4.0 International License"
    kinds = {"cc-by": "Attribution", "cc-by-nc": "Attribution-NonCommercial", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike"}
    docs = spark.createDataFrame([(i, notice.format(k)) for i, k in enumerate(kinds.values())], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == list(kinds)


def test_many_templates(spark):
    """300 templates from one small vocabulary, so that prefixes hit often and blocks nearly match."""
    rnd = random.Random(8)
    made = {f"t{k}": " ".join(rnd.sample([f"w{i}" for i in range(60)], rnd.randint(3, 12))) for k in range(300)}
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(60)] + ["other"] * 30, k=rnd.randint(0, 60))) for _ in range(60)] + list(made.values())[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(docs, templates=made).collect()}
    want = {i: plain_scan(t, made) for i, t in enumerate(texts)}
    assert got == {i: (w[5], round(w[6], 9)) for i, w in want.items()}


def test_scan_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op5_licenses"](spark, SF).collect()}
    assert got == {d: plain_scan(t) for d, t in rows}


def test_words_of_chunks(monkeypatch):
    text = "".join(scan_texts()[k] or "" for k in range(10, 30))
    want = licenses.words_line(text)
    assert want.decode().split(" ")[1:-1] == plain_words(text)
    chunks = common.word_chunks
    monkeypatch.setattr(common, "word_chunks", lambda data: chunks(data, 50))
    assert licenses.words_line(text) == want


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_positions(library, rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_file_of_documents(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in registry.QUERIES["op8_tokenfile"](spark, SF).collect())
    assert got == plain_positions(library, rows)


@pytest.mark.parametrize("shard", [7, 8192])
def test_file_of_odd_texts(spark, library, shard, tmp_path):
    texts = [None, "", " \n", "a" * 3000, "Don't STOP 123 <|endoftext|> x<|startoftext|>y", "é é ΑΣ İ z　 漢字 😀", "\x1c\x85 a\x00b"]
    rows = [(3 * i - 40, texts[i % len(texts)]) for i in range(60)] + [(None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(4)
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), shard=shard)
    got = sorted((tuple(r) for r in tokenfile.positions(spark, path).collect()), key=lambda r: (r[0] is not None, r[0]))
    assert got == plain_positions(library, rows)
    found = tokenfile.lookup(spark, path, [-40, 20, 5000])
    assert sorted((r["doc_id"], list(r["ids"])) for r in found.collect()) == [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows if d in (-40, 20)]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_specials_in_all_forms(spark, library, tmp_path):
    """Special tokens are matched as they are written; letters with marks are joined before they are lowered."""
    rnd, signs = random.Random(4), ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|Endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", " ", "a", "Z", "H\u0331", "T\u0308", "é", ".", "'S", "!"]
    texts = ["<|ENDOFTEXT|>", "<|Endoftext|>", "x<|ENDOFTEXT|>y", "H\u0331 W\u030a J\u030c"] + ["".join(rnd.choices(signs, k=8)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(tuple(r) for r in tokenfile.positions(spark, path).collect()) == plain_positions(library, list(enumerate(texts)))


def test_marks_beside_words(monkeypatch):
    """Letters and marks are parted before the lookup, words forgotten and texts cut at any place: ids stay the library's."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bits = ["a", "the", "É", "ñ", "ß", "×", "÷", "23", "½", "'s", "'", "'LL", *"!\"#$%&()*+,-./:;=?@[\\]^_`{}~<|>", "###", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "\u0301", "\u0338", "\x1c", "\x85", "\u00a0", "你", "K", "İ", "ﬁ", "😀", "\x00"]
    draw = random.Random(7)
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(15))) for _ in range(20_000)]
    texts += [w + m for w in ("word", "w1", "é", "×", "x÷") for c in map(chr, range(33, 127)) for m in (c, c * 3, c + "'s", "'" + c, c + "word")]
    monkeypatch.setattr(tokenfile, "LOOKUP", 5000)
    monkeypatch.setattr(tokenfile, "MEMO", 1000)
    stretches = common.stretches
    monkeypatch.setattr(common, "stretches", lambda data: stretches(data, 7))
    values, sizes = tokenfile._encoded(tokenfile._Words(library), [t.encode() or None for t in texts], 1)
    ends = [0, *sizes.cumsum().tolist()]
    assert [values[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*e.ids, 1] for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("ids", ["none", "hot", "both", "copies"])
def test_many_rows_of_one_id(spark, library, tmp_path, ids):
    """No task gets all rows of an id, or of none, and the files hold the ids in ascending order of ids."""
    id_of = {"none": lambda k: None, "hot": lambda k: 7 if k % 3 else k, "both": lambda k: None if k % 3 == 0 else 7 if k % 3 == 1 else k, "copies": lambda k: 5}[ids]
    rows = [(id_of(k), "same" if ids == "copies" else f"text {k * 7919 % 1000}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), shard=20)
    read = tokenfile.read(spark, path)
    assert max(r["count"] for r in read.groupBy("shard").count().collect()) <= 90
    assert read.select("shard").distinct().count() >= 8
    found = sorted((tuple(r) for r in tokenfile.positions(spark, path).collect()), key=lambda r: r[1])
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert found == sorted(found, key=key)  # starts ascend with ids
    starts = [r[1] for r in found]
    assert starts == [sum(r[2] for r in found[:k]) for k in range(len(found))]
    content = lambda rows: sorted((r[0] or -1, *r[2:]) for r in rows)
    assert content(found) == content(plain_positions(library, rows))


def test_ids_beside_nulls(spark, tmp_path):
    """Ids beyond 2**53 in one batch with a null id stay as they are, in all operators that work on texts."""
    from webquarry.llm import bpe, simhash, substring

    ids = [2**60 + 1, None, 2**53 + 1, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "some words of a text") for i in ids], "doc_id long, text string").coalesce(1)
    vocabulary = bpe.Vocabulary({bytes([b]): b for b in range(256)})
    tokenfile.write(docs, str(tmp_path / "ids"), public_tokenizers.path("word_bpe_49k.json"))
    for found in (licenses.scan(docs), bpe.digest(docs, vocabulary, "."), bpe.encode(docs, vocabulary, "."), simhash.near_duplicates(docs), substring.digest(docs), tokenfile.positions(spark, str(tmp_path / "ids"))):
        assert {r["doc_id"] for r in found.collect()} == set(ids)


def test_empty_file_and_repeated_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write(empty, str(tmp_path / "a"), public_tokenizers.path("word_bpe_49k.json"))
    assert tokenfile.positions(spark, str(tmp_path / "a")).count() == 0
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b c"), (0, "d")], "doc_id long, text string")
    tokenfile.write(docs, str(tmp_path / "b"), public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(tuple(r)[:3] for r in tokenfile.positions(spark, str(tmp_path / "b")).collect()) == [(0, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 3)]


def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, model, F.col("source"), F.col("lang")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] is not None and r[labels.columns[1]] is not None]
    right = sum(r["kept"] == (r[-2] == 1) for r in got)
    assert len(good) == len(got) > 100 and right >= 0.97 * len(got)
    full = registry.QUERIES["op9_quality"](spark, "/root/testdata/sf0.01")
    assert full.count() == docs.count() and full.select("doc_id").distinct().count() == docs.count()


def plain_posteriors(rows):
    """Mean, strengths and evidence by host and by (host, path) of rows (host, path, evidence)."""
    by = lambda keys: {k: [r[2] for r in rows if keys(r) == k] for k in {keys(r) for r in rows}}
    hosts, paths = by(lambda r: r[0]), by(lambda r: r[:2])
    total = len(rows)
    mean = sum(r[2] for r in rows) / total

    def strength(sites, parent, parents):
        spread = sum(len(v) * (sum(v) / len(v) - parent(k)) ** 2 for k, v in sites.items())
        free, inside = len(sites) - parents, mean * (1 - mean)
        room = total - sum(len(v) ** 2 for v in sites.values()) / total - free
        share = min(max((spread - free * inside) / (inside * room), 1e-6), 1 - 1e-6)
        return 1 / share - 1

    k0 = strength(hosts, lambda k: mean, 1)
    k1 = strength(paths, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]), len(hosts))
    return mean, k0, k1, hosts, paths


def test_posteriors_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(["x", "y", None]), rnd.random() ** (3 if k % 3 else 1)) for k in range(300)] + [("rare", "x", 0.01)]
    got = {(r["host"], r["path"]): (r["host_posterior"], r["path_posterior"]) for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    mean, k0, k1, hosts, paths = plain_posteriors(rows)
    for (h, p), v in paths.items():
        host = (k0 * mean + sum(hosts[h])) / (k0 + len(hosts[h]))
        assert got[h, p] == pytest.approx((host, (k1 * host + sum(v)) / (k1 + len(v))))


def test_judgement_against_brute_force(spark):
    """Each row by the others of its site: the only one of a path, or of a host, goes by what is above it."""
    rnd = random.Random(9)
    words = ["word", "Text", "of", "a", "12", "%$", "line.\n"]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 40))), rnd.choice(["a", "a", "b", None]), rnd.choice(["x", "y", None])) for k in range(200)]
    docs += [(200, "alone here.", "rare", "x"), (201, None, "a", "once")]
    x = np.array([quality.features(d[1]) for d in docs])
    model = quality.Regression(x, (x[:, 0] + np.arange(len(x)) % 3 > 3).astype(float))
    evidence = model.predict(x).tolist()
    mean, k0, k1, hosts, paths = plain_posteriors([(d[2], d[3], e) for d, e in zip(docs, evidence)])
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality.judge(table, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(docs)
    odds = lambda p: math.log(p / (1 - p))
    for (k, _, h, p), e in zip(docs, evidence):
        host = (k0 * mean + sum(hosts[h]) - e) / (k0 + len(hosts[h]) - 1)
        path = (k1 * host + sum(paths[h, p]) - e) / (k1 + len(paths[h, p]) - 1)
        want = 1 / (1 + math.exp(-odds(e) - odds(path) + odds(mean)))
        assert tuple(got[k])[1:5] == pytest.approx((e, host, path, want), rel=1e-6) and got[k]["kept"] == (got[k]["quality"] >= quality.KEEP)
    assert got[200]["host_posterior"] == pytest.approx(mean)


def test_quality_of_odd_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, "a", "x", 1), (2, "", None, None, 1), (None, "Some text. " * 100, "a", "x", 1), (2, "", None, None, 1)], "doc_id long, text string, source string, lang string, evidence int")
    none = quality.judge(docs, None, F.col("source"), F.col("lang")).collect()
    assert len(none) == 4 and all(r["quality"] == pytest.approx(0.5) for r in none)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.judge(docs.limit(0), None, F.col("source"), F.col("lang")).count() == 0
    monkeypatch.setattr(quality, "SMALL", 0)
    assert len(quality.judge(docs, None, F.col("source"), F.col("lang")).collect()) == 4
    assert len(quality.features(None)) == len(quality.FEATURES) == len(quality.features("a\n" * 1000))
