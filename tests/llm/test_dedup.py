"""SimHash groups and repeated passages against brute force on small tables."""

import hashlib
import random
import re

import pytest
import xxhash

from webquarry.llm import common, registry, simhash, substring

WORD = re.compile(common.WORD)


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    root = {i: i for i in ids}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_cut(rows, width=50):
    words = {d: WORD.findall(t or "") for d, t in rows}
    least = {}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def passages():
    rnd = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared, line = say(70), say(12)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, say(49)), (5, say(50))]
    rows += [(10 + i, f"{say(rnd.randint(0, 60))}\n{shared}  {say(rnd.randint(0, 60))}") for i in range(12)]
    rows += [(30 + i, f"{say(60)} {line} {say(60)}") for i in range(12)]
    rows += [(50, rows[5][1]), (51, rows[5][1] + " more"), (52, "same " * 120), (53, "same " * 80), (54, rows[5][1].lower())]
    base = say(400)
    rows += [(60 + i, base) for i in range(4)]
    rows += [(70 + i, base.replace(vocabulary[i], "x")) for i in range(10)]
    return rows


@pytest.mark.parametrize("text", [None, "", "  ", "One", "One two", "one TWO three", "É Ä b c d e", "a " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(20000))
    whole = simhash.fingerprint(text)
    chunks = common.word_chunks
    monkeypatch.setattr(common, "word_chunks", lambda data: chunks(data, 1000))
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_components_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    ids = sorted(fps)
    want = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = registry.QUERIES["op7_simhash"](spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(got) == len(ids)


@pytest.mark.parametrize("cell", [8, 2048])
def test_links_lose_no_close_pair(spark, cell):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for s in seeds[:20]:
        for _ in range(rnd.randint(1, 40)):
            x = s
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r[0] & (1 << 64) - 1: r[1] & (1 << 64) - 1 for r in common.components(simhash.links(df, cell=cell)).collect()}
    want = groups(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3])
    members = lambda g: sorted(sorted(v) for v in _by(g).values())
    assert members({f: got.get(f, f) for f in fps}) == members(want)


def _by(group):
    out = {}
    for k, v in group.items():
        out.setdefault(v, []).append(k)
    return out


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 5), (2000, 2001), (2001, 2001), (2001, 2000), (None, 3)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 0, 2000: 2000, 2001: 2000}


def test_one_document_of_each_group_stays(spark):
    long = "The quick brown fox jumps over the lazy dog and runs along the river " * 30
    rows = [(1, long, "a", 1), (2, long, None, 2), (3, "", "a", 3), (4, None, "b", 4), (5, "other words here", "b", 5), (6, long.upper(), "b", 6), (5, "other words here", "b", 5), (None, "no id at all", "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["component_id"]) for r in kept.collect()) == [1, 3, 5, 7]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_a_group_stays_without_or_with_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(4000))
    other = " ".join(f"o{i}" for i in range(50))
    away = lambda t: (plain_fingerprint(t) ^ plain_fingerprint(base)).bit_count()
    texts = [base, *[t for t in (f"{base} end{i}" for i in range(100)) if 1 <= away(t) <= 3][:2]]
    assert len(texts) == 3
    big = (1 << 60) + 1
    cases = [
        ([(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, other), (None, other)], [None, None]),
        ([(3, texts[0]), (None, texts[1]), (None, texts[2]), (None, other)], [3, None]),
        ([(3, texts[0]), (5, texts[1]), (5, other)], [3, 5]),
        ([(5, texts[0]), (5, texts[1]), (5, texts[0])], [5]),
        ([(big, texts[0]), (None, texts[1])], [big]),
    ]
    for rows, want in cases:
        kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r["doc_id"] for r in kept), key=lambda d: (d is None, d)) == want
        assert sum(r["text"] in texts for r in kept) == 1


@pytest.mark.parametrize("hot_rows", [2, substring.HOT_ROWS])
def test_repeated_passages(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(substring.repeated_spans, "__defaults__", ("doc_id", "text", 50, hot_rows))
    rows = passages()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, spans int, first string").repartition(5)
    got = substring.digest(docs).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_cut(rows)
    assert len(got) == len(rows)


def test_repeated_passages_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op10_substring"](spark, "/root/testdata/sf0.001").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_cut(rows)


def test_texts_lose_just_the_repeated_words(spark):
    rows = passages()
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    cut = substring.cut_repeats(docs)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    want = plain_cut(rows)
    for d, t in rows:
        kept = WORD.findall(got[d] or "")
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == want[d][2]
        assert want[d][1] or got[d] == t
    assert substring.cut_repeats(docs.limit(0)).count() == 0


def test_repeated_ids_and_rows(spark):
    rnd = random.Random(1)
    text = " ".join(str(rnd.random()) for _ in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text), (2, "x " + text), (None, text)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in substring.digest(docs).na.fill(-1, ["doc_id"]).collect())
    assert got == [(-1, 80, 0), (1, 80, 0), (1, 80, 0), (2, 80, 80), (2, 80, 80), (2, 81, 80)]


def test_cut_text():
    assert substring.cut_text(" a  b c\nd ", [(1, 3)]) == " a  d "
    assert substring.cut_text("a b c", [(0, 2), (1, 3)]) == ""
    assert substring.cut_text("a b c", []) == "a b c"
