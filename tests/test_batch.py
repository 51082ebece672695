"""Names, merges, summaries, vocabulary counts, sinks, streams and frames."""

import json
import re
import random
import time

import pytest
from pyspark.sql import functions as F

from webquarry.operators import batch as B
from webquarry.operators.budget import token_count_vocab
from webquarry.operators.frames import page_frames
from webquarry.operators.metadata import metadata_table
from webquarry.operators.tokens import size_report
from webquarry.options import Options
from webquarry.plans.article import article_table
from webquarry.plans.convert import convert
from webquarry.plans.full_page import full_page_markdown
from webquarry.sources import sinks
from webquarry.sources.pages import read_html_files, read_vocab, vocab_table
from webquarry.streaming.convert import convert_stream, newest, read_page_stream


def names_one_by_one(titles):
    used, out, tried = set(), [], {}
    for t in titles:
        # numbers that were taken once stay so
        name, n = t, tried.get(t, 1)
        while name in used:
            name, n = f"{t}_{n}", n + 1
        used.add(name)
        tried[t] = max(1, n - 1)
        out.append(name + ".md")
    return out


def test_unique_names(spark):
    titles = ["p_1", "p_3", "p", "p", "p", "q", "q", "q_1", "q_1", "q_1_1", "x", "x", "x", "y_1", "y", "y", "y", "z", "z", "z_1", "w", "w_2", "w", "w", "w"]
    df = spark.createDataFrame(list(enumerate(titles)), "page_id bigint, title string")
    got = [r.file_name for r in B.unique_names(df).orderBy("page_id").collect()]
    assert got == names_one_by_one(titles)


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_of_clashing_titles(spark, seed):
    rnd = random.Random(seed)
    titles = [rnd.choice("qp") + "".join(f"_{rnd.choice([1, 1, 1, 2, 3, 7])}" for _ in range(rnd.randint(0, 3))) for _ in range(60)]
    titles = ["q", "q", "q_1", "q_1_1"] + titles if seed == 0 else titles
    at = sorted(rnd.randrange(-(2**62), 2**62) for _ in titles)  # hashed ids
    df = spark.createDataFrame(list(zip(at, titles)), "page_id bigint, title string").repartition(3)
    got = [r.file_name for r in B.unique_names(df).orderBy("page_id").collect()]
    assert got == names_one_by_one(titles)


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_in_chains(spark, seed, monkeypatch):
    """Rivals that hang on each other, settled by bounds or, without rounds of them, one by one."""
    monkeypatch.setattr(B, "ROUNDS", seed)
    rnd = random.Random(seed)
    titles = [t for k in range(1, 40) for t in rnd.sample(["p", f"p_{k}", f"p_{k + rnd.randint(0, 9)}"], rnd.randint(1, 3))] + ["p"] * 30
    df = spark.createDataFrame(list(enumerate(titles)), "page_id bigint, title string").repartition(3)
    got = [r.file_name for r in B.unique_names(df).orderBy("page_id").collect()]
    assert got == names_one_by_one(titles)


def test_unique_names_of_one_hot_stem(spark):
    """80,000 titles with a number beside as many plain ones: no task holds a stem's rivals."""
    n = 80_000
    df = spark.range(2 * n).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "Page").otherwise(
        F.concat(F.lit("Page_"), (F.col("id") + 1) / 2).cast("string")).alias("title"))
    df = df.withColumn("title", F.regexp_replace("title", r"\.0$", ""))
    started = time.time()
    got = [r.file_name for r in B.unique_names(df).orderBy("page_id").select("file_name").collect()]
    assert time.time() - started < 120
    assert got == names_one_by_one([r.title for r in df.orderBy("page_id").collect()])


def test_names_of_rows_with_one_page_id(spark):
    rows = [(1, 1, "t"), (1, 2, "t"), (None, 3, "t"), (None, 4, "u")]
    df = spark.createDataFrame(rows, "page_id bigint, page_key bigint, title string")
    got = {r.page_key: r.file_name for r in B.unique_names(df, order=["page_id", "page_key"]).collect()}
    assert got == {3: "t.md", 4: "u.md", 1: "t_1.md", 2: "t_2.md"}


def test_ranked_hot_key(spark):
    random.seed(1)
    rows = [(i, "hot" if random.random() < 0.5 else f"k{random.randrange(9)}") for i in range(500)]
    df = spark.createDataFrame(rows, "page_id bigint, k string")
    got = {r.page_id: r["rank"] for r in B.ranked(df, "k", "page_id").collect()}
    seen = {}
    for i, k in rows:
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_merge_and_summary(spark):
    rows = [(1, "g", True, "a", 3), (2, "g", True, "b", 4), (3, "g", False, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, g string, success boolean, markdown string, token_count bigint")
    assert [r.markdown for r in B.merge_markdown(df, "g", "page_id").collect()] == ["a\n\n---\n\nb"]
    parts = B.merge_markdown(df, "g", "page_id", per_part=2).orderBy("part").collect()
    assert "\n\n---\n\n".join(r.markdown for r in parts) == "a\n\n---\n\nb"
    s = B.results_summary(df).first()
    assert (s.message, s.total_tokens, s.error) == ("2 tabs (1 failed)", 7, None)
    assert B.results_summary(df.filter("page_id = 1")).first().message == "1 tab"
    none = B.results_summary(df.filter("page_id = 3")).first()
    assert none.message == "0 tab (1 failed)" and none.error
    assert B.export_manifest(df, "2026-01-31").first().export_name == "export-2026-01-31-2tabs"


def count_by_hand(text, ranks):
    data, i, n = text.encode(), 0, 0
    while i < len(data):
        best, jump = -1, 1
        for size in range(1, min(32, len(data) - i) + 1):
            rank = ranks.get(",".join(str(b) for b in data[i:i + size]), -1)
            if rank > best:
                best, jump = rank, size
        n, i = n + 1, i + jump
    return n


def test_vocabulary(spark, tmp_path):
    ranks = {"104,105": 1, "104": 7, "97,98": 3, "97,98,99": 2, "195,188": 5, "98,99,32": 9}
    texts = ["hi", "", None, "abc abcab", "für bc hi", "zz", "h" * 40]
    path = tmp_path / "vocab.json"
    path.write_text("\n".join(
        f'{{"encoding": "e", "bytes": "{k}", "rank": {v}}}' for k, v in ranks.items()))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    vocab = read_vocab(spark, str(path))
    for largest in (0, 1 << 20):
        counted = token_count_vocab(df, vocab, "id", "text", "e", largest)
        assert {r.id: r.token_count for r in counted.collect()} == {i: count_by_hand(t or "", ranks) for i, t in enumerate(texts)}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    empty = vocab_table(spark.createDataFrame([], "encoding string, bytes string, rank bigint"))
    assert token_count_vocab(df.filter("id = 0"), empty, "id", "text", "e").first().token_count == 2


def test_vocabulary_of_long_words_and_texts(spark):
    long = "x" * 50
    raw = spark.createDataFrame([("e", ",".join(str(b) for b in long.encode()), 9), ("e", "120", 1)], "encoding string, bytes string, rank bigint")
    df = spark.createDataFrame([(1, long * 3 + "xx"), (2, ("ab " + long) * 700)], "id bigint, text string")
    for largest in (0, 1 << 20):
        got = {r.id: r.token_count for r in token_count_vocab(df, vocab_table(raw), "id", "text", "e", largest).collect()}
        assert got == {1: 5, 2: 4 * 700}


def test_selection_and_guard(spark):
    html = "<html><head><title>T</title></head><body><p>all</p></body></html>"
    pages = spark.createDataFrame([(i, "https://e.com/", html) for i in (1, 2, 3)],
                                  "page_id bigint, url string, html string")
    picks = spark.createDataFrame([(1, "<b>part</b>"), (2, " <p> </p>")], "page_id bigint, fragment_html string")
    got = {r.page_id: r for r in convert(pages, Options(scope="selection", metadata=False), picks).collect()}
    assert got[1].markdown == "# T\n\n**part**" and got[2].error_code == "NO_SELECTION"
    assert got[3].error_code == "NO_SELECTION" and not got[3].success and len(got) == 3
    assert [r.n_elements for r in size_report(pages, 3).collect()] == [5, 5, 5]
    assert [r.large for r in size_report(pages, 4).collect()] == [True] * 3
    ordered = convert(pages.withColumn("ord", F.col("page_id") * 10), Options(scope="fullPage")).collect()
    assert sorted((r.page_id, r.ord) for r in ordered) == [(1, 10), (2, 20), (3, 30)]


TEXT = "A paragraph, long enough to count as one, about nothing in particular. "


@pytest.fixture(scope="module")
def odd_ids(spark):
    def html(t):
        return f"<html><head><title>Page {t}</title></head><body><article><p>{t}: {TEXT * 9}</p></article></body></html>"

    rows = [(1, "https://e.com/a", html("A"), 10), (1, "https://e.com/b", html("B"), 11), (1, "https://e.com/b", html("B"), 11), (None, "https://e.com/c", html("C"), 12),
            (None, "https://e.com/c", html("D"), 13), (None, None, None, None), (2, "https://e.com/c", html("C"), 14)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, ord int").repartition(3)


@pytest.mark.parametrize("scope", ["fullPage", "mainContent"])
def test_pages_with_repeated_or_no_ids(odd_ids, scope):
    """Pages of one id, of none, and equal pages each give their own row."""
    got = convert(odd_ids, Options(scope=scope, metadata=False)).collect()
    want = [(1, 10, "A"), (1, 11, "B"), (1, 11, "B"), (0, 12, "C"), (0, 13, "D"), (0, 0, ""), (2, 14, "C")]
    assert sorted((r.page_id or 0, r.ord or 0, (r.title or "")[5:]) for r in got) == sorted(want)
    assert {r.markdown for r in got if r.success} == {f"# Page {t}\n\n{t}: {(TEXT * 9).strip()}" for t in "ABCD"}


def test_fragments_of_pages_with_repeated_ids(spark, odd_ids):
    picks = spark.createDataFrame([(1, "<b>part</b>")], "page_id bigint, fragment_html string")
    got = convert(odd_ids, Options(scope="selection", metadata=False), picks).collect()
    assert sorted((r.page_id or 0, r.markdown or "") for r in got) == [(0, "")] * 3 + [(1, "# Page A\n\n**part**")] + [(1, "# Page B\n\n**part**")] * 2 + [(2, "")]


def test_keyed_pages_need_one_exchange(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = full_page_markdown(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_empty_page_is_a_row(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", ""), (2, "https://e.com/", None)],
                                  "page_id bigint, url string, html string")
    got = convert(pages, Options(scope="fullPage")).collect()
    assert sorted(r.page_id for r in got) == [1, 2]
    assert all(not r.success and r.error_code == "GENERAL" for r in got)


def test_sinks_and_files(spark, tmp_path):
    rows = [(1, True, "T", "a\nb"), (2, True, "T", "c"), (3, False, "T", None)]
    df = spark.createDataFrame(rows, "page_id bigint, success boolean, title string, markdown string")
    manifest = sinks.write_export(df, str(tmp_path / "e"), "2026-01-31")
    assert manifest.first().n_files == 2
    files = {r.file_name: r.content for r in spark.read.parquet(str(tmp_path / "e/files")).collect()}
    assert files == {"T.md": "a\nb", "T_1.md": "c"}
    merged = B.merge_markdown(df.withColumn("g", F.lit("all")), "g", "page_id", per_part=1)
    sinks.write_merged(merged, str(tmp_path / "g"), "g")
    assert "".join(p.read_text() for p in sorted((tmp_path / "g/g=all").glob("part-*"))) == "a\nb\n\n---\n\nc\n"
    assert B.merge_markdown(df.filter("NOT success").withColumn("g", F.lit("x")), "g", "page_id").first().error
    (tmp_path / "h").mkdir()
    (tmp_path / "h/x.html").write_text("<p>x</p>")
    assert read_html_files(spark, str(tmp_path / "h")).first().html == "<p>x</p>"


def test_one_file_a_page(spark, tmp_path):
    titles = ["T", "T", "ä+b %41", "T_1", "x" * 300, None]
    rows = [(k, t is not None, t, f"text {k}\n") for k, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "page_id bigint, success boolean, title string, markdown string").repartition(3)
    path = tmp_path / "m"
    for _ in range(2):  # the second job takes the place of the first
        sinks.write_markdown_files(df, str(path))
        found = {p.name: p.read_text() for p in path.glob("part-*/*") if not p.name.endswith(".crc")}
        want = {"T.md": "text 0\n", "T_1.md": "text 1\n", "T_1_1.md": "text 3\n", "ä+b_%41.md": "text 2\n", "x" * 100 + ".md": "text 4\n"}
        assert found == want
        assert {r.file_name: r.content for r in sinks.read_markdown_files(spark, str(path)).collect()} == want
    listed = json.loads((path / "committed.json").read_text())
    assert sum(n for n, _ in listed.values()) == 5 and {p.name for p in path.glob("part-*")} == set(listed)


def test_failed_export_leaves_the_last_one(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "a"), ("b/c.md", "b")], "file_name string, content string")
    spark.dataSource.register(sinks.named_files())
    path = tmp_path / "f"
    df.limit(1).write.format(sinks.FILES).mode("overwrite").save(str(path))
    with pytest.raises(Exception):
        df.repartition(2).write.format(sinks.FILES).mode("overwrite").save(str(path))
    assert [p.name for p in path.glob("part-*/*")] == ["a.md"]
    assert {r.file_name: r.content for r in sinks.read_markdown_files(spark, str(path)).collect()} == {"a.md": "a"}


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.write.parquet(str(tmp_path / "in"))
    opt = Options(scope="fullPage")
    stream = read_page_stream(spark, str(tmp_path / "in"))
    convert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), opt).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = convert(pages, opt)
    assert got.count() == want.count()
    assert got.select("page_id", "markdown").exceptAll(want.select("page_id", "markdown")).count() == 0


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """The registered streams find the pages in a folder of part files as in one file."""
    from webquarry.plans import registry

    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(9).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    want = sorted(r.page_id for r in spark.read.parquet(str(tmp_path / "pages.parquet")).collect())
    for query in (registry.streamed_counts, registry.streamed_pages):
        assert sorted(r.page_id for r in query(spark, str(tmp_path)).select("page_id").collect()) == want


def test_later_versions_of_streamed_pages(spark, tmp_path):
    """Three starts of one stream and a batch that runs twice: the same as the last versions in one batch."""
    opt = Options(scope="fullPage")
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def page(i, word):
        text = " ".join(f"{word} {n}, some more words of the article." for n in range(30))
        return i, f"https://e.com/{i}", f"<html><head><title>{word}</title></head><body><p>{text}</p><p>{text}</p></body></html>"

    def arrive(rows):
        spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(source)
        convert_stream(read_page_stream(spark, source), out, state, opt).awaitTermination()

    first = [page(1, "one"), page(2, "two"), page(None, "nameless")]
    second = [page(2, "newer"), page(3, "three"), page(3, "third"), page(None, "nameless")]
    arrive(first)
    arrive(second)
    # lost after its results were written, before it was noted as done
    (tmp_path / "state" / "commits" / "1").unlink()
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    arrive([page(1, "last")])
    want = convert(spark.createDataFrame([first[2], *second, page(1, "last")], "page_id bigint, url string, html string"), opt)
    columns = ["page_id", "url", "title", "success", "markdown", "token_count"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    got = newest(spark, out)
    assert rows(got) == rows(want)
    assert sorted(r.title for r in got.collect()) == ["last", "nameless", "nameless", "newer", "third", "three"]


def test_newest_rows_of_one_key(spark, tmp_path):
    """All rows of a key's last batch stay, failures too; rows without a key always; ties are no repeats."""
    rows = [(0, 1, "a"), (0, 1, "a"), (1, 1, "b"), (1, 1, "b"), (2, 2, None), (0, 2, "x"), (0, None, "n"), (2, None, "n"), (0, 3, "only"), (1, 4, "p"), (2, 4, "q"), (0, 4, "o")]
    spark.createDataFrame(rows, "batch int, page_id bigint, markdown string").write.partitionBy("batch").parquet(str(tmp_path / "r"))
    got = newest(spark, str(tmp_path / "r"))
    assert sorted(map(str, map(tuple, got.select("page_id", "markdown").collect()))) == sorted(map(str, [(1, "b"), (1, "b"), (2, None), (None, "n"), (None, "n"), (3, "only"), (4, "q")]))
    spark.createDataFrame([], "page_id bigint, markdown string").write.parquet(str(tmp_path / "e" / "batch=0"))
    spark.createDataFrame([], "page_id bigint, markdown string").write.parquet(str(tmp_path / "e" / "batch=1"))
    assert newest(spark, str(tmp_path / "e")).count() == 0


def test_metadata_cases(spark):
    cases = {
        '<title>A page with many words | Site</title>': ("A page with many words", None),
        '<title>Short | Site name here</title>': ("Short | Site name here", None),
        '<title>x</title><meta property="article:author" content="https://a.b/c">': ("x", None),
        '<title>x</title><meta property="article:author" content="Jo">': ("x", "Jo"),
        '<title>x</title><script type="application/ld+json">{"@context":"https://schema.org","@type":"WebSite",'
        '"name":"n"}</script>': ("x", None),
        '<title>x</title><script type="application/ld+json">[{"@type":"Thing"},{"@context":"http://schema.org",'
        '"@type":"BlogPosting","name":" n ","author":{"name":" me "}}]</script>': ("n", "me"),
    }
    rows = [(i, "https://e.com/", f"<html><head>{h}</head><body><p>y</p></body></html>") for i, h in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(r.title, r.byline) for r in metadata_table(df).orderBy("page_id").collect()]
    assert got == list(cases.values())


def test_frames_at_the_end_of_an_article(spark):
    text = "A paragraph, long enough to count as one, about nothing in particular. " * 9
    doc = f"<html><head><title>Page of frames</title></head><body><article><p>{text}</p></article>"
    doc += '<iframe src="/in"></iframe><iframe src="https://far.org/x"></iframe></body></html>'
    inner = "<html><body><p>" + "inside the frame " * 6 + "</p></body></html>"
    pages = spark.createDataFrame([(1, "https://e.com/a", doc), (2, "https://e.com/in", inner)],
                                  "page_id bigint, url string, html string")
    got = {r.page_id: r.markdown for r in convert(pages, Options(metadata=False)).collect()}
    end = "\n\n---\n\n### Embedded Content 1\n\n" + ("inside the frame " * 6).strip()
    assert got[1].startswith("# Page of frames\n\n" + text.strip() + end + "\n\n---\n> **Note:** This page contains 1 ")


def test_reopened_inline(spark):
    html = "<html><body><p><b>x<br><p>y <i>z</i><ul><li>w</ul><div><b>v</div><p>u</body></html>"
    pages = spark.createDataFrame([(1, "https://e.com/", html)], "page_id bigint, url string, html string")
    opt = Options(scope="fullPage", title=False, metadata=False, reopen_inline=True)
    got = convert(pages, opt).first().markdown
    assert got == "**x  \n**\n\n**y *z***\n\n-   **w**\n\n****v****\n\n****u****"


def test_article_record(spark):
    text = "<p>A paragraph, long enough to count as one, about nothing in particular.</p>"
    long = ("<html lang='de'><head><title>A long title for one page</title></head><body><div dir='rtl'><span rel='author'>"
            f"<i itemprop='name'>Jo Doe</i> writes</span>{text * 8}</div><div class='footer-links'>Down, there.</div></body></html>")
    # too short at first, and its only text is in an unlikely element
    short = f"<html><head><title>Another title for one page</title></head><body><div id='sidebar'>{text}</div></body></html>"
    pages = spark.createDataFrame([(1, "https://e.com/a", long), (2, "https://e.com/b", short)],
                                  "page_id bigint, url string, html string")
    got = {r.page_id: r for r in article_table(pages).collect()}
    a, b = got[1], got[2]
    line = "A paragraph, long enough to count as one, about nothing in particular."
    assert (a.title, a.byline, a.dir, a.lang, a.attempt) == ("A long title for one page", "Jo Doe", "rtl", "de", 1)
    assert a.excerpt == line and a.text_content == line * 8 and a.length == len(line) * 8
    assert (b.attempt, b.text_content, b.lang) == (2, line, None)


def article_text(spark, *bodies):
    """Text of the article of each page."""
    pages = spark.createDataFrame([(i, "https://e.com/", f"<html><head><title>A title for this page</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)],
                                  "page_id bigint, url string, html string")
    return [r.text_content for r in article_table(pages).orderBy("page_id").collect()]


def test_tests_of_near_ancestors(spark):
    """Unlikely names stay in a table or code that is open and one of the four nearest ancestors; figures and code count as near ones too."""
    long = f"<p>{TEXT * 9}</p>"
    note = "<div class='sidebar'><p>A note beside it, long enough.</p></div>"
    inner = "<table><tr><td>x, y</td></tr></table>"
    cell = lambda inside: f"<div>{long}<table summary='data'><tr><td>{inside}</td></tr></table></div>"
    kept, closed, deep, code, far_code = article_text(
        spark, cell(note), cell(f"{inner}{note}"), cell(f"<div><div><div><p>z</p>{note}</div></div></div>"),
        f"<div>{long}<code><span>{note}</span></code></div>", f"<div>{long}<code><i><b><u><em>{note}</em></u></b></i></code></div>")
    assert "A note beside it" in kept  # two levels below the table
    assert "A note beside it" in closed  # the table opened last is closed, the outer one is near
    assert "A note beside it" not in deep  # more than four levels below it
    assert "A note beside it" in code and "A note beside it" not in far_code


def test_full_stops_across_runs(spark):
    """A short paragraph beside the article stays if it has a full stop before white space or at its end."""
    main = f"<div><p>{TEXT * 4}</p><p>{TEXT * 4}</p></div>"
    texts = article_text(spark, *[f"<section>{main}<p>{p}</p></section>" for p in (
        "version 2.<b>0</b> of it", "it ends.<b> Here</b> it goes on", "it ends <b>here.</b>", "no stop at all")])
    assert ["version 2.0" in texts[0], "it ends" in texts[1], "it ends" in texts[2], "no stop" in texts[3]] == [False, True, True, False]


def test_addresses_of_media(spark):
    """Sources, posters and source sets of an article's media are absolute in what is kept as HTML."""
    media = """<video class="v" poster='/p$1.jpg?a=1&amp;b="2' src=v.mp4 data-src="w.mp4"><source srcset="a.png 1x, /b.png 2x"></video>"""
    html = f"<html><head><title>A title for this page</title></head><body><div><p>{TEXT * 9}</p><p>{TEXT}{media}</p></div></body></html>"
    pages = spark.createDataFrame([(1, "https://e.com/d/x", html)], "page_id bigint, url string, html string")
    got = convert(pages, Options(metadata=False, title=False, keep=("video",))).first().markdown
    assert 'poster="https://e.com/p$1.jpg?a=1&amp;b=%222"' in got or 'poster="https://e.com/p$1.jpg?a=1&amp;b=&quot;2"' in got
    assert ' src="https://e.com/d/v.mp4"' in got and 'data-src="w.mp4"' in got
    assert 'srcset="https://e.com/d/a.png 1x, https://e.com/b.png 2x"' in got


NESTED = f"<p>{TEXT * 9}</p><p>{TEXT}</p>"
DEEP = 300
TINY = "data:image/gif;base64,R0lGODlhAQABAAAAACw="
#: bodies and the containers that are left of them
CONTAINERS = {
    f"<div id='a' lang='de'> <div id='b' data-x='1 &amp; 2'>\n<section id='c' lang='fr' data-y=3>{NESTED}</section></div> </div>":
        '<section id="a" lang="de" data-x="1 &amp; 2" data-y="3"></section>',
    f"<div id='a'><section id='b'>{NESTED}<section id='c'> <br> </section><div id='d'><div id='e'></div></div></section></div>": '<section id="a"></section>',
    f"<div id='a'><section id='b'>words <section id='c'>{NESTED}</section></section></div>": '<section id="a"></section>',
    f"<div id='a'><section id='b'>words<section id='c'>{NESTED}</section></section></div>": '<section id="a"><section id=\'c\'></section></section>',
    f"<div id='a'>{NESTED}<div id='b'><div id='c'>{NESTED}</div><div id='d'>{NESTED}</div></div></div>":
        "<div id='a'><div id='b'><div id='c'></div><div id='d'></div></div></div>",
    "".join(f"<div id='{k}' data-{k}='{k}'>" for k in range(DEEP)) + NESTED + "</div>" * DEEP:
        '<div id="0"' + "".join(f' data-{k}="{k}"' for k in range(DEEP)) + "></div>",
}
#: bodies and the images and figures that are left of them
IMAGES = {
    "<img data-src='a.jpg'>": '<img src="https://e.com/d/a.jpg" data-src=\'a.jpg\'>',
    "<img data-a='a.jpg' data-b='/b.png'>": '<img src="https://e.com/b.png" data-a=\'a.jpg\' data-b=\'/b.png\'>',
    "<img src='x.gif' data-src='a.jpg'>": '<img src="https://e.com/d/x.gif" data-src=\'a.jpg\'>',
    "<img class='Lazy' src='x.gif' data-src='a.jpg'>": '<img src="https://e.com/d/a.jpg" data-src=\'a.jpg\'>',
    "<img data-set='a.jpg 1x, b.jpg 2x'>": '<img srcset="https://e.com/d/a.jpg 1x, https://e.com/d/b.jpg 2x" data-set=\'a.jpg 1x, b.jpg 2x\'>',
    f"<img src='{TINY}' data-src='a.jpg'>": '<img src="https://e.com/d/a.jpg" data-src=\'a.jpg\'>',
    "<img data-x=1>": "",
    "<figure data-src='a.jpg' data-b='b.jpg'><figcaption>c</figcaption></figure>": "<figure data-src='a.jpg' data-b='b.jpg'><img src=\"https://e.com/d/a.jpg\"></figure>",
    "<figure data-set='a.jpg 1x'><i>c</i></figure>": "<figure data-set='a.jpg 1x'><img srcset=\"https://e.com/d/a.jpg 1x\"></figure>",
    "<figure data-src='a.jpg'><img src='b.jpg'></figure>": "<figure data-src='a.jpg'><img src=\"https://e.com/d/b.jpg\"></figure>",
    "<img src='s.jpg' alt=''><noscript><img src='l.jpg'></noscript>": '<img src="https://e.com/d/l.jpg" data-old-src="s.jpg">',
    "<img src='s.jpg' data-x='t.png' width=1><noscript><img src='s.jpg' /></noscript>": '<img src="https://e.com/d/s.jpg" data-x="t.png">',
    "<img alt='no source'><noscript><img src='l.jpg'></noscript>": "",
    "<p><img src='s.jpg'></p> <noscript><img srcset='l.jpg 2x'></noscript>": '<img srcset="https://e.com/d/l.jpg 2x" src="https://e.com/d/s.jpg">',
}


def test_nested_containers_and_lazy_images(spark):
    """A container around nothing but a container becomes it, the outermost attributes first, in a chain of any depth; containers without content go.

    Images take what their other attributes name, figures without one get it, and a noscript image takes over the old one's addresses."""
    bodies = [*CONTAINERS, *[f"<div><p>{TEXT * 9}</p><p>{TEXT}</p>{c}<p>{TEXT * 9}</p></div>" for c in IMAGES]]
    pages = spark.createDataFrame([(i, "https://e.com/d/x", f"<html><head><title>A title for this page</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)],
                                  "page_id bigint, url string, html string")
    opt = Options(metadata=False, title=False, keep=("div", "section", "img", "figure"))
    rows = convert(pages, opt).select("page_id", "markdown").collect()
    tags = ["".join(re.findall(r"<[^>]*>", m)) for _, m in sorted(map(tuple, rows))]
    wanted = [*CONTAINERS.values(), *IMAGES.values()]
    assert all(t.count("<p>") == t.count("</p>") for t in tags)
    for k, t in enumerate(tags):
        others = "p" if k < len(CONTAINERS) else "p|i|div|figcaption"
        tags[k] = re.sub(r"\s+", " ", re.sub(r"\s*/?>", ">", re.sub(rf"</?({others})>", "", t)))
    bad = [(b[-200:], t, w) for b, t, w in zip(bodies, tags, wanted) if t != w]
    assert not bad, bad


def test_addresses_of_frames_follow_the_base(spark):
    """The first base outside of comments counts, itself resolved against the page; without one the page's address does."""
    frames = "<iframe src='in?a=1&amp;b=2'></iframe><iframe src='https://far.org/x'></iframe>"
    heads = ["<base target='t'>", "<!-- <base href='/no/'> --><base href='/sub/dir/'>", "<base href=\"https://other.org/a&amp;b/\">"]
    pages = spark.createDataFrame([(i, "https://e.com/d/x", f"<html><head>{h}</head><body>{frames}</body></html>") for i, h in enumerate(heads)], "page_id bigint, url string, html string")
    got = [[r.src for r in sorted(page_frames(pages).where(F.col("page_id") == i).collect(), key=lambda r: r.frame)] for i in range(3)]
    assert got == [[f"{b}in?a=1&b=2", "https://far.org/x"] for b in ("https://e.com/d/", "https://e.com/sub/dir/", "https://other.org/a&b/")]


def test_partitions_follow_the_size_of_the_html(spark, monkeypatch):
    """A large table is dealt out by its bytes, whatever adaptive execution would put together, with the same results."""
    from webquarry.operators import tokens as T

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    small = full_page_markdown(pages)
    want = sorted(map(str, small.collect()))
    size = sum(len(r.html.encode()) for r in pages.collect())
    monkeypatch.setattr(T, "TASK_BYTES", size // 20)
    assert T.spread(pages).rdd.getNumPartitions() >= 20
    assert T.keyed(pages).rdd.getNumPartitions() >= 20
    assert sorted(map(str, full_page_markdown(pages).collect())) == want


def test_article_steps_are_written_in_between(spark, monkeypatch):
    """No plan of the article holds so many windows that tasks compile them again and again and hold a sort for each."""
    from webquarry.operators import article as A
    from webquarry.operators.lineage import cut
    from webquarry.operators.tokens import keyed
    from webquarry.plans import article as P

    seen = []

    def counted(df, by=None):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Window ["))
        return cut(df, by)

    monkeypatch.setattr(A, "cut", counted, raising=False)
    monkeypatch.setattr(P, "cut", counted)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(5)
    assert P.article_stream(keyed(pages)).select("page_id").distinct().count() == 5
    assert 0 < max(seen) <= 24


def test_article_steps_run_in_small_methods(spark, monkeypatch):
    """Plans of many windows are not compiled as a whole, into methods too large for the JVM's compiler; the session's setting stays as it was."""
    from pyspark.sql.classic.dataframe import DataFrame

    from webquarry.operators.lineage import WHOLE_STAGE
    from webquarry.operators.tokens import keyed
    from webquarry.plans import article as P

    seen, windows, checkpoint = [], [], DataFrame.checkpoint

    def watched(self, *given):
        seen.append(spark.conf.get(WHOLE_STAGE))
        windows.append(self._jdf.queryExecution().optimizedPlan().toString().count("Window ["))
        return checkpoint(self, *given)

    monkeypatch.setattr(DataFrame, "checkpoint", watched)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(5)
    assert P.article_stream(keyed(pages)).select("page_id").distinct().count() == 5
    assert seen and set(seen) == {"false"} and 0 < max(windows) <= 24
    assert spark.conf.get(WHOLE_STAGE, None) is None
