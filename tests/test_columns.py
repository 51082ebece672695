"""Column functions against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from webquarry.functions import markup as M
from webquarry.functions import text as X
from webquarry.functions import urls as U
from webquarry.operators import article as A
from webquarry.operators import tokens as T


def values(spark, cases, fn, columns=("c",)):
    """Results of ``fn`` over rows of arguments, in order."""
    rows = [(i, *((c,) if not isinstance(c, tuple) else c)) for i, c in enumerate(cases)]
    schema = "i int, " + ", ".join(f"{c} {t}" for c, t in (
        (c, "string") if isinstance(c, str) else c for c in columns))
    names = [c if isinstance(c, str) else c[0] for c in columns]
    df = spark.createDataFrame(rows, schema)
    out = df.select("i", fn(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()
    return [r.v for r in out]


CASES = {
    "entities": (X.decode_entities, [
        ("&amp;lt;", "&lt;"), ("&#x41;", "A"), ("&#0;", "�"), ("&#xD800;", "�"),
        ("&#99999999999999;", "�"), ("&copy; &middot; &quot;&nope; & x", '© · "&nope; & x'),
        ("&#128512;", "😀"), (None, None)]),
    "metadata references": (X.unescape_metadata, [("&amp;#65;", "A"), ("&copy;", "&copy;"), ("a&lt;b", "a<b")]),
    "estimate": (X.token_estimate, [
        ("hello world", 3), ("", 0), (None, 0), ("a b c d e f g h", 6), ("abcd", 1), ("😀", 1)]),
    "heuristic": (X.token_heuristic, [("hi", 2), ("", 0), (None, 0), ("a   b", 4), ("don't", 3)]),
    "file name": (X.sanitize_filename, [
        ("A/B: C?", "AB_C"), (" ..x.. ", "x"), ("", "untitled"), ("a" * 120, "a" * 100),
        ("a" * 99 + " b", "a" * 99)]),
    "escape": (X.md_escape, [
        ("1. x_[y]*", r"1\. x\_\[y\]\*"), ("- a", r"\- a"), ("+ a", r"\+ a"), ("==", r"\=="),
        ("## a", r"\## a"), ("#a", "#a"), ("a\\b`", r"a\\b\`"), ("~~~x", r"\~~~x"), ("> q", r"\> q")]),
    "fence": (X.fence_size, [("a", 3), ("```\nx", 4), ("a ```` b", 3), ("x\n`````", 6)]),
    "inline code": (X.inline_code, [
        ("a", "`a`"), ("a`b", "``a`b``"), ("`a", "`` `a ``"), (" a ", "`  a  `"), ("a\nb", "`a b`"), ("", "")]),
    "post": (X.post_process, [
        ("a\n\n\n\nb", "a\n\nb"), ("a\n# h", "a\n\n\n# h"),
        ("\n- a\n- b\n- c", "\n- a\n\n- b\n- c")]),
    "limit": (lambda c: X.format_limit(c.cast("int")), [("8192", "8K"), ("128000", "128K"), ("1000000", "1.0M"), ("12", "12")]),
    "attribute text": (X.md_attr, [("a\n\n  b", "a\nb"), (None, "")]),
    "error": (X.classify_error, [
        ("No content could be extracted", "NO_CONTENT"), ("No text is selected", "NO_SELECTION"),
        ("Permission denied", "PERMISSION_DENIED"), ("other", "GENERAL"), (None, None)]),
    "http": (U.is_http_url, [("https://a.b", True), (" HTTP://x", True), ("ftp://x", False), (None, False)]),
    "url": (U.is_url, [("https://a.b/c", True), ("Jane Doe", False), ("mailto:x", True), ("http://", False)]),
    "batch url": (U.is_convertible_url, [("https://x", True), ("about:blank", False), ("moz-extension://x", False), (None, False)]),
    "host": (U.hostname, [("https://u@Ex.com:8080/p", "ex.com"), ("nope", "")]),
    "lazy host": (U.matched_host, [("chat.poe.com", "poe.com"), ("notpoe.com", None), ("poe.com", "poe.com")]),
    "attribute": (lambda c: M.own("class", c), [
        ('<a title="x class=y" class="z w">', "z w"), ("<a class=q>", "q"), ("<a CLASS='s'>", "s"), ("<a>", "")]),
}


@pytest.mark.parametrize("name", CASES)
def test_column(spark, name):
    fn, cases = CASES[name]
    assert values(spark, [c for c, _ in cases], fn) == [v for _, v in cases]


def test_resolve(spark):
    base = "https://ex.com/a/b.html?q=1"
    cases = {
        "https://Other.com:443": "https://other.com/", "/x/../y": "https://ex.com/y", "c": "https://ex.com/a/c",
        "../c": "https://ex.com/c", "#f": "https://ex.com/a/b.html?q=1#f", "?z": "https://ex.com/a/b.html?z",
        "//cdn.ex/p": "https://cdn.ex/p", "mailto:a@b": "mailto:a@b", "/für x": "https://ex.com/f%C3%BCr%20x",
        "/a%2Fb": "https://ex.com/a%2Fb", "./": "https://ex.com/a/", "": "https://ex.com/a/b.html?q=1",
        "../../../z": "https://ex.com/z",
    }
    got = values(spark, list(cases), lambda c: U.absolutize(c, F.lit(base)))
    assert dict(zip(cases, got)) == cases


def test_similarity(spark):
    cols = ("a", "b")
    got = values(spark, [("Hello World", "Hello there"), ("x", ""), ("a b", "b a")], X.text_similarity, cols)
    assert got == [pytest.approx(1 - 5 / 11), 0.0, 1.0]


def test_budget(spark):
    cases = [(2, 4), (5, 3), (749, 1000), (750, 1000), (900, 1000), (1000, 1000)]
    cols = (("c", "bigint"), ("l", "bigint"))
    report = values(spark, cases, X.limit_report, cols)
    assert [tuple(r) for r in report[:2]] == [(2, 4, 50.0, False, 2), (5, 3, 166.7, True, 0)]
    assert [r.status for r in values(spark, cases, X.budget_status, cols)[2:]] == ["ok", "note", "warn", "error"]
    assert values(spark, [(50, 100)], X.format_tokens, cols) == ["50 / 100 tokens (50%)"]
    assert values(spark, [(500,)], X.format_tokens, (("c", "bigint"),)) == ["500 tokens"]


def test_class_weight_and_scores(spark):
    got = values(spark, [("comment", "x"), ("article", "main"), ("sidebar", "content")], X.class_weight, ("a", "b"))
    assert got == [-25, 50, 0]
    tags = ["div", "td", "li", "h1", "p"]
    assert values(spark, tags, lambda t: X.initial_score(t, F.lit(0))) == [5, 3, -3, -5, 0]


def test_srcset(spark):
    got = values(spark, ["a.png 1x, /b.png 2x", "c.png"], lambda c: U.absolutize_srcset(c, F.lit("https://ex.com/d/")))
    assert got == ["https://ex.com/d/a.png 1x, https://ex.com/b.png 2x", "https://ex.com/d/c.png"]


def test_messages_and_days(spark):
    assert values(spark, ["NO_SELECTION"], X.error_message)[0].startswith("No text is selected")
    assert values(spark, ["2026-01-31 23:59:59"], lambda c: X.date_string(c.cast("timestamp"))) == ["2026-01-31"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, ["2026-01-31 23:59:59"], lambda c: X.date_string(c.cast("timestamp"))) == ["2026-02-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_long_pages_crash_no_task(spark):
    many = 100_000
    tag = "<a " + "".join(f'x{i}="{i}" ' for i in range(many)) + 'href="/y" title>'
    got = values(spark, [tag], lambda c: M.own("href", c))
    assert got == ["/y"]
    assert values(spark, [tag], lambda c: M.own("class", c)) == [""]
    assert values(spark, ["<br>" * many], A.paragraphs_from_breaks) == ["<p>"]
    image = "<img " + 'a="b" ' * many + ">"
    assert values(spark, [f"{image} <noscript>{image}</noscript>"], A.unwrap_noscript) == [image + " "]
    rows = values(spark, ["<" * many + "x"], lambda c: F.array_join(T.split_html(c), ""))
    assert rows == ["<" * many + "x"]


def test_own_attribute(spark):
    cases = {'<a title="x href=z" HREF = "/y">': "/y", "<a href='/q' href=2>": "/q", "<a href>": "", "<a xhref=1>": "",
             "<a class=b href=/u/>": "/u/", "<a\n data-href='n'\n href=m>": "m"}
    assert values(spark, list(cases), lambda c: M.own("href", c)) == list(cases.values())


def test_long_texts_are_taken_apart_once(spark):
    """A step inside a lambda is not worked out again for each run of backticks, or for each word."""
    import time

    many = 20_000
    start = time.time()
    runs = "".join("`" * (1 + i % 3) + "a" for i in range(many))
    assert values(spark, [runs], X.inline_code) == [f"```` {runs} ````"]
    words = " ".join(f"w{i}" for i in range(many))
    assert values(spark, [words], lambda c: X.text_similarity(c, F.concat(c, F.lit(" x")))) == [1 - 1 / (len(words) + 2)]
    assert time.time() - start < 20


def test_padding_of_code_spans(spark):
    texts = [" a ", " a", "   ", "   ", " a b ", "    ", " " * 50_000 + "a", None]
    pad = [" ", "", "", " ", " ", "", "", None]
    assert values(spark, texts, X.inline_code) == [None if t is None else f"`{p}{t}{p}`" for t, p in zip(texts, pad)]


def test_all_signs_but_white_space(spark):
    """The class that asks for common signs first holds the same signs as the plain one."""
    signs = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    plain = values(spark, signs, lambda c: c.rlike(f"[^{X.WS}]"))
    assert values(spark, signs, lambda c: c.rlike(X.NO_WS)) == plain
    assert values(spark, signs, lambda c: F.right(c, F.lit(1)).rlike(X.NO_WS)) == values(spark, signs, lambda c: c.rlike(rf"[^{X.WS}]\z"))
    assert plain.count(False) == len(X.WS_CHARS)
    assert values(spark, signs, lambda c: c.rlike(X.ONE_WS)) == [not p for p in plain]


def test_words_of_all_white_space(spark):
    """Words between white space of all kinds, also at the ends; 3 quarters of a word outweigh a quarter of its few signs."""
    texts = [" \u3000" + "a 語\u00a0x\t" * 5_000 + "é", "".join("a" + s for s in X.WS_CHARS), "", " \n", None]
    assert values(spark, texts, X.token_estimate) == [15_001 * 3 // 4 + 1, len(X.WS_CHARS) * 3 // 4 + (len(X.WS_CHARS) * 3 % 4 > 0), 0, 1, 0]
