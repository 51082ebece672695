"""Markdown of small pages, worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from webquarry.operators.render import render
from webquarry.operators.prune import clean
from webquarry.operators.tokens import html_tokens, page_nodes
from webquarry.options import Options, Rule

URL = "https://ex.com/d/p.html"


def markdown(spark, bodies, opt=Options()):
    rows = [(i, URL, f"<html><head><title>T</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = render(clean(page_nodes(pages), opt), opt).collect()
    return [r.markdown for r in sorted(out, key=lambda r: r.page_id)]


GOLDEN = {
    "<p>x</p><ul><li>a</li><li>b</li></ul>": "x\n\n-   a\n-   b",
    "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>": "-   a\n    -   b\n    -   c\n-   d",
    "<ol start=9><li>a</li><li><p>b</p></li><li>c</li></ol>": "9.  a\n10.  b\n     \n11.  c",
    "<ul><li>a<li>b</ul>t": "-   a\n-   b\n\nt",
    "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr></table>":
        "| A | B |\n| --- | --- |\n| 1 |  |",
    "<table><tr><td>1</td><td>2</td></tr></table>": "| 1 | 2 |",
    "<table><tr><td>1<td>2<tr><td>3</table>": "| 1 | 2 |\n| 3 |",
    "<p><a href='#h'>This has <b>bold</b> and <i>italic</i> text</a></p>":
        f"[This has **bold** and *italic* text]({URL}#h)",
    "<a href='/x(1)' title='a\"b'>l</a>": 'l'.join(["[", "](https://ex.com/x\\(1\\) \"a\\\"b\")"]),
    "<pre class='lang-py'>a\n<span>b</span><br>c\n</pre>": "```py\na\nb\nc\n```",
    "<pre><code class='language-js'>```\nx</code></pre>": "````js\n```\nx\n````",
    "<blockquote>a<blockquote>b<br>c</blockquote></blockquote>": "> a\n> \n> > b  \n> > c",
    "<ul><li>a<pre>b\nc</pre></li></ul>": "-   a\n    \n    ```\n    b\n    c\n    ```",
    "a<b> b </b>c <code>x`y</code>": "a **b** c ``x`y``",
    "<b></b><em><br></em><i> </i>x": "x",
    "<p>a</p><hr><p>b</p>": "a\n\n---\n\nb",
    "<img src='i.png' alt='A' title='T'><img alt='none'>": '![A](https://ex.com/d/i.png "T")',
    "<p><b>x<br><p>y": "**x  \n**\n\ny",
    "<p>1. a_b*</p>": r"1\. a\_b\*",
    "<nav>n</nav><div class='x ads'>a</div><div class='ad'>kept</div><footer>f</footer><p></p>": "kept",
    "<h1>A</h1><h3>B <a href=''>c</a></h3>": f"# A\n\n### B [c]({URL}?)".replace("?", ""),
    "</div>a<div><span>b</div>c</p>": "a\n\nb\n\nc",
    "<script>var t='</p>'</script><style>p{}</style><noscript>n</noscript>z": "z",
    "x &amp;lt; 2 < 3": "x &lt; 2 < 3",
}


def test_golden(spark):
    got = markdown(spark, GOLDEN)
    assert dict(zip(GOLDEN, got)) == GOLDEN


@pytest.mark.parametrize("opt, body, expected", [
    (Options(links=False, images=False), "<a href='x'>t</a><img src='a.png'><p>u</p>", "t\n\nu"),
    (Options(tables=False), "<table><tr><td>a</td><td>b</td></tr></table>", "a\n\nb"),
    (Options(heading_style="setext", hr="* * *", bullet="*", em="_"),
     "<h1>Hi</h1><hr><ul><li><i>x</i></li></ul>", "Hi\n==\n\n* * *\n\n*   _x_"),
    (Options(code_style="indented"), "<pre><code>a\nb</code></pre><p>x</p>", "    a\n    b\n\nx"),
    (Options(link_style="referenced"), "<a href='/a'>x</a> <a href='/b' title='t'>y</a>",
     '[x][1] [y][2]\n\n[1]: https://ex.com/a\n[2]: https://ex.com/b "t"'),
    (Options(link_style="referenced", link_references="collapsed"), "<a href='/a'>x</a>",
     "[x][]\n\n[x]: https://ex.com/a"),
    (Options(keep=("kbd",), remove=("mark",)), "<p>a <kbd>K</kbd><mark>m</mark></p>", "a <kbd>K</kbd>"),
    (Options().with_rule(Rule("strike", ("del",), lambda a: F.lit("~~"), lambda a: F.lit("~~"))),
     "<p><del>x</del> <b>y</b></p>", "~~x~~ **y**"),
    (Options().with_rule(Rule("bold", ("b",), lambda a: F.lit("__"), lambda a: F.lit("__"))),
     "<b>y</b>", "__y__"),
])
def test_options(spark, opt, body, expected):
    assert markdown(spark, [body], opt) == [expected]


def test_tokens_give_the_page_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    joined = html_tokens(pages).groupBy("page_id").agg(
        F.expr("listagg(tok) WITHIN GROUP (ORDER BY pos)").alias("again"))
    assert pages.join(joined, "page_id").filter("html <> again").count() == 0


def test_every_element_closes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    sums = page_nodes(pages).groupBy("page_id").agg(F.sum(step).alias("s"))
    assert sums.filter("s <> 0").count() == 0
    assert sums.count() == pages.count()


def test_one_exchange(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = render(clean(page_nodes(pages)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
