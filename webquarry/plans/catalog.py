"""Pages made by Spark from the given tables, with the markup that the crawled pages lack.

The expected Markdown comes straight from the tables, so it knows nothing of HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_pages(spark, sf) -> DataFrame:
    """One page per supplier: lists, a table, quotes, code, images, links and a rule."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    r = spark.read.parquet(f"{sf}/region.parquet")
    df = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    html = F.format_string(
        "<html><head><title>%1$s</title></head><body><nav><a href=\"/\">home</a></nav>"
        "<h2>Facts</h2><table><thead><tr><th>Key</th><th>Nation</th><th></th></tr></thead>"
        "<tbody><tr><td>%2$s</td><td> %3$s </td><td></td></tr><tr><td><b>%4$s</b></td><td>x<br></td></tr></tbody></table>"
        "<ol start=\"%2$s\"><li>%3$s</li><li>%4$s<ul><li>one</li><li>two</li></ul></li><li><p>para</p></li></ol>"
        "<blockquote><p>%3$s</p><blockquote>in %4$s</blockquote></blockquote>"
        "<pre><code class=\"language-sql\">SELECT %2$s\n  FROM t\n</code></pre>"
        "<p>Use <code>%3$s`x</code> and <em>%4$s </em>or <strong><i>both</i></strong></p><hr>"
        "<p><img src=\"img/%2$s.png\" alt=\"%3$s\" title=\"pic\"><a href=\"../up?k=%2$s#f\" title=\"t\">go (%4$s)</a></p>"
        "<p> </p><div></div><div class=\"ads\">gone</div><script>x</script></body></html>",
        F.col("s_name"), F.col("s_suppkey").cast("string"), F.col("n_name"), F.col("r_name"))
    return df.select(F.col("s_suppkey").cast("bigint").alias("page_id"),
                     F.lit("https://www.example.com/a/b/c.html").alias("url"), html.alias("html"))


CATALOG_SQL = r"""
  WITH s AS (SELECT s_suppkey AS k, s_name AS s, n_name AS code, replace(n_name, '_', '\_') AS n, replace(r_name, '_', '\_') AS r
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  e AS (SELECT *, length(k || '.  ') AS w1, length((k + 1) || '.  ') AS w2, length((k + 2) || '.  ') AS w3 FROM s)
  SELECT CAST(k AS BIGINT) AS page_id, replace(
    '# ' || s || '~~## Facts~~| Key | Nation |  |~| --- | --- | --- |~| ' || k || ' | ' || n || ' |  |~| **' || r || '** | x |'
    || '~~' || k || '.  ' || n || '~' || (k + 1) || '.  ' || r
    || '~' || repeat(' ', w2) || '-   one~' || repeat(' ', w2) || '-   two'
    || '~' || (k + 2) || '.  para~' || repeat(' ', w3)
    || '~~> ' || n || '~> ~> > in ' || r
    || '~~```sql~SELECT ' || k || '~  FROM t~```'
    || '~~Use ``' || code || '`x`` and *' || r || '* or ***both***'
    || '~~---~~![' || code || '](https://www.example.com/a/b/img/' || k || '.png "pic")[go (' || r
    || ')](https://www.example.com/a/up?k=' || k || '#f "t")', '~', chr(10)) AS markdown
  FROM e
"""


def supplier_pages(spark, sf) -> DataFrame:
    """One page per supplier whose head holds JSON-LD (every third), meta tags or only a title."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    ld = F.format_string(
        '<script type="application/ld+json">{"@context": "https://schema.org/", "@graph": [{"@type": "Person"}, '
        '{"@type": "NewsArticle", "headline": "News of %1$s", "author": [{"name": " A %1$s "}, {"name": "B"}], '
        '"publisher": {"name": "House %2$s"}, "datePublished": "2024-01-02", "description": "About %2$s"}]}</script>',
        F.col("s_name"), F.col("s_suppkey").cast("string"))
    meta = F.format_string(
        '<meta property="og:title" content="First"><meta property="og:title" content="Open &amp;amp; %1$s">'
        '<meta name="author" content=" W %2$s "><meta property="og:site_name" content="Site">'
        '<meta name="DC.Description" content="Text of %2$s"><meta property="article:published_time" content="2023-05-06">',
        F.col("s_name"), F.col("s_suppkey").cast("string"))
    k = F.col("s_suppkey") % 3
    head = F.when(k == 0, ld).when(k == 1, meta).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head><title>The long page of "), F.col("s_name"), F.lit(" | Site</title>"),
                    head, F.lit("</head><body><p>x</p></body></html>"))
    return s.select(F.col("s_suppkey").cast("bigint").alias("page_id"),
                    F.lit("https://www.example.com/x").alias("url"), html.alias("html"))


METADATA_SQL = """
  SELECT CAST(s_suppkey AS BIGINT) AS page_id,
    CASE s_suppkey % 3 WHEN 0 THEN 'News of ' || s_name WHEN 1 THEN 'Open & ' || s_name ELSE 'The long page of ' || s_name END AS title,
    CASE s_suppkey % 3 WHEN 0 THEN 'A ' || s_name || ', B' WHEN 1 THEN 'W ' || s_suppkey END AS byline,
    CASE s_suppkey % 3 WHEN 0 THEN 'About ' || s_suppkey WHEN 1 THEN 'Text of ' || s_suppkey END AS excerpt,
    CASE s_suppkey % 3 WHEN 0 THEN 'House ' || s_suppkey WHEN 1 THEN 'Site' END AS site_name,
    CASE s_suppkey % 3 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2023-05-06' END AS published_time
  FROM supplier
"""


_PROSE = (
    "The works of {n} lie in a valley, near a river, and have done so for many years now. "
    "People who live there know each bend of it, each weir, each mill, and each of the old bridges. "
    "What they make is sold far away, in towns that none of them will ever see, part {i}."
)


def story_pages(spark, sf) -> DataFrame:
    """One article per supplier among everything that an extraction must leave out."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    p = ["<p>" + _PROSE.format(n="%1$s", i=i) + "</p>" for i in (1, 2, 3)]
    body = (
        "<div class=\"sidebar-box\">Side, side, side text that goes on for a while.</div>"
        "<div style=\"display: none\">Never seen, this one is.</div>"
        "<div role=\"dialog\" aria-modal=\"true\">Accept all, please.</div>"
        "<div role=\"navigation\">Go here, go there.</div>"
        "<main class=\"story\"><h1>A tale of %1$s told at length</h1><p class=\"byline\">By Writer %2$s</p>"
        + p[0] + "<div>Short words of <b>%2$s</b> in a div.</div>" + p[1]
        + "<div class=\"share\">Share this, friends.</div>"
        "<form><p>Join, please.</p><input><input></form>"
        "<h2 class=\"promo\">Buy now</h2><aside>Beside, aside.</aside><button>Push</button>"
        "<ul><li><a href=\"/l/%2$s\">link %2$s</a></li><li>two</li></ul>"
        "<table><tr><td>Alone in %2$s.</td></tr></table>"
        "<table><thead><tr><th>K</th><th>V</th></tr></thead><tbody><tr><td>a</td><td>%2$s</td></tr></tbody></table>"
        "<p></p><p><a href=\"javascript:go()\">Plain %2$s</a></p>"
        "<p><img class=\"lazy\" data-src=\"/pic/%2$s.jpg\" alt=\"Pic\"></p>" + p[2]
        + "<div>one line<br><br>next line</div><footer>Foot, foot.</footer></main>"
    )
    html = F.format_string(
        "<html><head><title>A tale of %1$s told at length</title></head><body>" + body + "</body></html>",
        F.col("s_name"), F.col("s_suppkey").cast("string"))
    return s.select(F.col("s_suppkey").cast("bigint").alias("page_id"),
                    F.lit("https://www.example.com/tales/x").alias("url"), html.alias("html"))


def _prose_sql(i: int) -> str:
    return "'" + _PROSE.format(n="' || s || '", i=i) + "'"


# the blank line between the two items is a rule of the post-processing
STORY_SQL = f"""
  SELECT CAST(k AS BIGINT) AS page_id, replace(
    '# A tale of ' || s || ' told at length~~' || {_prose_sql(1)}
    || '~~Short words of **' || k || '** in a div.~~' || {_prose_sql(2)}
    || '~~Share this, friends.~~-   [link ' || k || '](https://www.example.com/l/' || k || ')~~-   two'
    || '~~Alone in ' || k || '.~~| K | V |~| --- | --- |~| a | ' || k || ' |'
    || '~~Plain ' || k || '~~![Pic](https://www.example.com/pic/' || k || '.jpg)~~' || {_prose_sql(3)}
    || '~~one line~~next line~~By Writer ' || k || ' / www.example.com /  / ' || {_prose_sql(1)}, '~', chr(10)) AS markdown
  FROM (SELECT s_suppkey AS k, s_name AS s FROM supplier)
"""


def framed_pages(spark, sf) -> DataFrame:
    """A page per nation with four frames, and a page per region that one of them shows."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    r = spark.read.parquet(f"{sf}/region.parquet")
    text = "a text about the region that is long enough to be put into the page"
    inner = F.format_string(
        "<html><head><title>x</title></head><body><script>no()</script><p>%s is " + text + "</p></body></html>", "r_name")
    docs = r.select((F.col("r_regionkey") + 1000).cast("bigint").alias("page_id"),
                    F.concat(F.lit("https://www.example.com/region/"), "r_regionkey").alias("url"), inner.alias("html"))
    html = F.format_string(
        "<html><head><title>Nation %1$s</title></head><body><p>Before</p>"
        "<iframe src=\"/region/%2$s\"></iframe>"
        "<iframe srcdoc=\"&lt;p&gt;Inside %1$s there is a text that is long enough to be kept.&lt;/p&gt;\"></iframe>"
        "<iframe src=\"https://maps.example.org/%1$s\" title=\"Map %1$s\"></iframe>"
        "<iframe srcdoc=\"too short\"></iframe><p>After</p></body></html>",
        F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    pages = n.select(F.col("n_nationkey").cast("bigint").alias("page_id"),
                     F.concat(F.lit("https://www.example.com/nation/"), "n_nationkey").alias("url"), html.alias("html"))
    return pages.unionByName(docs)


FRAMES_SQL = r"""
  SELECT CAST(n_nationkey AS BIGINT) AS page_id, replace('# Nation ' || n_nationkey || '~~Before~~' || replace(r_name, '_', '\_')
    || ' is a text about the region that is long enough to be put into the page~~Inside ' || n_nationkey
    || ' there is a text that is long enough to be kept.~~\[Embedded content: [Map ' || n_nationkey
    || '](https://maps.example.org/' || n_nationkey || ')\]~~'
    || 'too short~~After~~---~> **Note:** This page contains 1 cross-origin iframe(s) that could not be '
    || 'accessed due to browser security policies. Some content may be missing. Links to these iframes have been preserved '
    || 'where possible.~', '~', chr(10)) AS markdown
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT CAST(r_regionkey + 1000 AS BIGINT), '# x' || chr(10) || chr(10) || replace(r_name, '_', '\_')
    || ' is a text about the region that is long enough to be put into the page' FROM region
"""

WARNINGS_SQL = """
  SELECT CAST(n_nationkey AS BIGINT) AS page_id, 'crossOriginIframe' AS type, 1 AS "count",
    '[{"src":"https://maps.example.org/' || n_nationkey || '","title":"Map ' || n_nationkey || '"}]' AS details
  FROM nation
"""
