"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.functions import markup as M
from webquarry.functions import text as X
from webquarry.functions import urls as U
from webquarry.operators import article as A
from webquarry.operators import batch as B
from webquarry.operators import metadata as D
from webquarry.operators import nodes as N
from webquarry.operators import tokens as T
from webquarry.operators.blocks import text_blocks
from webquarry.operators.budget import token_columns, token_count_vocab
from webquarry.operators.frames import frame_docs, iframe_warnings
from webquarry.operators.lineage import cut, work_folder
from webquarry.operators.score import score_candidates, with_features
from webquarry.options import Options
from webquarry.plans import catalog
from webquarry.plans.article import article_markdown
from webquarry.plans.convert import convert, flag_lazy
from webquarry.plans.full_page import full_page_markdown
from webquarry.sources.pages import read_pages, select_batch
from webquarry.sources.sinks import write_export
from webquarry.streaming.convert import convert_stream, count_stream, newest, read_page_stream

QUERIES, ORACLES = {}, {}

#: The pages as a pattern, which a stream reads whether the table is one file or a folder of them; it takes a plain path for a folder.
PAGES_FOUND = "page[s].parquet"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def pages(spark, sf) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- SQL building blocks

_TOKEN = (
    r"(?i)<!--(?s:.)*?-->|<!DOCTYPE[^>]*>|<script\b[^>]*>(?s:.)*?</script\s*>|"
    r"<style\b[^>]*>(?s:.)*?</style\s*>|"
    r"""</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?/][^>]*>|(?:[^<]|<[^a-z!?/<])+|<"""
)
_TOKENS = f"""
  SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS tok
  FROM (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS l FROM pages)
"""


def _decoded(c: str) -> str:
    return (
        f"replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), "
        "'&amp;', '&')"
    )


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g'))"


def _escaped(c: str) -> str:
    rules = [
        (r"\\", r"\\\\"), (r"\*", r"\\*"), ("^-", r"\\-"), (r"^\+ ", r"\\+ "), ("^(=+)", r"\\\1"),
        ("^(#{1,6}) ", r"\\\1 "), ("`", r"\\`"), ("^~~~", r"\\~~~"), (r"\[", r"\\["),
        (r"\]", r"\\]"), ("^>", r"\\>"), ("_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "),
    ]
    for pattern, new in rules:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


def _estimate(c: str) -> str:
    words = f"len(regexp_extract_all({c}, '\\S+'))"
    return f"CAST(ceil(greatest({words} * 3, length({c})) / 4.0) AS BIGINT)"


_NL = "chr(10)"
_GAP = "chr(10) || chr(10)"
_TITLE = _flat(_decoded("regexp_extract(html, '<title>((?s:.)*?)</title>', 1)"))
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
# the pages are an ad, then an article of a heading and paragraphs, some starting with an unclosed b
_PARTS = f"""
  parts AS (
    SELECT page_id, i, part, part LIKE '<b>%' AS bold,
           {_flat(_decoded("regexp_replace(part, '<[^>]*>', '', 'g')"))} AS txt
    FROM (
      SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS part
      FROM (SELECT page_id, string_split(
              regexp_extract(html, '(?s)<article><h1>.*?</h1>(.*)</article>', 1), '<p>') AS l FROM pages))
    WHERE i > 0
  ),
  body AS (
    SELECT page_id, string_agg(
      CASE WHEN bold THEN '**' || {_escaped('txt')} || '  ' || {_NL} || '**' ELSE {_escaped('txt')} END,
      {_GAP} ORDER BY i) AS md
    FROM parts WHERE txt <> '' GROUP BY page_id
  ),
  page AS (
    SELECT page_id, url, html, {_TITLE} AS title,
           {_flat(_decoded("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))} AS ad,
           {_flat(_decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1
    FROM pages
  )
"""


_FULL_PAGE = f"""
  SELECT page_id, url, title, true AS success, md AS markdown, {_estimate('md')} AS token_count
  FROM (SELECT page.page_id, url, title, '# ' || title || {_GAP} || {_escaped('ad')} || {_GAP} || '# '
          || {_escaped('h1')} || coalesce({_GAP} || md, '') || {_GAP} || '---' || {_NL}
          || 'Source: [' || title || '](' || url || ')' AS md
        FROM page LEFT JOIN body USING (page_id))
"""


_RESULT = ["page_id", "url", "title", "success", "markdown", "token_count"]
_STATUS = """CASE WHEN {c} * 100 >= {l} * 100 THEN 'error' WHEN {c} * 100 >= {l} * 90 THEN 'warn'
  WHEN {c} * 100 >= {l} * 75 THEN 'note' ELSE 'ok' END"""


# ---------------------------------------------------------------- token stream


@query(_TOKENS)
def html_tokens(spark, sf):
    return T.html_tokens(pages(spark, sf)).select("page_id", "pos", "tok")


@query(f"""
  SELECT tag, count(*) FILTER (tok NOT LIKE '</%') AS opens, count(*) FILTER (tok LIKE '</%') AS closes
  FROM (SELECT tok, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag FROM ({_TOKENS}))
  WHERE tag <> '' GROUP BY tag
""")
def tag_counts(spark, sf):
    t = T.html_tokens(pages(spark, sf)).filter("tag IS NOT NULL")
    closes = F.col("tok").startswith("</")
    return t.groupBy("tag").agg(F.count_if(~closes).alias("opens"), F.count_if(closes).alias("closes"))


@query(f"""
  SELECT page_id, pos, regexp_extract(tok, '^<([a-z0-9]+)', 1) AS tag,
         regexp_extract(tok, 'class="([^"]*)"', 1) || ' ' AS match_string,
         regexp_extract(tok, 'href="([^"]*)"', 1) AS href
  FROM ({_TOKENS}) WHERE regexp_matches(tok, '^<[a-z]') AND NOT regexp_matches(tok, '^<(script|style)')
""")
def attributes(spark, sf):
    t = T.tag_attrs(T.html_tokens(pages(spark, sf)))
    href = F.coalesce(F.try_element_at("attrs", F.lit("href")), F.lit(""))
    return t.select("page_id", "pos", "tag", "match_string", href.alias("href"))


@query(f"""SELECT page_id, pos, {_decoded('tok')} AS txt FROM ({_TOKENS}) WHERE tok NOT LIKE '<%'""")
def entity_decode(spark, sf):
    t = T.drop_scripts(T.html_tokens(pages(spark, sf))).filter("kind = 'text'")
    return t.select("page_id", "pos", X.decode_entities(F.col("tok")).alias("txt"))


@query(f"""
  WITH {_PARTS}
  SELECT page_id, count(*) AS blocks, sum(length(txt)) AS chars FROM (
    SELECT page_id, txt FROM parts
    UNION ALL SELECT page_id, ad FROM page
    UNION ALL SELECT page_id, h1 FROM page
    UNION ALL SELECT page_id, {_flat(_decoded("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"))} FROM page
    UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) FROM pages
  ) WHERE txt <> '' GROUP BY page_id
""")
def blocks_of_text(spark, sf):
    b = text_blocks(T.page_nodes(pages(spark, sf)))
    return b.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def _inner(tag: str, before: str = "", inside: str = ".*?") -> str:
    return f"""SELECT page_id, '{tag}' AS tag, unnest(regexp_extract_all(html, '(?s)<{tag}{before}>({inside})</{tag}>', 1)) AS part FROM pages"""


_BODY = "regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->|</body>|</html>', '', 'g')"


@query(f"""
  WITH {_PARTS}, x AS (
    {_inner('nav')} UNION ALL {_inner('ul')} UNION ALL {_inner('li')} UNION ALL {_inner('a', ' [^>]*')} UNION ALL {_inner('div', ' class="ad"')}
    UNION ALL {_inner('article', inside='.*')} UNION ALL {_inner('h1')} UNION ALL {_inner('footer')}
    UNION ALL SELECT page_id, 'p', part FROM parts UNION ALL SELECT page_id, 'b', substr(part, 4) FROM parts WHERE bold
    UNION ALL SELECT page_id, 'body', {_BODY} FROM pages),
  y AS (SELECT page_id, tag, part, {_decoded("regexp_replace(part, '<[^>]*>', '', 'g')")} AS txt,
          length({_decoded("regexp_replace(regexp_extract(part, '(?s)<nav>(.*?)</nav>', 1), '<[^>]*>', '', 'g')")}) AS nav FROM x)
  SELECT page_id, tag, length(trim(regexp_replace(txt, '\\s{{2,}}', ' ', 'g'))) AS text_len,
    CASE WHEN tag = 'body' THEN nav * 10 WHEN tag IN ('nav', 'ul', 'li', 'a') THEN length(txt) * 10 ELSE 0 END AS link10,
    length(txt) - length(replace(txt, ',', '')) AS commas,
    len(regexp_extract_all(part, '<[a-z]')) AS elements
  FROM y
""")
def node_features(spark, sf):
    return N.html_nodes(pages(spark, sf)).select("page_id", "tag", "text_len", "link10", "commas", "elements")


@query("""
  WITH links AS (
    SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
  SELECT page_id, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || array_to_string(
    list_transform(regexp_extract_all(replace(href, '&amp;', '&'), '[!#$%&''()*+,./0-9:;=?@A-Z_a-z~-]+|[^!#$%&''()*+,./0-9:;=?@A-Z_a-z~-]+'),
      lambda p: CASE WHEN regexp_matches(p, '^[!#$%&''()*+,./0-9:;=?@A-Z_a-z~-]') THEN p ELSE url_encode(p) END), '') AS link,
    count(*) AS n
  FROM links GROUP BY ALL
""")
def page_links(spark, sf):
    t = T.html_tokens(pages(spark, sf), ("url",)).filter("kind = 'open' AND tag = 'a'")
    href = M.own("href")
    link = U.absolutize(X.decode_entities(href), F.col("url"))
    return t.groupBy("page_id", href.alias("href"), link.alias("link")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- titles and addresses


_PAGE_TITLES = f"""
  WITH t AS (SELECT page_id, {_TITLE} AS t,
    trim(regexp_replace({_decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '\\s{{2,}}', ' ', 'g')) AS h1 FROM pages),
  u AS (SELECT page_id, t, h1, CASE
      WHEN regexp_matches(t, ' [|\\-\\\\/>»] ') THEN
        CASE WHEN len(regexp_split_to_array(regexp_extract(t, '(?s)^(.*) [|\\-\\\\/>»] ', 1), '\\s+')) < 3
             THEN regexp_replace(t, '^[^|\\-\\\\/>»]*[|\\-\\\\/>»]', '') ELSE regexp_extract(t, '(?s)^(.*) [|\\-\\\\/>»] ', 1) END
      WHEN contains(t, ': ') THEN CASE WHEN trim(h1) = t THEN t
        WHEN len(regexp_split_to_array(regexp_extract(t, '(?s)^.*:(.*)$', 1), '\\s+')) < 3 THEN regexp_extract(t, '(?s)^[^:]*:(.*)$', 1)
        WHEN len(regexp_split_to_array(regexp_extract(t, '^([^:]*):', 1), '\\s+')) > 5 THEN t
        ELSE regexp_extract(t, '(?s)^.*:(.*)$', 1) END
      WHEN length(t) > 150 OR length(t) < 15 THEN h1 ELSE t END AS c FROM t),
  v AS (SELECT page_id, t, regexp_replace(trim(c), '\\s{{2,}}', ' ', 'g') AS c, regexp_matches(t, ' [\\\\/>»] ') AS h FROM u)
  SELECT page_id, CASE WHEN len(regexp_split_to_array(c, '\\s+')) <= 4 AND (NOT h OR len(regexp_split_to_array(c, '\\s+'))
     <> len(regexp_split_to_array(regexp_replace(t, '[|\\-\\\\/>»]+', '', 'g'), '\\s+')) - 1) THEN t ELSE c END AS title
  FROM v
"""


@query(_PAGE_TITLES)
def page_titles(spark, sf):
    return pages(spark, sf).select("page_id", D.page_article_title(F.col("html")).alias("title"))


@query("""
  WITH w AS (
    SELECT a.conv_id, a.turn,
      list_filter(regexp_split_to_array(lower(a.text), '[^a-zA-Z0-9_]+'), lambda x: x <> '') AS wa,
      list_filter(regexp_split_to_array(lower(b.text), '[^a-zA-Z0-9_]+'), lambda x: x <> '') AS wb
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
  SELECT conv_id, turn, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE
    round(1.0::DOUBLE - CAST(length(array_to_string(list_filter(wb, lambda x: NOT list_contains(wa, x)), ' ')) AS DOUBLE)
      / length(array_to_string(wb, ' ')), 9) END AS similarity
  FROM w
""")
def title_similarity(spark, sf):
    c = table(spark, sf, "conversations")
    turns = T.win(["conv_id"], "turn")
    both = c.withColumns({"next": F.lead("text").over(turns), "follows": F.lead("turn").over(turns)})
    return both.filter("follows = turn + 1").select("conv_id", "turn", F.round(
        X.text_similarity(F.col("text"), F.col("next")), 9).alias("similarity"))


# every other page gets an address of another kind
_MIXED = """CASE page_id % 4 WHEN 1 THEN replace(url, 'https://', 'http://') WHEN 2 THEN 'chrome://settings/' || page_id
  WHEN 3 THEN 'HTTPS://' || substr(url, 9) ELSE url END"""


@query(f"""
  WITH pages AS (SELECT page_id, {_MIXED} AS url FROM pages)
  SELECT page_id, {_HOST.replace('[a-z]+', '[a-zA-Z]+')} AS host, regexp_matches({_HOST.replace('[a-z]+', '[a-zA-Z]+')}, '(^|\\.)example\\.(com|org)$') AS is_lazy,
    CASE WHEN regexp_matches({_HOST.replace('[a-z]+', '[a-zA-Z]+')}, '(^|\\.)example\\.com$') THEN 'host:example.com'
         WHEN regexp_matches({_HOST.replace('[a-z]+', '[a-zA-Z]+')}, '(^|\\.)example\\.org$') THEN 'host:example.org' END AS reason,
    NOT regexp_matches(url, '^(chrome://|edge://|about:|chrome-extension://|moz-extension://)') AS convertible,
    regexp_matches(url, '(?i)^https?://') AS is_http
  FROM pages
""")
def page_hosts(spark, sf):
    lazy = flag_lazy(pages(spark, sf).withColumn("url", F.expr(_MIXED)), ["example.com", "example.org"])
    url = F.col("url")
    return lazy.select("page_id", U.hostname(url).alias("host"), "is_lazy", "reason",
                       U.is_convertible_url(url).alias("convertible"), U.is_http_url(url).alias("is_http"))


@query(f"""
  SELECT page_id, 'T=' || {_TITLE} || ' U=' || url || ' S=' || {_HOST} || ' D= A=' AS footer FROM pages
""")
def metadata_footer(spark, sf):
    values = {"title": D.document_title(F.col("html")), "url": F.col("url"), "date": F.lit(""),
              "author": F.lit(""), "siteName": U.hostname(F.col("url"))}
    footer = X.format_metadata("T={title} U={url} S={siteName} D={date} A={author}", values)
    return pages(spark, sf).select("page_id", footer.alias("footer"))


_BASE = (
    "regexp_replace(regexp_replace(regexp_replace(t, '[<>:\"/\\\\|?*\\x00-\\x1F]', '', 'g'), '[\\s.]+', '_', 'g'), "
    "'_+', '_', 'g')"
)


@query(f"""
  WITH t AS (SELECT page_id, {_TITLE} AS t FROM pages),
  b AS (SELECT page_id, coalesce(nullif(rtrim(substr(trim({_BASE}, '_'), 1, 100), '_'), ''), 'untitled') AS base FROM t)
  SELECT page_id, base || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.md' AS file_name
  FROM (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) - 1 AS n FROM b)
""")
def file_names(spark, sf):
    t = pages(spark, sf).select("page_id", D.document_title(F.col("html")).alias("title"))
    return B.unique_names(t).select("page_id", "file_name")


# ---------------------------------------------------------------- tokens and budgets


@query(f"""
  SELECT doc_id, n AS token_count, round(n / 4096 * 100, 1) AS percentage, n > 4096 AS is_over_limit,
    greatest(0, 4096 - n) AS remaining, {_STATUS.format(c='n', l='4096')} AS status
  FROM (SELECT doc_id, {_estimate('text')} AS n FROM documents)
""")
def token_estimates(spark, sf):
    d = token_columns(table(spark, sf, "documents"), "text", 4096)
    return d.select("doc_id", "token_count", "report.percentage", "report.is_over_limit", "report.remaining",
                    "budget.status")


_WORDS = r"""''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_ROWS = {
    "documents": "SELECT 'd' || doc_id AS id, text FROM documents",
    "conversations": "SELECT 'c' || conv_id || '-' || turn AS id, text FROM conversations",
}


@query()
def token_heuristics(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text")
    return d.unionByName(c).select("id", X.token_heuristic(F.col("text")).alias("token_count"))


# a run of white space before a word gives up its last sign: k signs count as k-1 and 1
ORACLES["token_heuristics"] = f"""
  WITH rows AS ({_ROWS['documents']} UNION ALL {_ROWS['conversations']}),
  marked AS (SELECT id, regexp_replace(text, '(\\s+)(\\s)(\\S)', '\\1' || chr(1) || '\\2\\3', 'g') AS t FROM rows),
  split AS (SELECT id, unnest(string_split(t, chr(1))) AS s FROM marked),
  pieces AS (SELECT id, unnest(regexp_extract_all(s, '{_WORDS}')) AS p FROM split)
  SELECT id, CAST(sum(greatest(1, ceil(strlen(p) / 4.0))) + 1 AS BIGINT) AS token_count FROM pieces GROUP BY id
"""


@query("""
  WITH n AS (SELECT doc_id, length(text) * 40 AS n FROM documents)
  SELECT doc_id, format('{:,}', n) || ' tokens' AS plain,
    format('{:,}', n) || ' / 8,192 tokens (' || CAST(round(n::DOUBLE / 8192 * 100) AS BIGINT) || '%)' AS of_limit,
    CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1000000.0::DOUBLE) || 'M'
         WHEN n >= 1000 THEN CAST(round(n / 1000.0::DOUBLE) AS BIGINT) || 'K' ELSE CAST(n AS VARCHAR) END AS short
  FROM n
""")
def limit_reports(spark, sf):
    n = F.length("text").cast("bigint") * 40
    return table(spark, sf, "documents").select(
        "doc_id", X.format_tokens(n).alias("plain"), X.format_tokens(n, 8192).alias("of_limit"),
        X.format_limit(n).alias("short"))


# ---------------------------------------------------------------- Markdown text


@query(f"SELECT doc_id, {_escaped('text')} AS escaped FROM documents")
def md_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.md_escape(F.col("text")).alias("escaped"))


@query(r"""
  WITH a AS (SELECT doc_id, regexp_replace(replace(text, ' the ', chr(10) || '- '), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
  b AS (SELECT doc_id, regexp_replace(t, '([^\n])(\n#{1,6} )', '\1' || chr(10) || chr(10) || '\2', 'g') AS t FROM a)
  SELECT doc_id, regexp_replace(t, '(\n[*\-+] [^\n]+)(\n[*\-+] )', '\1' || chr(10) || '\2', 'g') AS done FROM b
""")
def post_processed(spark, sf):
    t = F.replace(F.col("text"), F.lit(" the "), F.lit("\n- "))
    return table(spark, sf, "documents").select("doc_id", X.post_process(t).alias("done"))


@query("""
  SELECT doc_id, txt AS inner_text, CASE WHEN length(txt) >= 25 THEN
    2 + length(txt) - length(replace(txt, ',', '')) + least(length(txt) // 100, 3) ELSE 0 END AS score
  FROM (SELECT doc_id, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s{2,}', ' ', 'g') AS txt FROM documents)
""".replace("\\\\", "\\"))
def paragraph_scores(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.inner_text(F.col("text")).alias("inner_text"),
        X.paragraph_score(F.col("text")).cast("bigint").alias("score"))


# ---------------------------------------------------------------- conversion


@query(f"""
  WITH {_PARTS}, r AS ({_FULL_PAGE})
  SELECT page_id, url, markdown, token_count, {_STATUS.format(c='token_count', l='8192')} AS status FROM r
""")
def full_page(spark, sf):
    r = full_page_markdown(pages(spark, sf))
    return r.select("page_id", "url", "markdown", "token_count",
                    X.budget_status(F.col("token_count"))["status"].alias("status"))


_SPLIT_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^a-zA-Z0-9_]+'), lambda x: x <> '')"


# the ad stays when the whole body is taken, else when it is long or ends a sentence; the heading
# stays, one level down, when it does not repeat the title
@query(f"""
  WITH {_PARTS},
  names AS ({_PAGE_TITLES}),
  points AS (SELECT page_id, sum(CASE WHEN length(txt) >= 25 THEN 2 + length(txt) - length(replace(txt, ',', ''))
      + least(length(txt) // 100, 3) ELSE 0 END) AS pts, sum(length(txt)) AS chars FROM parts GROUP BY page_id),
  words AS (SELECT page.*, names.title AS name, coalesce(pts, 0) AS pts, coalesce(chars, 0) AS chars,
      {_SPLIT_WORDS.format(c='names.title')} AS wa, {_SPLIT_WORDS.format(c='h1')} AS wb,
      CASE WHEN length(ad) >= 25 THEN 2 + length(ad) - length(replace(ad, ',', '')) + least(length(ad) // 100, 3)
        ELSE 0 END AS ad_pts,
      length(array_to_string(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), '')) AS nav_chars,
      length({_flat(_decoded("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"))}) AS foot_chars
    FROM page JOIN names USING (page_id) LEFT JOIN points USING (page_id)),
  alike AS (SELECT *, len(wa) > 0 AND len(wb) > 0 AND 1 - CAST(length(array_to_string(list_filter(wb,
      lambda x: NOT list_contains(wa, x)), ' ')) AS DOUBLE) / length(array_to_string(wb, ' ')) > 0.75 AS same FROM words),
  chosen AS (SELECT *, (pts = 0 OR (pts / 2.0 + ad_pts) * (1 - nav_chars::DOUBLE / (nav_chars + length(ad) + foot_chars + chars
      + CASE WHEN same THEN 0 ELSE length(h1) END)) >= pts) AS whole FROM alike),
  done AS (SELECT chosen.page_id, url, title, '# ' || title || {_GAP} || regexp_replace(
      CASE WHEN whole OR length(ad) > 80 OR (length(ad) < 80 AND regexp_matches(ad, '[.]( |$)'))
        THEN {_escaped('ad')} || {_GAP} ELSE '' END
      || CASE WHEN same THEN '' ELSE '## ' || {_escaped('h1')} || {_GAP} END || coalesce(md, ''), '\n+$', '')
      || {_GAP} || '---' || {_NL} || 'Source: [' || name || '](' || url || ')' AS md
    FROM chosen LEFT JOIN body USING (page_id))
  SELECT page_id, url, title, true AS success, md AS markdown, {_estimate('md')} AS token_count FROM done
""")
def article(spark, sf):
    return article_markdown(pages(spark, sf)).select(*_RESULT)


@query(f"""
  WITH {_PARTS},
  s AS (SELECT page_id, sum(CASE WHEN length(txt) >= 25 THEN 2 + length(txt) - length(replace(txt, ',', ''))
          + least(length(txt) // 100, 3) ELSE 0 END) AS pts, sum(length(txt)) AS chars FROM parts GROUP BY page_id),
  a AS (SELECT page_id, CASE WHEN length(ad) >= 25 THEN 2 + length(ad) - length(replace(ad, ',', ''))
          + least(length(ad) // 100, 3) ELSE 0 END AS ad_pts FROM page)
  SELECT page_id, 'article' AS tag, CAST(36 * pts AS BIGINT) AS score36 FROM s WHERE pts > 0
  UNION ALL
  SELECT page_id, 'body', CAST(18 * coalesce(pts, 0) + 36 * ad_pts AS BIGINT) FROM a LEFT JOIN s USING (page_id)
  WHERE coalesce(pts, 0) + ad_pts > 0
""")
def node_scores(spark, sf):
    rows = cut(A.article_nodes(pages(spark, sf)), T.PAGE).withColumn("attempt", F.lit(1))
    rows = with_features(cut(A.prune_walk(cut(A.wrap_phrasing(rows), T.PAGE)), T.PAGE))
    c = score_candidates(rows, weigh=F.col("attempt") <= 2).filter("score36 IS NOT NULL")
    return c.select("page_id", "tag", F.col("score36").cast("bigint").alias("score36"))


# ---------------------------------------------------------------- batches


@query(f"""
  WITH r AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS part
    FROM conversations WHERE length(text) >= 200)
  SELECT conv_id, part, count(*) AS n, string_agg(text, {_GAP} || '---' || {_GAP} ORDER BY turn) AS markdown,
    CAST(NULL AS VARCHAR) AS error FROM r GROUP BY conv_id, part
  UNION ALL SELECT conv_id, 0, 0, NULL, '{C.NOTHING_CONVERTED}' FROM conversations GROUP BY conv_id HAVING max(length(text)) < 200
""")
def merged_bundle(spark, sf):
    c = table(spark, sf, "conversations").withColumn("success", F.length("text") >= 200)
    return B.merge_markdown(c, "conv_id", "turn", "text", per_part=2)


# titles that end in numbers, some of them the stem of others: q, q_1, q_1_1 …
_CLASH = "'q' || repeat('_1', CAST((page_id * 7) % 4 AS INT)) || CASE WHEN page_id % 5 = 0 THEN '_' || (page_id % 17 + 1) ELSE '' END"


@query(f"""
  WITH RECURSIVE t AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS i, {_CLASH} AS base FROM pages),
  go AS (
    SELECT CAST(1 AS BIGINT) AS i, page_id, base AS name, [base] AS used FROM t WHERE i = 1
    UNION ALL
    SELECT t.i, t.page_id, x.name, list_append(go.used, x.name) FROM go JOIN t ON t.i = go.i + 1, LATERAL (
      SELECT CASE WHEN list_contains(go.used, t.base) THEN t.base || '_' || list_min(list_filter(range(1, len(go.used) + 2),
        lambda n: NOT list_contains(go.used, t.base || '_' || n))) ELSE t.base END AS name) x)
  SELECT page_id, name || '.md' AS file_name FROM go
""")
def clashing_names(spark, sf):
    t = pages(spark, sf).select("page_id", F.expr(_CLASH.replace("CAST((page_id * 7) % 4 AS INT)", "int((page_id * 7) % 4)")).alias("title"))
    return B.unique_names(t).select("page_id", "file_name")


@query(f"""
  WITH r AS (SELECT role, length(text) >= 200 AS success, {_estimate('text')} AS t FROM conversations),
  g AS (SELECT role, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS fail_count,
          CAST(coalesce(sum(t) FILTER (success), 0) AS BIGINT) AS total_tokens FROM r GROUP BY role)
  SELECT role, success_count, fail_count, total_tokens,
    success_count || ' tab' || CASE WHEN success_count > 1 THEN 's' ELSE '' END
      || CASE WHEN fail_count > 0 THEN ' (' || fail_count || ' failed)' ELSE '' END AS message,
    CASE WHEN total_tokens > 0 THEN format('{{:,}}', total_tokens) || ' tokens ('
      || CAST(round(total_tokens::DOUBLE / 8192 * 100) AS BIGINT) || '% of 8K limit)' ELSE '' END AS token_message,
    success_count + fail_count > 20 AS large_batch,
    CASE WHEN success_count = 0 THEN '{C.NOTHING_CONVERTED}' END AS error
  FROM g
""")
def results_summary(spark, sf):
    c = table(spark, sf, "conversations").select(
        "role", (F.length("text") >= 200).alias("success"), X.token_estimate(F.col("text")).alias("token_count"))
    return B.results_summary(c, ["role"])


@query(f"""
  WITH {_PARTS}, r AS ({_FULL_PAGE}),
  x AS (SELECT {_estimate('html')} AS h, token_count AS m FROM r JOIN pages USING (page_id)),
  y AS (SELECT h, m, h * 1000 // m AS q, row_number() OVER (ORDER BY h * 1000 // m) AS i, count(*) OVER () AS n FROM x)
  SELECT count(*) AS n_pages, CAST(sum(h) AS BIGINT) AS html_tokens, CAST(sum(m) AS BIGINT) AS markdown_tokens,
    min(q) AS min_ratio_1000, max(q) AS max_ratio_1000, max(q) FILTER (i = (n + 1) // 2) AS median_ratio_1000
  FROM y
""")
def reduction_stats(spark, sf):
    p = pages(spark, sf)
    return B.reduction_stats(full_page_markdown(p, Options(scope="fullPage", html_tokens=True)))


# ---------------------------------------------------------------- pages made from the other tables


@query(catalog.CATALOG_SQL)
def catalog_markdown(spark, sf):
    r = full_page_markdown(catalog.catalog_pages(spark, sf), Options(scope="fullPage", metadata=False))
    return r.select("page_id", "markdown")


@query(catalog.METADATA_SQL)
def supplier_metadata(spark, sf):
    p = catalog.supplier_pages(spark, sf)
    m = D.metadata_table(p)
    keys = ["title", "byline", "excerpt", "site_name", "published_time"]
    return m.select("page_id", *keys)


@query(catalog.STORY_SQL)
def supplier_articles(spark, sf):
    opt = Options(footer="{author} / {siteName} / {date} / {excerpt}")
    r = article_markdown(catalog.story_pages(spark, sf), opt)
    return r.select("page_id", "markdown")


@query(catalog.FRAMES_SQL)
def framed_pages(spark, sf):
    r = convert(catalog.framed_pages(spark, sf), Options(scope="fullPage", metadata=False))
    return r.select("page_id", "markdown")


@query(catalog.WARNINGS_SQL)
def frame_warnings(spark, sf):
    w = iframe_warnings(frame_docs(catalog.framed_pages(spark, sf)))
    return w.select("page_id", "type", "count", F.to_json("details").alias("details"))


@query(f"""
  SELECT p.page_id, {_TITLE} AS title FROM pages p
  WHERE {_TITLE} = trim({_decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")})
""")
def titles_in_headings(spark, sf):
    html = F.col("html")
    t = pages(spark, sf).select("page_id", D.document_title(html).alias("title"), D.heading_texts(html).alias("hs"))
    return t.filter(F.exists("hs", lambda h: X.trim_ws(h) == F.col("title"))).drop("hs")


@query("""
  SELECT tag, depth, ancestor, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(html, '<(div|nav|article|footer|ul|li|a|h1|p|b)[ >]', 1)) AS tag FROM pages)
  JOIN (VALUES ('div', 1, 'body'), ('nav', 1, 'body'), ('article', 1, 'body'), ('footer', 1, 'body'), ('ul', 1, 'nav'), ('ul', 2, 'body'),
    ('li', 1, 'ul'), ('li', 2, 'nav'), ('li', 3, 'body'), ('a', 1, 'li'), ('a', 2, 'ul'), ('a', 3, 'nav'), ('h1', 1, 'article'), ('h1', 2, 'body'),
    ('p', 1, 'article'), ('p', 2, 'body'), ('b', 1, 'p'), ('b', 2, 'article'), ('b', 3, 'body')) v(tag, depth, ancestor) USING (tag) GROUP BY ALL
""")
def list_ancestors(spark, sf):
    """How often an element of each kind has which kind of element one to three levels above it."""
    a = N.ancestors(T.page_nodes(pages(spark, sf)), 3)
    return a.groupBy("tag", "depth", "ancestor").agg(F.count("*").alias("n"))


# the walk along a text, one token a step; ranks are lengths, so the longest known string counts
@query("""
  WITH RECURSIVE words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark) WHERE w <> ''),
  v AS (SELECT hex(w) AS b FROM words UNION SELECT hex(' ' || w) FROM words),
  sizes AS (SELECT DISTINCT length(b) AS l FROM v),
  t AS (SELECT item_id, hex(text) AS h FROM benchmark),
  spots AS (SELECT item_id, h, unnest(range(0, length(h) // 2)) AS place FROM t),
  best AS (SELECT item_id, place, max(l) // 2 AS jump FROM (
      SELECT item_id, place, l, substr(h, 2 * place + 1, l) AS b FROM spots, sizes WHERE 2 * place + l <= length(h)) JOIN v USING (b)
    GROUP BY item_id, place),
  walk AS (
    SELECT item_id, CAST(0 AS BIGINT) AS place, 0 AS n, length(h) // 2 AS size FROM t
    UNION ALL
    SELECT walk.item_id, walk.place + coalesce(jump, 1), n + 1, size FROM walk LEFT JOIN best USING (item_id, place) WHERE walk.place < size)
  SELECT item_id, CAST(max(n) AS BIGINT) AS token_count FROM walk GROUP BY item_id
""")
def vocabulary_counts(spark, sf):
    """Counts by a vocabulary made of the words of the texts, with and without a space."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    pieces = F.concat(words, F.transform(words, lambda w: F.concat(F.lit(" "), w)))
    raw = table(spark, sf, "benchmark").select(F.explode(pieces).alias("w")).distinct()
    vocab = raw.select(
        F.lit("words").alias("encoding"), F.hex(F.encode("w", "UTF-8")).alias("bytes"),
        F.octet_length("w").alias("n_bytes"), F.octet_length("w").cast("bigint").alias("rank"))
    return token_count_vocab(table(spark, sf, "benchmark"), vocab, "item_id", "text", "words")


@query(f"""
  SELECT CAST(page_id AS BIGINT) AS page_id, {_estimate('html')} AS token_count,
    {_STATUS.format(c=_estimate('html'), l='4096')} AS status FROM pages
""")
def streamed_counts(spark, sf):
    """The pages as a stream: counted by a stateless query, read back from its sink."""
    folder = work_folder(spark)
    stream = read_page_stream(spark, sf, PAGES_FOUND)
    count_stream(stream, "html", f"{folder}/out", f"{folder}/state", 4096).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "token_count", "budget.status")


@query(f"""
  WITH e AS (SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n FROM pages)
  SELECT page_id, CAST(n AS BIGINT) AS n_elements, n > 40 AS large FROM e
""")
def size_guard(spark, sf):
    return T.size_report(pages(spark, sf), 40).select("page_id", "n_elements", "large")


@query(f"""
  SELECT count(*) AS n_files, 'export-2026-01-31-' || count(*) || 'tabs' AS export_name, CAST(NULL AS VARCHAR) AS error
  FROM conversations WHERE length(text) >= 200
""")
def export_names(spark, sf):
    c = table(spark, sf, "conversations").select((F.length("text") >= 200).alias("success"))
    return B.export_manifest(c, "2026-01-31")


# ---------------------------------------------------------------- options, sinks and streams


@query("""
  WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host, regexp_extract(url, '^([^?#]*/)', 1) AS dir FROM pages)
  SELECT page_id, dir || 'small/' || page_id || '.png 480w, ' || host || '/large.png 2x' AS srcset FROM u
""")
def srcset_links(spark, sf):
    given = F.concat(F.lit("small/"), F.col("page_id"), F.lit(".png 480w, /large.png 2x"))
    return pages(spark, sf).select("page_id", U.absolutize_srcset(given, F.col("url")).alias("srcset"))


@query(f"""
  SELECT page_id, {_MIXED} AS url FROM pages
  WHERE page_id % 3 = 0 AND NOT regexp_matches({_MIXED}, '^(chrome://|edge://|about:|chrome-extension://|moz-extension://)')
""")
def kept_batch(spark, sf):
    """Pages that a list names twice, without those of the browser."""
    mixed = pages(spark, sf).withColumn("url", F.expr(_MIXED))
    keep = pages(spark, sf).filter("page_id % 3 = 0").select("page_id")
    return select_batch(mixed, keep.unionAll(keep)).select("page_id", "url")


# ticks in front, and one in the middle: the mark is the shortest that differs from both
@query("""
  WITH t AS (SELECT doc_id, doc_id % 4 AS k, repeat('`', CAST(doc_id % 4 AS INT)) || regexp_replace(text, '\\r?\\n|\\r', ' ', 'g') || '`e' AS flat FROM documents),
  m AS (SELECT *, repeat('`', CASE WHEN k = 2 THEN 3 ELSE 2 END) AS mark, CASE WHEN k > 0 THEN ' ' ELSE '' END AS pad FROM t)
  SELECT doc_id, mark || pad || flat || pad || mark AS code, CASE WHEN k = 3 THEN 4 ELSE 3 END AS fence FROM m
""")
def inline_codes(spark, sf):
    ticks = F.repeat(F.lit("`"), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(ticks, F.col("text"), F.lit("`e"))
    return table(spark, sf, "documents").select("doc_id", X.inline_code(text).alias("code"), X.fence_size(text).alias("fence"))


@query("""
  SELECT source || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.md' AS file_name, text AS content
  FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents WHERE length(text) >= 200)
""")
def exported_files(spark, sf):
    """A batch of results written as files with their manifest, and read back."""
    d = table(spark, sf, "documents")
    results = d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("markdown"),
                       (F.length("text") >= 200).alias("success"))
    folder = work_folder(spark)
    write_export(results, folder, "2026-01-31")
    return spark.read.parquet(f"{folder}/files").select("file_name", "content")


@query(f"SELECT CAST(page_id AS BIGINT) AS page_id, markdown, token_count FROM ({'WITH ' + _PARTS + _FULL_PAGE})")
def streamed_pages(spark, sf):
    """The pages as a stream: each batch converted by the batch job, read back from its folders."""
    folder = work_folder(spark)
    stream = read_page_stream(spark, sf, PAGES_FOUND)
    convert_stream(stream, f"{folder}/out", f"{folder}/state", Options(scope="fullPage")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "markdown", "token_count")


@query(f"SELECT CAST(page_id AS BIGINT) AS page_id, url, markdown, token_count FROM ({'WITH ' + _PARTS + _FULL_PAGE})")
def streamed_versions(spark, sf):
    """Drafts of all pages arrive on a stream, then the pages themselves, after a restart: the later version of each page counts."""
    folder = work_folder(spark)
    p = pages(spark, sf).select("page_id", "url", "html")
    draft = p.withColumn("html", F.concat(F.lit("<title>Draft</title><p>"), F.col("page_id"), F.lit("</p>")))
    for version in (draft, p):
        version.write.mode("append").parquet(f"{folder}/in")
        stream = read_page_stream(spark, f"{folder}/in")
        convert_stream(stream, f"{folder}/out", f"{folder}/state", Options(scope="fullPage")).awaitTermination()
    return newest(spark, f"{folder}/out").select("page_id", "url", "markdown", "token_count")


# the bold first words of every page but each fifth, which has no selection
@query(f"""
  SELECT page_id, url, page_id * 2 AS ord, page_id % 5 <> 0 AS success, CASE WHEN page_id % 5 <> 0 THEN '# ' || title || {_GAP} || 'Picked **'
      || page_id || '** here.' || {_GAP} || '---' || {_NL} || 'Source: [' || title || '](' || url || ')' END AS markdown,
    CASE WHEN page_id % 5 = 0 THEN 'NO_SELECTION' END AS error_code
  FROM (SELECT page_id, url, {_TITLE} AS title FROM pages)
""")
def selected_fragments(spark, sf):
    p = pages(spark, sf).withColumn("ord", F.col("page_id") * 2)
    text = F.concat(F.lit("<p>Picked <b>"), F.col("page_id"), F.lit("</b> here.</p>"))
    picked = p.filter("page_id % 5 <> 0").select("page_id", text.alias("fragment_html"))
    return convert(p, Options(scope="selection"), picked).select("page_id", "url", "ord", "success", "markdown", "error_code")
