"""The conversion job: options in, one result row per page out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import text as X
from webquarry.functions import urls as U
from webquarry.operators.frames import frame_docs, place_frames
from webquarry.operators.prune import clean
from webquarry.operators.render import render
from webquarry.operators.tokens import keyed, page_nodes, restored
from webquarry.options import Options
from webquarry.plans.article import articles
from webquarry.plans.full_page import full_pages
from webquarry.sources.pages import scope_fragment


def convert(pages: DataFrame, opt: Options = Options(), fragments: DataFrame | None = None) -> DataFrame:
    """Convert pages to Markdown, with the documents of their frames: in place, or at the end of an article.

    ``page_id, url, title, success, markdown, token_count, error_code, error_detail``, and ``ord`` if the pages
    have one. Pages that cannot be converted stay as rows with ``success = false``. Pages with repeated or no ids each have their row.
    """
    given = pages
    if opt.scope == "selection":
        if fragments is None:
            raise ValueError("the selection scope needs fragments(page_id, fragment_html)")
        pages = scope_fragment(pages, fragments)
    else:
        pages = pages.withColumn("error", F.lit(None).cast("string"))
    bad = pages.filter(F.col("error").isNotNull())
    good = keyed(pages.filter(F.col("error").isNull()).drop("error"), opt.html_tokens)
    done = restored(_converted(good, given, opt, fragments if opt.scope == "selection" else None), given, opt.html_tokens)
    failed = bad.select(
        "page_id", "url", *[c for c in bad.columns if c == "ord"], F.lit(None).cast("string").alias("title"), F.lit(False).alias("success"),
        F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("bigint").alias("token_count"),
        X.classify_error(F.col("error")).alias("error_code"), F.col("error").alias("error_detail"))
    return done.unionByName(failed, allowMissingColumns=True)


def _converted(pages: DataFrame, given: DataFrame, opt: Options, fragments: DataFrame | None = None) -> DataFrame:
    # only pages with a frame are joined with anything before they are taken apart; a look for the first of them, which ends
    # with it, spares a table without any half of the plan
    framed = F.coalesce(F.col("html").rlike(r"(?i)<iframe\b"), F.lit(False))
    source = given if fragments is None else fragments.withColumnRenamed("fragment_html", "html")
    if source.filter(framed).isEmpty():
        return articles(pages, opt) if opt.scope == "mainContent" else full_pages(pages, opt)
    placed = place_frames(pages.filter(framed), frame_docs(pages.filter(framed), given), opt)
    plain = pages.filter(~framed)
    if opt.scope != "mainContent":
        notes = placed.select("page_id", F.lit("").alias("appended"), "frame_count")
        return full_pages(plain.unionByName(placed.drop("frame_count")), opt, notes)
    ends = placed.filter("appended <> ''").select("page_id", "url", F.col("appended").alias("html"))
    more = render(clean(page_nodes(ends), opt), opt).select("page_id", F.col("markdown").alias("appended"))
    notes = placed.select("page_id", "frame_count").join(more, "page_id", "left")
    return articles(plain.unionByName(placed.drop("frame_count", "appended")), opt, notes)


def flag_lazy(pages: DataFrame, hosts=None) -> DataFrame:
    """``is_lazy, reason``: a known host, else a container that loads while scrolling."""
    from webquarry.functions import constants as C

    host = U.matched_host(U.hostname(F.col("url")), hosts or C.LAZY_HOSTS)
    semantic = F.col("html").rlike(
        r"""(?i)<[a-z][^>]*\s(role\s*=\s*["']?(log|feed)["'\s>]|data-conversation[\s=>]|data-virtual[\s=>]|"""
        r"""data-test-id\s*=\s*["']?[^"'>]*conversation)""")
    reason = F.when(host.isNotNull(), F.concat(F.lit("host:"), host)).when(semantic, F.lit("semantic"))
    return pages.select("page_id", "url", reason.isNotNull().alias("is_lazy"), reason.alias("reason"))
