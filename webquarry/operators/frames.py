"""Frames inside pages: documents of the same origin are put in, others leave a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.functions import markup as M
from webquarry.functions import text as X
from webquarry.functions import urls as U
from webquarry.options import Options

FRAME = r"""(?is)(<iframe\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)(?:[^<]*</iframe\s*>)?"""


# comments, scripts and styles: what looks like a frame in them is none
UNSEEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def page_frames(pages: DataFrame) -> DataFrame:
    """One row per frame: ``page_id, frame, tok, src, srcdoc, title, sandboxed``; addresses follow the page's ``base``."""
    html = F.regexp_replace("html", UNSEEN, "")
    base = X.decode_entities(M.own("href", F.regexp_extract(html, r"(?i)(<base\b[^>]*\shref\s*=[^>]*>)", 1)))
    pages = pages.withColumn("base", F.when(base != "", U.absolutize(base, F.col("url"))).otherwise(F.col("url")))
    rows = pages.select(
        "page_id", F.col("url").alias("page_url"), "base",
        F.posexplode(F.regexp_extract_all(html, F.lit(FRAME), F.lit(1))).alias("frame", "tok"))
    src = X.decode_entities(M.own("src"))
    title = F.coalesce(F.nullif(M.own("title"), F.lit("")), F.nullif(M.own("aria-label"), F.lit("")),
                       F.lit("Embedded content"))
    return rows.select(
        "page_id", "page_url", "frame", "tok",
        F.when(src != "", U.absolutize(src, F.col("base"))).alias("src"),
        F.nullif(X.decode_entities(M.own("srcdoc")), F.lit("")).alias("srcdoc"),
        X.decode_entities(title).alias("title"), M.has_attr("sandbox").alias("sandboxed"),
        M.own("style").rlike(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden").alias("hidden"),
    )


def address(url: Column) -> Column:
    """An address without fragment, host in lower case and without the default port, as a key."""
    return F.regexp_replace(U.absolutize(url, url), "#.*$", "")


def is_remote(src: Column) -> Column:
    return F.coalesce((src != "") & ~src.isin("about:blank", "javascript:void(0)"), F.lit(False))


def frame_body(html: Column) -> Column:
    inner = F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>|</body\s*>.*$", "")
    return F.regexp_replace(
        inner, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|"
        r"<noscript\b[^>]*>.*?</noscript\s*>", "")


def join_frames(frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``body`` (what to put in; null if not of the same origin) and ``kind``.

    The document of a frame is the page whose address, without fragment, is the frame's: an equality
    join. Only pages that a frame of their origin asks for take part with their HTML, each once.
    """
    same = U.origin(F.col("src")) == U.origin(F.col("page_url"))
    frames = frames.withColumn("_key", F.when(same & ~F.col("sandboxed") & F.col("srcdoc").isNull(), address(F.col("src"))))
    wanted = frames.filter("_key IS NOT NULL").select("_key").distinct()
    own = pages.withColumn("_key", address(F.col("url"))).join(wanted, "_key", "left_semi")
    docs = own.groupBy("_key").agg(F.min_by("html", F.struct("page_id", F.xxhash64("html"))).alias("doc"))
    # a null key joins nothing and, as the left side of a join, is dealt to no single task by adaptive execution
    known = frames.filter("_key IS NOT NULL").join(docs, "_key", "left")
    rest = frames.filter("_key IS NULL").withColumn("doc", F.lit(None).cast("string"))
    df = known.select(*frames.columns, "doc").unionByName(rest).drop("_key")
    inner = F.when(~F.col("sandboxed"), F.coalesce(
        "srcdoc", F.when(same & F.col("doc").isNotNull(), F.col("doc"))))
    df = df.withColumn("body", frame_body(inner))
    empty = F.col("hidden") & F.col("src").isNull() & F.col("srcdoc").isNull()
    kind = (
        F.when(empty, F.lit("hidden"))
        .when(F.col("body").isNotNull(), F.lit("inlined"))
        .when(same | F.col("srcdoc").isNotNull(), F.lit("skipped"))
        .when(is_remote(F.col("src")), F.lit("crossOrigin"))
        .otherwise(F.lit("skipped"))
    )
    df = df.withColumn("kind", kind).drop("doc", "hidden")
    return df.withColumn("body", F.when(F.col("kind") == "inlined", F.col("body")))


def frame_placeholder(src: Column, title: Column) -> Column:
    def safe(c):
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                                   F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    link = F.concat(F.lit('<a href="'), safe(src), F.lit('">'), safe(title), F.lit("</a>"))
    inner = F.when(U.is_http_url(src), link).otherwise(safe(title))
    return F.concat(F.lit("<div><p>[Embedded content: "), inner, F.lit("]</p></div>"))


def iframe_warnings(frames: DataFrame) -> DataFrame:
    """Cross-origin frames of each page: type, count and what they are."""
    far = frames.filter(F.col("kind") == "crossOrigin")
    return far.groupBy("page_id").agg(
        F.lit("crossOriginIframe").alias("type"), F.count("*").alias("count"),
        F.transform(F.array_sort(F.collect_list(F.struct("frame", "src", "title"))),
                    lambda f: F.struct(f["src"].alias("src"), f["title"].alias("title"))).alias("details"))


def place_frames(pages: DataFrame, frames: DataFrame, opt: Options) -> DataFrame:
    """Pages with their frames replaced (whole page) or put at the end (article).

    Adds ``frame_count``, the number of cross-origin frames. The frames of a page come from the
    one row of that page, so gathering them again is bounded by it.
    """
    inlined = F.col("kind") == "inlined"
    shown = F.coalesce(F.col("src"), F.col("srcdoc"))
    if opt.scope == "mainContent":
        order = Window.partitionBy("page_id").orderBy("frame")
        number = F.sum(inlined.cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        part = F.when(inlined, F.concat(
            F.lit("<div><hr><h3>Embedded Content "), number.cast("string"), F.lit("</h3><div>"),
            F.col("body"), F.lit("</div></div>")))
    else:
        place = frame_placeholder(shown, F.col("title")) if opt.iframe_links else F.lit("")
        has = F.coalesce(shown, F.lit("")) != ""
        part = F.when(inlined, F.concat(F.lit("<div>"), F.col("body"), F.lit("</div>"))).when(
            has & (shown != "about:blank"), place).otherwise(F.lit(""))
    per_page = frames.withColumn("part", part).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("frame", "part"))).alias("parts"),
        F.count_if(F.col("kind") == "crossOrigin").alias("frame_count"))
    df = pages.join(per_page, "page_id", "left")
    if opt.scope == "mainContent":
        return df.withColumns({
            "appended": F.concat_ws("", F.transform("parts", lambda p: p["part"])),
            "html": F.regexp_replace("html", FRAME, "")}).drop("parts")
    plain = F.regexp_replace("html", UNSEEN, "")
    around = F.split(plain, FRAME)
    filled = F.array_join(F.transform(
        around, lambda t, i: F.concat(t, F.coalesce(F.get(F.col("parts"), i)["part"], F.lit("")))), "")
    return df.withColumn("html", F.when(F.col("parts").isNotNull(), filled).otherwise(F.col("html"))).drop("parts")


def frame_docs(pages: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The frames of all pages with the documents that can be put in, taken from ``docs`` or the pages themselves."""
    return join_frames(page_frames(pages), pages if docs is None else docs)
