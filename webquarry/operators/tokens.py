"""HTML decoded into rows: the token stream and its balanced form.

A page is one row, so the stream is a Generate over it. ``repartition`` on the page comes
before the explode: all later windows and group-bys on the page reuse that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.functions import markup as M
from webquarry.functions import text as X
from webquarry.functions import urls as U

PAGE = ["page_id"]
END = 2_147_483_647


def win(by, *order):
    spec = Window.partitionBy(*by)
    return spec.orderBy(*order) if order else spec


def running(by, *order):
    return win(by, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(value: Column, by, order="ord") -> Column:
    """The nearest earlier ``value`` that is not null."""
    return F.last(value, ignorenulls=True).over(
        win(by, order).rowsBetween(Window.unboundedPreceding, -1)
    )


def after(name: str, by, order="ord") -> Column:
    """The nearest later value of the column ``name`` that is not null."""
    return F.expr(
        f"lead({name}) IGNORE NULLS OVER (PARTITION BY {', '.join(by)} ORDER BY {order})"
    )


def _token_kind(tok: Column, tag: Column) -> Column:
    return (
        F.when(~tok.startswith("<"), F.lit("text"))
        .when(tok.startswith("<!--"), F.lit("comment"))
        .when(tok.rlike("^<[!?]"), F.lit("doctype"))
        .when(tok.rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>$"), F.lit("raw"))
        .when(tok.rlike("^</[a-zA-Z]"), F.lit("close"))
        .when(tok.rlike("^</"), F.lit("comment"))
        .when(tok.rlike("^<[a-zA-Z]"),
              F.when(tag.isin(C.VOID_TAGS), F.lit("void")).otherwise(F.lit("open")))
        .otherwise(F.lit("text"))
    )


def split_html(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(M.TOKEN), F.lit(0))


def html_tokens(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per comment, doctype, script, style, tag or text run, in document order; ``keep`` are columns of the page."""
    rows = pages.select("page_id", *keep, F.posexplode(split_html(F.col("html"))).alias("pos", "tok"))
    rows = rows.withColumn("tag", M.tag_name(F.col("tok")))
    return rows.withColumn("kind", _token_kind(F.col("tok"), F.col("tag"))).select(
        "page_id", "pos", "kind", "tag", "tok", *keep
    )


def element_count(html: Column) -> Column:
    """Elements of a page, counted on the unexploded row."""
    return F.regexp_count(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit("<[a-zA-Z]"))


def size_report(pages: DataFrame, limit: int) -> DataFrame:
    """Add ``n_elements`` and ``large``: more elements than ``limit`` (0 = no limit). No page fails by its size."""
    n = element_count(F.col("html")).cast("long")
    return pages.withColumn("n_elements", n).withColumn("large", (F.col("n_elements") > limit) & F.lit(limit > 0))


def tag_attrs(tokens: DataFrame) -> DataFrame:
    """Opening tags with their attribute map and class+id match string."""
    opens = tokens.filter(F.col("kind").isin("open", "void"))
    attrs = opens.withColumn("attrs", M.attrs_map(F.col("tok")))
    return attrs.select(
        "page_id", "pos", "tag", "attrs",
        M.match_string(F.try_element_at("attrs", F.lit("class")),
                       F.try_element_at("attrs", F.lit("id"))).alias("match_string"),
    )


def drop_scripts(tokens: DataFrame) -> DataFrame:
    """Drop script and style elements, which are one token each."""
    return tokens.filter(F.col("kind") != "raw")


# ---------------------------------------------------------------- balanced stream

_ITEM_ENDS = {
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "td": "td th tr tbody thead tfoot".split(),
    "th": "td th tr tbody thead tfoot".split(),
    "tr": "tr tbody thead tfoot".split(),
    "tbody": "tbody thead tfoot".split(),
    "thead": "tbody thead tfoot".split(),
    "tfoot": "tbody thead tfoot".split(),
    "option": "option optgroup".split(),
}


def _body_start(toks: Column) -> Column:
    """How many tokens come before the body: up to ``<body>``, ``</head>`` or ``</title>``."""

    def place(pattern: str) -> Column:
        return F.nullif(
            F.array_position(F.transform(toks, lambda t: t.rlike(pattern)), F.lit(True)), F.lit(0)
        )

    return F.coalesce(
        place(r"(?i)^<body\b"), place(r"(?i)^</head\b"), place(r"(?i)^</title\b"), F.lit(0)
    ).cast("int")


_OUTSIDE = r"(?i)^(<!|<\?|</[^a-zA-Z]|</?(html|head|body)\b)"


def keyed(pages: DataFrame, html_tokens: bool = False) -> DataFrame:
    """Pages with a ``page_id`` of their own, 16 bytes made once from id, address and HTML, and ``ref``, what to give back at the end.

    Crawls repeat pages, and ids may repeat or be missing: pages that differ in anything are kept apart from here on, and equal
    ones are converted once, with their number. This groups the raw pages in the one exchange that the conversion of a small table needs. ``restored``
    brings the given ids back. Pages that have a key keep it.
    """
    if "ref" in pages.columns:
        return pages
    number = F.col("ord") if "ord" in pages.columns else F.lit(None)
    row = [F.col("page_id").cast("string").alias("id"), number.cast("string").alias("ord"), F.col("url").alias("url"), F.col("html").alias("html")]
    key = [F.lpad(F.hex(F.xxhash64(F.to_json(F.struct(*row[:3])), "html", F.lit(k))), 16, "0") for k in (0, 1)]
    one = pages.groupBy(F.unhex(F.concat(*key)).alias("page_id")).agg(F.first(F.struct(*row)).alias("p"), F.count("*").alias("copies"))
    tokens = X.token_estimate(F.col("p.html")) if html_tokens else F.lit(None).cast("bigint")
    ref = F.struct(F.col("p.id").alias("id"), F.col("p.ord").alias("ord"), F.col("copies").alias("copies"), tokens.alias("html_tokens"))
    one = one.select("page_id", F.col("p.url").alias("url"), F.col("p.html").alias("html"), F.to_json(ref).alias("ref"))
    # copies are counted before the exchange, so a page that a crawl holds very often fills no task; large tables are dealt out by size after it
    n = partitions_for(pages)
    return one.repartition(n, "page_id") if n else one


REF = "struct<id:string,ord:string,copies:bigint,html_tokens:bigint>"


def restored(done: DataFrame, pages: DataFrame, html_tokens: bool = False) -> DataFrame:
    """A row for each of the given pages, with the ids (and ``ord``) that they had."""
    r = F.col("_r")
    done = done.withColumn("_r", F.from_json("ref", REF)).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), r["copies"].cast("int"))))
    done = done.withColumn("page_id", r["id"].cast(pages.schema["page_id"].dataType))
    if "ord" in pages.columns:
        done = done.withColumn("ord", r["ord"].cast(pages.schema["ord"].dataType))
    if html_tokens:
        done = done.withColumn("html_tokens", r["html_tokens"])
    return done.drop("_r", "_copy", "ref")


#: Bytes of HTML for one task. Its rows are several times as large and sorted once or more a step, so a task's memory hangs on this number alone.
TASK_BYTES = 8 << 20


def partitions_for(pages: DataFrame) -> int | None:
    """So many partitions that none has much more than ``TASK_BYTES`` of HTML; none for a few times that, which adaptive execution deals out.

    Reads the HTML once more, for its length. Adaptive execution alone would fill partitions up to its advisory size, compressed, however
    many sorts the rows go through.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    if total <= 4 * TASK_BYTES:
        return None
    return max(-(-total // TASK_BYTES), pages.sparkSession.sparkContext.defaultParallelism)


def spread(pages: DataFrame, by=PAGE) -> DataFrame:
    """Spread the pages by key, before anything is exploded, in partitions by the size of the HTML; keyed ones are spread already."""
    if "ref" in pages.columns:
        return pages
    n = partitions_for(pages)
    return pages.repartition(n, *by) if n else pages.repartition(*by)


# what a row of the stream carries besides its place
FIELDS = ["kind", "tag", "tok", "url", "label", "hint"]


def page_stream(pages: DataFrame, by=PAGE, extra: dict[str, Column] | None = None,
                spread_out: bool = True, lazy: bool = False) -> DataFrame:
    """Body tokens of every page, with what the page itself says on its first row.

    ``pages`` needs ``by…, url, html``. Comments and the head of the page are dropped inside the
    array, so they never become rows. ``head`` is JSON (``HEAD``) and ``extra`` are further
    strings computed from a page; all columns are plain strings, which keeps sorting cheap.
    ``url`` is the absolute address of a link or image, ``label`` its alternative text and
    ``hint`` its title.
    """
    html = F.col("html")
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    body_tok = F.regexp_extract(html, r"(?is)(<body\b[^>]*>)", 1)
    base_tok = F.regexp_extract(html, r"(?is)(<base\b[^>]*>)", 1)
    if spread_out:
        pages = spread(pages, by)
    toks = F.col("toks")
    inside = F.filter(
        F.slice(toks, F.col("start") + 1, F.greatest(F.size(toks) - F.col("start"), F.lit(0))),
        lambda t: ~t.rlike(_OUTSIDE),
    )
    own_base = M.own("href", base_tok)
    ref = F.col("ref") if "ref" in pages.columns else F.lit(None).cast("string")
    page = pages.select(
        *by,
        F.struct(F.col("url"), title.alias("title"),
                 F.regexp_extract(html, r"(?is)(<html\b[^>]*>)", 1).alias("html_tok"), ref.alias("ref")).alias("head"),
        F.when(own_base != "", U.absolutize(own_base, F.col("url"))).otherwise(F.col("url")).alias("base"),
        body_tok.alias("body_tok"),
        split_html(F.coalesce(html, F.lit(""))).alias("toks"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    ).withColumn("start", _body_start(toks))
    once = ["body_tok", *(extra or {})]
    rows = page.select(
        *by, F.to_json("head").alias("head"), "base", *once, F.posexplode_outer(inside).alias("pos", "tok"),
    )
    first = F.coalesce("pos", F.lit(0)) == 0
    rows = rows.select(
        *by, F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("tok", F.lit("")).alias("tok"),
        *[F.when(first, F.col(c)).alias(c) for c in ["head", *once]], "base",
    ).withColumn("tag", M.tag_name(F.col("tok")))
    rows = rows.withColumn("kind", _token_kind(F.col("tok"), F.col("tag")))
    if lazy:
        rows = rows.withColumn("tok", F.when(
            F.col("tag").isin("img", "picture"), show_lazy(F.col("tok"))).otherwise(F.col("tok")))
    start, tag = F.col("kind").isin("open", "void"), F.col("tag")
    with_src = tag.isin("img", "iframe")
    given = F.when(start & (tag == "a") & M.has_attr("href"), M.own("href")).when(
        start & with_src & (M.own("src") != ""), M.own("src"))
    titled = F.when(start & (tag.isin("a") | with_src), F.nullif(M.own("title"), F.lit("")))
    label = F.when(start & (tag == "img"), F.nullif(M.own("alt"), F.lit("")))
    rows = rows.withColumns({"url": given, "label": label, "hint": titled})
    if lazy:
        media = start & tag.isin(C.MEDIA_TAGS)
        rows = rows.withColumn("tok", F.when(media, resolved_media(F.col("tok"), F.col("base"))).otherwise(F.col("tok")))
    # few rows have any of them, and what names its argument is interpreted, not compiled
    resolved = {n: F.when(F.col(n).isNotNull(), v) for n, v in {
        "url": U.absolutize(X.decode_entities(F.col("url")), F.col("base")),
        "label": X.decode_entities(F.col("label")),
        "hint": X.decode_entities(F.col("hint")),
    }.items()}
    if lazy:
        # what a figure without an image would show: the first attribute that names one, an address or a source set
        attrs = M.attributes(F.col("tok"))
        named = F.filter(attrs, lambda a: ~a["name"].isin("src", "srcset", "alt") & (a["value"].rlike(C.LAZY_SRCSET) | a["value"].rlike(C.LAZY_SRC)))
        first = F.get(named, 0)["value"]
        figure = start & (tag == "figure")
        resolved["url"] = F.when(figure, F.when(~first.rlike(C.LAZY_SRCSET), U.absolutize(F.btrim(first), F.col("base")))).otherwise(resolved["url"])
        resolved["hint"] = F.when(figure, F.when(first.rlike(C.LAZY_SRCSET), U.absolutize_srcset(first, F.col("base")))).otherwise(resolved["hint"])
    return rows.withColumns(resolved).drop("base")


HEAD = "struct<url:string,title:string,html_tok:string,ref:string>"


def resolved_media(tok: Column, base: Column) -> Column:
    """The source of a media tag with absolute addresses in ``src``, ``poster`` and, each with its descriptor, ``srcset``."""
    for name, resolve in (("src", U.absolutize), ("poster", U.absolutize), ("srcset", U.absolutize_srcset)):
        given = M.own(name, tok)
        value = resolve(X.decode_entities(given), base)
        for sign, written in (("&", "&amp;"), ('"', "&quot;"), ("\\", "\\\\"), ("$", "\\$")):
            value = F.replace(value, F.lit(sign), F.lit(written))
        put = F.regexp_replace(tok, F.lit(M.before_value(name)), F.concat(F.lit(f'$1{name}="'), value, F.lit('"')))
        tok = F.when(given != "", put).otherwise(tok)
    return tok


def shown_by(attrs: Column, srcset: bool) -> Column:
    """The attributes that hold an image's address, or a source set, for later."""
    several = C.LAZY_SRCSET
    return F.filter(attrs, lambda a: ~a["name"].isin("src", "srcset", "alt") & (
        a["value"].rlike(several) if srcset else ~a["value"].rlike(several) & a["value"].rlike(C.LAZY_SRC)))


def show_lazy(tok: Column) -> Column:
    """What a lazily loaded image will show becomes its ``src`` and ``srcset``; of several such attributes the last counts.

    A tiny placeholder in base 64 goes if another attribute names an image; a drawing stays as it is."""
    src, srcset, cls = M.own("src", tok), M.own("srcset", tok), F.lower(M.own("class", tok))
    inline = src.rlike(C.BASE64_URL)
    drawing = src.rlike("(?i)^data:\\s*image/svg\\+xml\\s*;\\s*base64")
    tiny = inline & (F.length(F.regexp_replace(src, C.BASE64_URL, "")) < 133)

    def shown(attrs: Column) -> Column:
        others = F.exists(attrs, lambda a: (a["name"] != "src") & a["value"].rlike(C.IMAGE_NAME))
        gone = tiny & others
        out = F.when(gone, M.without_attr(tok, "src")).otherwise(tok)
        seen = ((src != "") & ~gone) | ~srcset.isin("", "null")
        put = out
        for name in ("src", "srcset"):
            value = F.try_element_at(shown_by(attrs, name == "srcset"), F.lit(-1))["value"]
            put = F.when(value.isNotNull(), M.with_attr(put, name, value)).otherwise(put)
        return F.when(drawing | (seen & ~cls.contains("lazy")), F.when(drawing, tok).otherwise(out)).otherwise(put)

    return X.let(M.attributes(tok), shown)


def balance(rows: DataFrame, by=PAGE, extra=()) -> DataFrame:
    """Give every open element exactly one close, by windows only.

    * the body of the page becomes one element around all rows, open or not in the source;
    * a close without an open is dropped;
    * ``p``, list items and table cells end where the next block or item starts;
    * other unclosed blocks end with their parent, inline elements with their block.

    Result: ``by…, ord``, ``FIELDS`` and ``head`` with kinds open, close, void, text and raw.
    """
    pos, tag, kind = F.col("pos"), F.col("tag"), F.col("kind")
    run = running(by, "pos")

    # 1. pair opens and closes of the same tag
    df = rows.withColumn("step", F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0))
    by_tag = running([*by, "tag"], "pos")
    df = df.withColumn("bal", F.sum("step").over(by_tag))
    earlier = win([*by, "tag"], "pos").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "low": F.least(F.min("bal").over(by_tag), F.lit(0)),
        "low_before": F.least(F.min("bal").over(earlier), F.lit(0)),
    })
    stray = (kind == "close") & (F.col("bal") < F.coalesce("low_before", F.lit(0)))
    depth_of_tag = F.col("bal") - F.col("low") + F.when(kind == "close", 1).otherwise(0)
    df = df.withColumn(
        "pair", F.when(stray, F.lit(-1)).when(kind.isin("open", "close"), depth_of_tag)
    )
    mates = win([*by, "tag", "pair"], "pos")
    df = df.withColumn(
        "mated",
        F.when(kind == "open", F.lead("kind").over(mates) == "close")
        .when(kind == "close", (F.col("pair") > 0) & (F.lag("kind").over(mates) == "open")),
    ).withColumn("mated", F.coalesce("mated", F.lit(False)))

    # 2. containers, and what surrounds each row
    block = tag.isin(C.ENDS_PARAGRAPH)
    counted = block & (tag != "p") & F.col("mated")
    opened, closed = counted & (kind == "open"), counted & (kind == "close")
    block_event = F.coalesce(block, F.lit(False)) & kind.isin("open", "close", "void")
    event = F.when(block_event, F.struct("kind", "tag", "pos"))
    df = df.withColumn("_event", event).withColumns({
        "depth": F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(run),
        "prev_block": before(F.col("_event"), by, "pos"),
        "next_block": after("_event", by, "pos"),
    })
    df = df.withColumn(
        "key", F.col("depth") - F.when(opened, 1).when(closed, -1).otherwise(0)
    )
    in_p = (F.col("prev_block.tag") == "p") & (F.col("prev_block.kind") == "open")
    df = df.withColumn("pid", F.when(in_p, F.col("prev_block.pos")).otherwise(F.lit(-1)))

    level = [*by, "key"]
    ends = sorted({tuple(v) for v in _ITEM_ENDS.values()})
    later = {"parent_end": F.when(closed, pos)} | {
        f"next_{e[0]}": F.when((kind == "open") & tag.isin(list(e)), pos) for e in ends
    }
    df = df.withColumns({f"_{n}": v for n, v in later.items()}).withColumns({
        "inst": F.coalesce(
            F.sum(F.when(closed, 1).otherwise(0)).over(
                win(level, "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        **{n: after(f"_{n}", level, "pos") for n in later},
    })
    item_end = F.lit(None).cast("int")
    for e in ends:
        owners = [t for t, v in _ITEM_ENDS.items() if tuple(v) == e]
        item_end = F.when(tag.isin(owners), F.col(f"next_{e[0]}")).otherwise(item_end)
    df = df.withColumn("item_end", item_end)

    # 3. an inline pair counts only when it stays in one block
    place = F.struct("kind", "key", "inst", "pid")
    df = df.withColumn(
        "mate",
        F.when(kind == "open", F.lead(place).over(mates))
        .when((kind == "close") & (F.col("pair") > 0), F.lag(place).over(mates)),
    )
    same = (
        (F.col("mate.key") == F.col("key")) & (F.col("mate.inst") == F.col("inst"))
        & (F.col("mate.pid") == F.col("pid")) & F.col("mated")
    )
    is_p = tag == "p"
    p_open_ok = (F.col("next_block.tag") == "p") & (F.col("next_block.kind") == "close")
    paired = F.coalesce(
        F.when(is_p & (kind == "open"), p_open_ok)
        .when(is_p & (kind == "close"), F.col("pid") >= 0)
        .when(block, F.col("mated"))
        .otherwise(same),
        F.lit(False),
    )
    block_end = F.coalesce(F.col("next_block.pos"), F.lit(END))
    implied = F.when(
        (kind == "open") & ~paired,
        F.when(is_p, block_end)
        .when(block, F.least(F.coalesce("item_end", F.lit(END)),
                             F.coalesce("parent_end", F.lit(END))))
        .otherwise(block_end),
    )
    df = df.withColumn("paired", paired).withColumn("implied", implied)

    # 4. put the missing closes in
    once = [c for c in df.columns if c in ("head", *extra)]

    def row(at, sub, **new):
        fields = [*FIELDS, *once]
        return F.struct(
            at.cast("long").alias("at"), sub.cast("long").alias("sub"),
            *[new.get(c, F.lit(None)).cast("string").alias(c) for c in fields],
        )

    body = F.array(
        row(F.lit(-1), F.lit(0), kind=F.lit("open"), tag=F.lit("body"), tok=F.col("body_tok"),
            **{c: F.col(c) for c in once}),
        row(F.lit(END), F.lit(2), kind=F.lit("close"), tag=F.lit("body")),
    )
    itself = F.array(row(pos, F.lit(1), **{c: F.col(c) for c in FIELDS}))
    missing = F.array(row(F.col("implied"), -pos - 1, kind=F.lit("close"), tag=tag))
    none = F.slice(itself, 1, 0)
    kept = kind.isin("open", "void", "text", "raw") | ((kind == "close") & F.col("paired"))
    df = df.select(
        *by,
        F.explode(F.concat(
            F.when(pos == 0, body).otherwise(none),
            F.when(kept, itself).otherwise(none),
            F.when(F.col("implied").isNotNull(), missing).otherwise(none),
        )).alias("r"),
    ).select(*by, "r.*")
    df = df.withColumn("ord", F.row_number().over(win(by, "at", "sub")))
    return df.select(*by, "ord", *FIELDS, *once)


def page_nodes(pages: DataFrame, by=PAGE, extra: dict[str, Column] | None = None,
               spread_out: bool = True, lazy: bool = False) -> DataFrame:
    return balance(page_stream(pages, by, extra, spread_out, lazy), by, tuple(extra or ()))


_REOPENED = ["b", "strong", "i", "em"]


def reopen_inline(df: DataFrame, by=PAGE) -> DataFrame:
    """Open unclosed bold and italic elements again in every later block, as a browser does.

    The closes that ``balance`` put in have no source. From each on, the inline content of a
    block is wrapped once per unclosed element.
    """
    run, element = running(by, "ord"), F.col("kind").isin("open", "close", "void")
    edge = F.coalesce(element & F.col("tag").isin(C.ENDS_PARAGRAPH), F.lit(False))
    words = (F.col("kind") == "text") & (X.trim_ws(F.col("tok")) != "")
    content = F.coalesce(~edge & (words | (element & (F.col("tag") != "br"))), F.lit(False))
    implied = (F.col("kind") == "close") & F.col("tok").isNull()
    df = df.withColumns({"_edge": edge, "_content": content, "_tries": F.sum(edge.cast("int")).over(run)} | {
        f"_n_{t}": F.sum((implied & (F.col("tag") == t)).cast("int")).over(run) for t in _REOPENED
    })
    df = df.withColumn("_run", F.when(F.col("_content"), F.col("_tries")))
    df = df.withColumns({"_prev": before(F.col("_run"), by), "_later": after("_run", by)})
    first = F.col("_content") & ~F.coalesce(F.col("_prev") == F.col("_tries"), F.lit(False))
    last = F.col("_content") & ~F.coalesce(F.col("_later") == F.col("_tries"), F.lit(False))
    df = df.withColumns({"_first": first, "_last": last}).withColumns({
        f"_n_{t}": F.last(F.when(F.col("_first"), F.col(f"_n_{t}") - F.when(
            implied & (F.col("tag") == t), 1).otherwise(0)), ignorenulls=True).over(run)
        for t in _REOPENED
    })
    fields = [c for c in df.columns if not c.startswith("_") and c not in by and c != "ord"]

    def row(sub, **new):
        return F.struct(F.col("ord").alias("at"), F.lit(sub).alias("sub"), *[
            new.get(c, F.col(c) if not new else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in fields])

    def marks(kind, tag, sub):
        # equal rows, so their order among themselves does not matter
        return F.array_repeat(row(sub, kind=F.lit(kind), tag=F.lit(tag), tok=F.lit(f"<{tag}>")),
                              F.coalesce(F.col(f"_n_{tag}"), F.lit(0)).cast("int"))

    nothing = F.slice(F.array(row(0)), 1, 0)
    opens = F.concat(*[marks("open", t, -9 + i) for i, t in enumerate(_REOPENED)])
    closes = F.concat(*[marks("close", t, 9 - i) for i, t in enumerate(_REOPENED)])
    rows = F.concat(F.when(F.col("_first"), opens).otherwise(nothing), F.array(row(0)),
                    F.when(F.col("_last"), closes).otherwise(nothing))
    df = df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return df.withColumn("ord", F.row_number().over(win(by, "at", "sub"))).drop("at", "sub")
