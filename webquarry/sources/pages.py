"""Page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from Parquet: ``page_id, url, html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per HTML file; its address is the path of the file."""
    files = spark.read.text(path, wholetext=True)
    url = F.input_file_name()
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def select_batch(pages: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Pages of a batch: those in ``keep(page_id)`` that are no browser pages."""
    from webquarry.functions.urls import is_convertible_url

    out = pages.filter(is_convertible_url(F.col("url")))
    return out if keep is None else out.join(keep.select("page_id").distinct(), "page_id", "left_semi")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabularies from JSON lines ``{"encoding": …, "bytes": "104,105", "rank": 1}``.

    Result: ``encoding, bytes (hex), n_bytes, rank``.
    """
    raw = spark.read.schema("encoding string, bytes string, rank bigint").json(path)
    return vocab_table(raw)


def vocab_table(raw: DataFrame) -> DataFrame:
    """From decimal byte lists to hex keys; the last rank given for a key counts once."""
    parts = F.split("bytes", ",")
    hexed = F.array_join(F.transform(parts, lambda b: F.lpad(F.hex(b.cast("int")), 2, "0")), "")
    return raw.select(
        "encoding", hexed.alias("bytes"), F.size(parts).alias("n_bytes"), F.col("rank").cast("bigint")
    ).groupBy("encoding", "bytes", "n_bytes").agg(F.max("rank").alias("rank"))


def scope_fragment(pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """Convert only a supplied fragment of each page; ``error`` where it is blank or there is none.

    ``fragments(page_id, fragment_html)``. Title and address stay those of the page.
    """
    from webquarry.functions import constants as C
    from webquarry.functions import text as X

    both = pages.join(fragments, "page_id", "left")
    head = F.regexp_extract("html", r"(?is)(<title\b[^>]*>.*?</title\s*>)", 1)
    blank = X.trim_ws(F.regexp_replace("fragment_html", "<[^>]*>", "")) == ""
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"),
                    F.coalesce("fragment_html", F.lit("")), F.lit("</body></html>"))
    return both.select(
        "page_id", "url", *[c for c in pages.columns if c == "ord"], html.alias("html"),
        F.when(F.coalesce(blank, F.lit(True)), F.lit(C.NO_SELECTION)).alias("error"),
    )
