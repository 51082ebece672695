"""Conversion of pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webquarry.operators.budget import token_columns
from webquarry.options import DEFAULT_CONTEXT_LIMIT, Options
from webquarry.plans.convert import convert

PAGES = "page_id bigint, url string, html string"


def read_page_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Pages from the Parquet files of a folder; with ``glob``, of what is in it under such names, files or folders of files."""
    return spark.readStream.schema(PAGES).parquet(f"{path}/{glob}" if glob else path)


def convert_stream(pages: DataFrame, path: str, checkpoint: str, opt: Options = Options()) -> StreamingQuery:
    """Convert each batch of arriving pages with the batch job; results under ``batch=<id>``.

    A batch that runs again after a failure writes the same folder again, so each page is
    there once. Frames are looked for among the pages of their batch. ``newest`` reads the results
    without the pages that came again later.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        convert(batch, opt).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def newest(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """The results of ``convert_stream`` with each page in its latest version only.

    Of the rows of one key those of the last batch that holds it stay, all of them, also if it failed there; rows without a key
    all stay. Only keys that came again are joined, without their texts: a broadcast by Spark's own size check if they are few, a shuffle
    otherwise. The set of batches gathered for a key is no longer than there are batches.
    """
    rows = spark.read.parquet(path)
    held = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("batch").alias("held"))
    older = F.array_remove("held", F.array_max("held"))
    older = held.filter(F.size("held") > 1).select(key, F.explode(older).alias("batch"))
    return rows.join(older, [key, "batch"], "left_anti").drop("batch")


def count_stream(texts: DataFrame, column: str, path: str, checkpoint: str,
                 limit: int = DEFAULT_CONTEXT_LIMIT) -> StreamingQuery:
    """Token counts and budget status of arriving texts: a projection, no state."""
    return (
        token_columns(texts, column, limit).drop(column).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
