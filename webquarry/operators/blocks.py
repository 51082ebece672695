"""Text runs gathered under their nearest block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.functions import text as X
from webquarry.operators.tokens import PAGE, running


def text_blocks(nodes: DataFrame, by=PAGE) -> DataFrame:
    """One row per run of text between two block boundaries: ``by…, block, text``."""
    df = nodes.filter(F.col("kind") != "raw")
    edge = F.col("tag").isin(C.MD_BLOCKS) & (F.col("kind") != "text")
    df = df.withColumn("block", F.sum(F.coalesce(edge, F.lit(False)).cast("int")).over(running(by, "ord")))
    runs = df.filter("kind = 'text'").withColumn("t", X.decode_entities(F.col("tok")))
    out = runs.groupBy(*by, "block").agg(F.expr("listagg(t) WITHIN GROUP (ORDER BY ord)").alias("t"))
    clean = F.regexp_replace(F.btrim("t", F.lit(" \t\r\n")), "[ \t\r\n]+", " ")
    return out.select(*by, "block", clean.alias("text")).filter("text <> ''")
