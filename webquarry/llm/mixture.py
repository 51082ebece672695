"""Mixing of sources to target weights: capped water-filling and seeded repetitions.

Method. Every source wants its weight's share of all words. A source whose target is over `max_epochs` times its own words is clamped
there, and what it leaves is shared anew by weight among the others, until none is above. A source then repeats each of its documents
floor(target / size) times, and one time more those documents that come first in a seeded order, up to the words that are still missing:
the border lies where the taken words come nearest to the target. Orders are md5 of seed and id, so reruns agree; documents without an id
come last. Documents that share an id are in order of size, then of the text's hash, and the border may fall between any two of them.

Scale. Only sums per source and per (source, one of 4096 seeded buckets) leave the documents, combined before the shuffle; a hot source
is never one group. Inside the one bucket of a source where the border falls, key and size are put in order, each with its number of rows.
Only if the border falls among rows of one key and size are these numbered, by ranges of rows.

Defined results: a null or empty text has no words and is taken with none; a null source is a source of its own, the last; all words
zero: every target is zero; rows that repeat an id are documents like others; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Up to so many sources are sent to every task; more are joined by a shuffle.
SMALL = 50_000


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with i, their place from 0 by code point, null last: ranges of the order, their sizes, and a row number inside each."""
    ranges = common.cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()))
    sizes = ranges.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row for each task's range
    inside = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("_i", inside).join(before, "p").withColumn("i", F.col("_i") + F.col("before")).drop("p", "_i", "before")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """target for each row (source, source_size): sums over all sources are taken again until no more of them are clamped."""
    cycle = F.array(*[F.lit(w) for w in weights])
    known = common.cut(_ranked(sources).withColumn("w", F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int")).cast("long")))
    size, cap = F.col("source_size"), F.col("source_size") * max_epochs
    total = known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    clamped, rest, free, before = F.lit(False), total, 0, -1
    while True:
        row = known.agg(F.count_if(clamped), F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, F.col("w"))), F.lit(0))).first()
        if row[0] == before:
            break
        before, rest, free = row[0], total - row[1], row[2]
        # above: w * rest / free > cap, in whole numbers
        whole = [x.cast("decimal(38,0)") for x in (F.col("w"), F.lit(rest), cap, F.lit(free))]
        clamped = (whole[0] * whole[1] >= whole[2] * whole[3]) if free else F.lit(True)
    share = F.col("w").cast("double") * F.lit(float(rest)) / F.lit(float(free or 1))
    return known.select("source", "source_size", F.when(clamped, cap.cast("double")).otherwise(share).alias("target"))


def _order(doc_id: str):
    """md5 of seed and id; without an id a key that comes after all others."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{SEED}:"), F.col(doc_id).cast("string")).cast("binary")), F.lit("g"))


def _plan(slim: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """source, source_size, target, times, border, border_size, border_rows, split: documents of a source are taken `times` times, and once
    more up to the border, that is below (border, border_size), and border_rows of those at it; split if these are not all."""
    bucket = F.substring("key", 1, 3)
    parts = common.cut(slim.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")))
    targets = water_fill(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("times", whole).withColumn("more", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0)))
    targets = common.cut(targets)
    # the bucket in which the words that are still missing come to an end
    t = targets.select(F.col("source").alias("s"), "more")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))  # 4096 rows a source at most
    bucketed = parts.withColumn("upto", upto).join(t, F.col("source").eqNullSafe(F.col("s")))
    edge = bucketed.where("upto > more and upto - size <= more").select(F.col("s"), F.col("bucket").alias("b"), (F.col("more") - F.col("upto") + F.col("size")).alias("left"))
    inner = slim.join(edge, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b")))
    # rows of one key and size are one row here, with their number
    inner = inner.groupBy("source", "b", "key", "size").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    words = F.col("size") * F.col("n")
    run = F.sum(words).over(Window.partitionBy("source", "b").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    inner = inner.withColumn("room", F.col("left") - run + words)
    # a document is in if more than half of it lies before the end: then the sum comes nearest to the target
    fit = F.when(F.col("size") > 0, F.floor(F.col("room") / F.greatest("size", F.lit(1)) + 0.5)).otherwise(F.col("n"))
    inner = inner.withColumn("rows", F.least(fit, F.col("n")).cast("long")).where("room >= 0 AND rows > 0")
    last = inner.groupBy("source").agg(F.max(F.struct("key", "size", "rows", "n")).alias("last")).select(F.col("source").alias("ls"), "last")
    border = edge.join(last, F.col("s").eqNullSafe(F.col("ls")), "left").select(F.col("s"), F.coalesce("last.key", "b").alias("border"), "last.size", "last.rows", "last.n")
    # a bucket's name is before all its keys, but for the one of the rows without an id
    border = border.withColumn("size", F.coalesce("size", F.lit(-1)))
    plan = targets.join(border, F.col("source").eqNullSafe(F.col("s")), "left")
    # no bucket ends above: nothing missing, or all of the source is taken once more
    none = F.when(F.col("more") > 0, F.lit("h")).otherwise(F.lit(""))
    split = F.coalesce(F.col("rows") < F.col("n"), F.lit(False))
    return plan.select(
        F.col("source").alias("__source"), "source_size", "target", "times", F.coalesce("border", none).alias("border"),
        F.coalesce("size", F.lit(-1)).alias("border_size"), F.col("rows").alias("border_rows"), split.alias("split"))


def _taken(docs: DataFrame, source: str, plan: DataFrame, key: str, size: str, digest: str | None = None) -> DataFrame:
    """docs with their source's plan and __times, how often each is taken."""
    plan = common.cut(plan)
    small = F.broadcast(plan) if plan.count() <= SMALL else plan
    joined = docs.join(small, F.col(source).eqNullSafe(F.col("__source")), "left")
    at = (F.col(key) == F.col("border")) & (F.col(size) == F.col("border_size"))
    below = (F.col(key) < F.col("border")) | ((F.col(key) == F.col("border")) & (F.col(size) <= F.col("border_size")))
    if plan.where("split").isEmpty():
        return joined.withColumn("__times", F.col("times") + F.when(below, 1).otherwise(0)).drop("__source")
    among = F.col("split") & at
    rest = joined.where(~among).withColumn("__times", F.col("times") + F.when(below, 1).otherwise(0))
    tied = _numbered(joined.where(among), "__source", [digest] if digest else [])
    return rest.unionByName(tied.withColumn("__times", F.col("times") + F.when(F.col("__i") < F.col("border_rows"), 1).otherwise(0)).drop("__i")).drop("__source")


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with __i, their number from 0 among those of their key: numbers inside ranges of rows, moved on by the counts of earlier ranges."""
    order = [*order, "__any"]
    ranges = rows.withColumn("__any", F.monotonically_increasing_id()).repartitionByRange(key, *order)
    ranges = common.cut(ranges.withColumn("__p", F.spark_partition_id()))
    counts = ranges.groupBy(key, "__p").agg(F.count("*").alias("__n"))
    base = counts.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), (F.sum("__n").over(Window.partitionBy(key).orderBy("__p")) - F.col("__n")).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(key, "__p").orderBy(*order)) - 1
    both = ranges.withColumn("__in", inside).join(base, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q")))
    return both.withColumn("__i", F.col("__in") + F.col("__base")).drop("__any", "__p", "__in", "__k", "__q", "__base")


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), common.word_count(F.col(text)).alias("size"), _order(doc_id).alias("key"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    slim = common.cut(_slim(docs, doc_id, text, source))
    found = _taken(slim, "source", _plan(slim, weights, max_epochs), "key", "size")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__times")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs as the mix takes them: once, several times or not at all, all columns as they were. Texts without words go."""
    slim = common.cut(_slim(docs, doc_id, text, source))
    keys = [_order(doc_id).alias("__key"), F.col(source).alias("__own"), common.word_count(F.col(text)).alias("__size"), F.xxhash64(F.col(text)).alias("__digest")]
    own = docs.where(F.col(text).rlike(common.WORD)).select([F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)] + keys)
    found = _taken(own, "__own", _plan(slim, weights, max_epochs), "__key", "__size", "__digest")
    times = found.where("__times > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return times.select([F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL: clamped sources are those that come first by size / weight, and each share is taken from sums over that order.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(md5('mix-1:' || doc_id), 'g') AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w FROM s),
fill AS (
  SELECT 0 AS step, sum(source_size)::HUGEINT AS rest, sum(w)::HUGEINT AS free, 0::BIGINT AS n FROM w
  UNION ALL
  SELECT step + 1, r[1], r[2], r[3] FROM (
    SELECT step, n, (SELECT [(SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) FILTER (w * rest >= 3 * source_size * free), 0),
                      coalesce(sum(w) FILTER (w * rest < 3 * source_size * free), 0), count(*) FILTER (w * rest >= 3 * source_size * free)] FROM w) AS r
    FROM fill) WHERE r[3] > n AND r[2] > 0),
f AS (SELECT rest, free FROM fill ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN w * rest >= 3 * source_size * free THEN (3 * source_size)::DOUBLE
        ELSE w::DOUBLE * rest::DOUBLE / free::DOUBLE END AS target FROM w, f),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
o AS (SELECT d.doc_id, d.size, m.source_size, m.target, m.times, m.target - m.times * m.source_size AS more, key,
        sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (times + CASE WHEN more > 0 AND run - size / 2 <= more THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
