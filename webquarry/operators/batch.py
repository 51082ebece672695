"""Operators over many conversion results: names, merges, summaries, reduction.

A group may hold a third of all rows, so nothing here gathers a group in one task: ranks are
put together from ranges of rows, merged text comes in parts, medians from counts per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.functions import text as X
from webquarry.operators.lineage import cut


def scanned(df: DataFrame, key: str, order: str | list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over the earlier rows with the same ``key``, by ``order``: a segmented prefix scan.

    Rows are dealt out by ranges of key and order, summed up inside their range, and the totals of the key's earlier
    ranges are carried on. A hot key fills several ranges, whatever its orders look like.
    """
    order = [order] if isinstance(order, str) else order
    # the ranges are read twice, so they are written first
    df = cut(df.withColumns({f"_v_{n}": c.cast("bigint") for n, c in sums.items()}).repartitionByRange(key, *order)
             .withColumn("_range", F.spark_partition_id()))
    totals = df.groupBy(key, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    carried = totals.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), none).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), none) for n in sums})
    both = df.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    both = both.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in sums})
    return both.drop("_range", "_key", "_at", *[f"_{p}_{n}" for n in sums for p in "vib"])


def ranked(df: DataFrame, key: str, order: str | list[str], name: str = "rank") -> DataFrame:
    """Rank from 0 of each row among the rows with its ``key``, by ``order``."""
    return scanned(df, key, order, {name: F.lit(1)})


_SUFFIX = r"_([1-9][0-9]*)$"
#: Rounds of bounds before what is still open is settled one by one.
ROUNDS = 4


def unique_names(df: DataFrame, title: str = "title", order: str | list[str] = "page_id") -> DataFrame:
    """``file_name``: the sanitised title, with ``_1``, ``_2`` … from its second use on.

    Two things can clash: a number given to a stem, and a title that ends in it. If the title came first, the
    stem skips the number; if not, the title finds its plain name taken and counts on from 1 itself. Only
    stems with such titles, their rivals, are looked at, a row a rival. A title that is a stem itself waits for
    its own stem, so there are as many rounds as a name has numbers at its end. ``order`` must tell rows apart.
    """
    order = [order] if isinstance(order, str) else order
    place = F.struct(*order).alias("_order")
    uses = ranked(df.select(place, X.sanitize_filename(F.col(title)).alias("base")), "base", "_order", "use")
    stems = uses.groupBy("base").agg(F.count("*").alias("uses"), F.min("_order").alias("first"))
    rivals = stems.select(
        F.regexp_replace("base", _SUFFIX, "").alias("stem"),
        F.regexp_extract("base", _SUFFIX, 1).try_cast("bigint").alias("n"), F.col("base").alias("rival"), "first",
    ).filter("n IS NOT NULL AND stem <> ''")
    clashes = cut(rivals.join(stems.select(F.col("base").alias("stem"), "uses"), "stem"))
    number = F.col("use")
    if not clashes.isEmpty():
        skips, late = _settled(uses, clashes)
        # a row is moved on by the skips at or before its number
        changed = skips.select("base").unionByName(late).distinct()
        rows = uses.join(changed, "base", "left_semi").select("base", F.col("use").alias("at"), F.lit(1).alias("row"), "_order")
        marks = skips.select("base", "at", F.lit(0).alias("row"), F.lit(None).cast(uses.schema["_order"].dataType).alias("_order"))
        moved = scanned(rows.unionByName(marks), "base", ["at", "row"], {"skipped": F.col("row") == 0}).filter("row = 1")
        moved = moved.join(late.withColumn("late", F.lit(1)), "base", "left")
        moved = moved.select("_order", (F.col("at") + F.col("skipped") + F.coalesce("late", F.lit(0))).alias("number"))
        uses = uses.join(moved, "_order", "left")
        number = F.coalesce("number", "use")
    name = F.concat("base", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    names = uses.select(F.col("_order").alias("_place"), name.alias("file_name"))
    return df.join(names, F.struct(*order) == F.col("_place")).drop("_place")


def _settled(uses: DataFrame, clashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base, at``: ranks of a base's rows before which a number is left out; ``base``: titles whose plain name is taken.

    A rival with number n is passed, and n left out, if the stem comes to n after the rival came, and taken if before. The stem's row that comes to n
    is n less the numbers it has left out before, which is a sum over the stem's earlier rivals.
    """
    marks = clashes.select(F.col("stem").alias("base"), F.col("first").alias("_order"), "rival")
    # rows of the stem before the rival's first
    own = uses.join(clashes.select(F.col("stem").alias("base")).distinct(), "base", "left_semi")
    both = own.select("base", "_order", F.lit(None).cast("string").alias("rival")).unionByName(marks)
    before = scanned(both, "base", "_order", {"before": F.col("rival").isNull()}).filter("rival IS NOT NULL").select("rival", "before")
    numbers = F.regexp_extract("stem", r"((?:_[1-9][0-9]*)*)$", 1)
    depth = F.length(numbers) - F.length(F.regexp_replace(numbers, "_", ""))
    table = cut(clashes.join(before, "rival").withColumn("depth", depth))
    late, skips = None, None
    # a name has 50 numbers at its end at most
    for (level,) in table.select("depth").distinct().orderBy("depth").collect():
        rows = table.filter(F.col("depth") == level).select("stem", "n", "rival", "before", "uses")
        if late is None:
            rows = rows.withColumn("first", F.col("n"))
        else:
            known = late.select(F.col("base").alias("stem"), F.lit(1).alias("_late"))
            rows = rows.join(known, "stem", "left").withColumn("first", F.col("n") - F.coalesce("_late", F.lit(0))).drop("_late")
        rows = cut(_passed(rows))
        passed = rows.filter("passed").select(F.col("stem").alias("base"), F.col("first").alias("at"))
        taken = rows.filter(~F.col("passed") & (F.col("first") < F.col("before"))).select(F.col("rival").alias("base"))
        skips = passed if skips is None else skips.unionByName(passed)
        late = taken if late is None else late.unionByName(taken)
    return cut(skips), cut(late)


def _passed(rows: DataFrame) -> DataFrame:
    """``passed`` of each rival (``stem, n, before, uses, first``), and ``first``, the stem's row that comes to its number.

    The numbers left out before a rival lie between those that surely are and these with all that are open. Bounds from sums over the
    earlier rivals settle most of them in a few rounds; a chain of rivals that hang on each other is settled one by one
    as it streams by in order, with one number kept for its stem.
    """
    # a stem comes to n with row n at the latest; the last rows never come
    rows = rows.withColumn("passed", F.lit(None).cast("boolean"))
    for _ in range(ROUNDS):
        rows = _bounded(rows)
        least, most = F.col("first") - F.col("_sure") - F.col("_open"), F.col("first") - F.col("_sure")
        found = F.when((least >= F.col("before")) & (most < F.col("uses")), True).when(
            (most < F.col("before")) | (least >= F.col("uses")), False)
        rows = cut(rows.withColumn("passed", F.coalesce("passed", found)).drop("_sure", "_open"))
        if rows.filter("passed IS NULL").isEmpty():
            break
    else:
        rows = cut(_bounded(rows))
        chain = rows.filter("passed IS NULL").select("stem", "n", F.col("first").alias("at"), "before", "uses", F.col("_sure").alias("sure"))
        chain = chain.repartition("stem").sortWithinPartitions("stem", "n").mapInArrow(_walk(), "stem string, n bigint, found boolean")
        rows = rows.join(chain, ["stem", "n"], "left").withColumn("passed", F.coalesce("passed", "found")).drop("found", "_sure", "_open")
    done = scanned(rows, "stem", "n", {"_out": F.col("passed").cast("int")})
    return done.withColumn("first", F.col("first") - F.col("_out")).drop("_out")


def _bounded(rows: DataFrame) -> DataFrame:
    return scanned(rows, "stem", "n", {"_sure": F.coalesce("passed", F.lit(False)).cast("int"), "_open": F.col("passed").isNull().cast("int")})


def _walk():
    def walk(batches):
        import pyarrow as pa

        stem, passed = None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["stem"] != stem:
                    stem, passed = r["stem"], 0
                row = r["at"] - r["sure"] - passed
                out.append(r["before"] <= row < r["uses"])
                passed += out[-1]
            yield pa.RecordBatch.from_arrays([batch.column("stem"), batch.column("n"), pa.array(out, pa.bool_())], names=["stem", "n", "found"])

    return walk


def merge_markdown(results: DataFrame, group: str, order: str, text: str = "markdown",
                   per_part: int = 1_000, separator: str = C.MERGE_SEPARATOR) -> DataFrame:
    """Merged text of every group in input order: ``group, part, n, markdown, error``.

    A part holds ``per_part`` successful rows. The parts of a group, joined by the separator, are its whole
    text; no task ever holds more than one part. A group without any success is a row with ``error``.
    """
    if "success" not in results.columns:
        results = results.withColumn("success", F.lit(True))
    ok = ranked(results.filter("success").select(group, order, text), group, order, "part")
    ok = ok.withColumn("part", F.floor(F.col("part") / per_part).cast("bigint"))
    sep = separator.replace("\n", "\\n")
    parts = ok.groupBy(group, "part").agg(
        F.count("*").alias("n"),
        F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY {order})").alias("markdown"),
    ).withColumn("error", F.lit(None).cast("string"))
    none = results.groupBy(group).agg(F.count_if("success").alias("n")).filter("n = 0")
    failed = none.select(group, F.lit(0).cast("bigint").alias("part"), "n", F.lit(None).cast("string").alias("markdown"),
                         F.lit(C.NOTHING_CONVERTED).alias("error"))
    return parts.unionByName(failed)


def results_summary(results: DataFrame, by: list[str] | None = None,
                    limit: int = 8192) -> DataFrame:
    """Successes, failures, total tokens and the messages of a batch."""
    out = results.groupBy(*(by or [])).agg(
        F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("fail_count"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("token_count"))), F.lit(0)).alias("total_tokens"),
    )
    ok, bad = F.col("success_count"), F.col("fail_count")
    message = F.concat(
        ok.cast("string"), F.lit(" tab"), F.when(ok > 1, F.lit("s")).otherwise(F.lit("")),
        F.when(bad > 0, F.concat(F.lit(" ("), bad.cast("string"), F.lit(" failed)"))).otherwise(F.lit("")),
    )
    return out.withColumns({
        "message": message,
        "token_message": X.batch_tokens_message(F.col("total_tokens"), limit),
        "large_batch": (ok + bad) > C.LARGE_BATCH,
        "error": F.when(ok == 0, F.lit(C.NOTHING_CONVERTED)),
    })


def export_manifest(results: DataFrame, day: str) -> DataFrame:
    """One row that names the export; ``error`` when nothing was converted."""
    n = results.agg(F.count_if("success").alias("n_files"))
    name = F.concat(F.lit(f"export-{day}-"), F.col("n_files").cast("string"), F.lit("tabs"))
    return n.select(
        F.when(F.col("n_files") > 0, name).alias("export_name"), "n_files",
        F.when(F.col("n_files") == 0, F.lit(C.NOTHING_CONVERTED)).alias("error"))


def reduction_stats(results: DataFrame) -> DataFrame:
    """Tokens of the HTML against tokens of the Markdown: sums, smallest, median, largest ratio. ``results`` of ``Options(html_tokens=True)``.

    Ratios are counted in thousandths, and the median is exact on them.
    """
    good = results.filter("success AND token_count > 0").select("html_tokens", "token_count")
    per = good.withColumn("ratio_1000", F.floor(F.col("html_tokens") * 1000 / F.col("token_count")))
    # read three times, so it is written: a row a ratio
    counts = cut(per.groupBy("ratio_1000").agg(
        F.count("*").alias("n"), F.sum("html_tokens").alias("h"), F.sum("token_count").alias("m")))
    stats = counts.agg(
        F.sum("n").alias("n_pages"), F.sum("h").alias("html_tokens"), F.sum("m").alias("markdown_tokens"),
        F.min("ratio_1000").alias("min_ratio_1000"), F.max("ratio_1000").alias("max_ratio_1000"))
    half = stats.select(F.floor((F.col("n_pages") + 1) / 2)).scalar()
    # first the bucket that holds the median: 64 to each doubling, so 4,096 rows at most; then the value in it
    bucketed = counts.withColumn("bucket", F.floor(F.log2(F.col("ratio_1000") + 1) * 64))
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = bucketed.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("upto", upto).filter(
        (F.col("upto") >= half) & (F.col("upto") - F.col("n") < half))
    inside = bucketed.join(edge.select("bucket", (F.col("upto") - F.col("n")).alias("below")), "bucket")
    run = F.sum("n").over(Window.partitionBy("bucket").orderBy("ratio_1000").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    value = inside.withColumn("run", run + F.col("below")).filter(F.col("run") >= half).agg(F.min("ratio_1000"))
    return stats.withColumn("median_ratio_1000", value.scalar())
