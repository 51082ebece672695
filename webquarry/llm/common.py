"""Helpers that the operators of this package share: words, shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word, as Java and Python patterns write it; bytes.split() splits at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def stretches(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in order, cut at white space from about `size` bytes on."""
    start = 0
    while start < len(data):
        end = len(data)
        if start + size < len(data):
            found = _SPACE.search(data, start + size)
            end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about `size` bytes each, so that a very long text is never held as one list."""
    return (part.split() for part in stretches(data, size))


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, below one of our own, and only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webquarry-llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def mapped(slim: DataFrame, make, schema: str, keep: tuple[str, ...] = ("doc_id",), size: int = 1024) -> DataFrame:
    """The columns `keep` as they are and those of `schema`, made from the other columns of slim, `size` rows at a time.

    make() runs once a task and gives a function from lists of the other columns to lists of the new ones. What is kept stays Arrow's: whole
    numbers beside nulls are not touched, as they would be by pandas."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds, others = to_arrow_schema(StructType.fromDDL(schema)), [c for c in slim.columns if c not in keep]

    def run(batches):
        import pyarrow as pa

        rows = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                made = rows(*[part.column(c).to_pylist() for c in others])
                arrays = [part.column(c) for c in keep] + [pa.array(x, k.type) for x, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds.names])

    kept = "".join(f"{c} {slim.schema[c].dataType.simpleString()}, " for c in keep)
    return slim.mapInArrow(run, kept + schema)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and go on from there: work before it isn't done again when an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links lead to, for every node of an edge.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes: each is a minimum per node (combined before the
    shuffle) and a join, so that no task gathers the neighbours of a node; the number of steps grows with the logarithm of the nodes.
    Null ends link nothing; an edge may be repeated, or turned, or join a node to itself.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(links.select(high.alias("u"), low.alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(near, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if before == state:
            break
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items is linked to by the pairs (i, j), inside one block."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def blocked(df: DataFrame, keys: list[str], item: str, size: int, some: str | None = None) -> DataFrame:
    """Rows dealt to cells in which each pair of rows with equal keys meets, and no cell holds more than about 2 * size rows.

    Groups of one row go, as they hold no pair, and those in which the flag `some` is true for no row. A group of up to `size` rows is one cell; a larger one, however hot, is split by the
    hash of `item` into parts, and each pair of parts is a cell of its own: rows are copied once a part. Adds _p, the row's part, and
    _i <= _j, the parts that the cell compares: pairs are those of a part with itself where _i = _j, else of part _i with part _j.
    """
    flag = F.bool_or(some) if some else F.lit(True)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), flag.alias("_some")).where("_n > 1 and _some")
    sizes = sizes.select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_parts"))
    own = F.pmod(F.xxhash64(item, F.lit(7)), F.col("_parts")).cast("int")
    parts = df.join(sizes, keys).withColumn("_p", own)
    cells = parts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return cells.withColumn("_i", F.least("_p", "_o")).withColumn("_j", F.greatest("_p", "_o")).drop("_o", "_parts")


def runs(batches, columns: list[str]):
    """Arrow tables from batches of rows sorted by `columns`, so that rows of equal columns are never parted between two of them.

    Holds one batch and the last run of the one before, no more."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        last, cut_at = table.num_rows - 1, np.zeros(table.num_rows, bool)
        for c in columns:
            x = table[c].to_numpy()
            cut_at |= x != x[last]
        ends = np.flatnonzero(cut_at)
        if not len(ends):
            rest = table
            continue
        k = int(ends[-1]) + 1
        yield table.slice(0, k).combine_chunks()
        rest = table.slice(k)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
