"""Lineage cut in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that the cluster names for checkpoints; one of our own only on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webquarry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def work_folder(spark) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


WHOLE_STAGE = "spark.sql.codegen.wholeStage"


@contextlib.contextmanager
def small_methods(spark):
    """Plans that run inside have their operators compiled one by one, each in small methods.

    Compiled together, operators with dozens of columns become methods that the JVM's compiler finds too large (8,000 bytes) and leaves to its
    interpreter, or compiles badly. The rows are the same either way; the setting of the session is put back.
    """
    given = spark.conf.get(WHOLE_STAGE, None)
    spark.conf.set(WHOLE_STAGE, "false")
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(WHOLE_STAGE)
        else:
            spark.conf.set(WHOLE_STAGE, given)


def cut(df: DataFrame, by=None) -> DataFrame:
    """Write the rows to the checkpoint folder of the cluster and go on from there, with ``by`` in as many partitions by it as were written.

    Read again, rows are no longer known to lie by a key, so the next window has them exchanged; left to adaptive execution that would put
    together what was dealt out by size. Rows with ``by`` are those of wide plans of windows, so they are made by ``small_methods``.
    """
    if by is None:
        shared_folder(df.sparkSession)
        return df.checkpoint()
    df, n = written(df)
    return df.repartition(n, *by)


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of a wide plan, written to the same folder, and the number of partitions they are in."""
    shared_folder(df.sparkSession)
    with small_methods(df.sparkSession):
        df = df.checkpoint()
    return df, df.rdd.getNumPartitions()
