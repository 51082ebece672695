"""Sinks for converted pages. Files are written by the executors, never through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.operators.batch import export_manifest, unique_names


def markdown_files(results: DataFrame, order: str | list[str] = "page_id") -> DataFrame:
    """``file_name, content`` of every successful page."""
    ok = results.filter("success")
    return unique_names(ok, "title", order).select("file_name", F.col("markdown").alias("content"))


def write_markdown_table(results: DataFrame, path: str, order: str | list[str] = "page_id") -> None:
    markdown_files(results, order).write.mode("overwrite").parquet(path)


#: Name of the data source, and of the file by which a written folder becomes one.
FILES, COMMITTED = "named_files", "committed.json"


def named_files():
    """A data source that writes rows ``file_name, content``, each as one file, in two phases.

    A task writes into a folder of its own, ``part-<task>-<attempt>``, and answers with its name and counts. The job is committed by one small file
    that lists the folders of the tasks that count, put in place by a rename; what other attempts left is removed then, and after an
    abort all of it. The driver sees a row a task, never a file. Works on every file system that Arrow opens by its address.
    """
    import json
    import posixpath
    import uuid

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    # the classes go to the workers by value, so nothing of this package is needed there
    mark = COMMITTED

    def opened(path):
        from pyarrow import fs

        if "://" not in path and not path.startswith("file:"):
            return fs.LocalFileSystem(), posixpath.abspath(path)
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)

    class Done(WriterCommitMessage):
        def __init__(self, folder, n_files, n_bytes):
            self.folder, self.n_files, self.n_bytes = folder, n_files, n_bytes

    class Writer(DataSourceWriter):
        def __init__(self, path, overwrite):
            self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:8]

        def write(self, rows):
            from pyspark import TaskContext

            files, root = opened(self.path)
            task = TaskContext.get()
            folder = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}"
            files.create_dir(f"{root}/{folder}", recursive=True)
            n_files = n_bytes = 0
            for row in rows:
                data = (row["content"] or "").encode()
                with files.open_output_stream(f"{root}/{folder}/{row['file_name']}") as out:
                    out.write(data)
                n_files, n_bytes = n_files + 1, n_bytes + len(data)
            return Done(folder, n_files, n_bytes)

        def commit(self, messages):
            from pyarrow import fs

            files, root = opened(self.path)
            done = {m.folder: [m.n_files, m.n_bytes] for m in messages if m}
            if not self.overwrite and files.get_file_info(f"{root}/{mark}").type == fs.FileType.File:
                with files.open_input_stream(f"{root}/{mark}") as known:
                    done = json.loads(known.read()) | done
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/{mark}.{self.job}") as out:
                out.write(json.dumps(done, indent=1).encode())
            files.move(f"{root}/{mark}.{self.job}", f"{root}/{mark}")
            self.tidy(files, root, lambda name: name not in done)

        def abort(self, messages):
            files, root = opened(self.path)
            self.tidy(files, root, lambda name: self.job in name)

        def tidy(self, files, root, unwanted):
            from pyarrow import fs

            for found in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if found.type == fs.FileType.Directory and found.base_name.startswith("part-") and unwanted(found.base_name):
                    files.delete_dir(found.path)

    class NamedFiles(DataSource):
        @classmethod
        def name(cls):
            return "named_files"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], overwrite)

    return NamedFiles


def write_markdown_files(results: DataFrame, path: str, order: str | list[str] = "page_id") -> None:
    """One file a page, under its name, in as many folders as there are tasks; see ``named_files``."""
    spark = results.sparkSession
    spark.dataSource.register(named_files())
    markdown_files(results, order).write.format(FILES).mode("overwrite").save(path)


def read_markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, content`` of the committed files of a folder that ``write_markdown_files`` wrote."""
    import json

    listed = spark.read.text(f"{path}/{COMMITTED}", wholetext=True).first()[0]
    folders = [f"{path}/{name}" for name, (n, _) in json.loads(listed).items() if n]
    if not folders:
        return spark.createDataFrame([], "file_name string, content string")
    name = F.try_url_decode(F.replace(F.regexp_extract(F.input_file_name(), "[^/]*$", 0), F.lit("+"), F.lit("%2B")))
    return spark.read.text(folders, wholetext=True).select(name.alias("file_name"), F.col("value").alias("content"))


def write_merged(merged: DataFrame, path: str, group: str) -> None:
    """Merged text of each group as text files in order: one folder per group, parts by name.

    Range partitions keep the order across files, so no task needs a whole group. The separator stands
    before every part but the first, and the text ends with a line break.
    """
    out = merged.filter("error IS NULL").repartitionByRange(F.col(group), F.col("part")).sortWithinPartitions(group, "part")
    # each part ends its line, and that is the first break of the separator
    between = F.when(F.col("part") > 0, F.lit(C.MERGE_SEPARATOR[1:])).otherwise(F.lit(""))
    out.select(group, F.concat(between, "markdown").alias("value")).write.mode(
        "overwrite").option("lineSep", "\n").partitionBy(group).text(path)


def write_export(results: DataFrame, path: str, day: str, order: str = "page_id") -> DataFrame:
    """Files of a batch and a manifest row next to them; returns the manifest."""
    write_markdown_table(results, f"{path}/files", order)
    export_manifest(results, day).write.mode("overwrite").parquet(f"{path}/manifest")
    return results.sparkSession.read.parquet(f"{path}/manifest")
