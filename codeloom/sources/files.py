"""Python data sources, and JSON lines out: repositories (a folder of folders) and JSON lines with their numbers.

Spark's file sources skip names that start with a dot or an underscore, and do not number lines. Paths are read with pyarrow.fs
where they are URIs that it knows, so executors can read a shared store.
"""

from __future__ import annotations

import io
import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.functions.paths import repo_key


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Each(DataSourceReader):
    """One partition for each folder (repositories) or file (lines) directly under path."""

    def __init__(self, options):
        self.path, self.ext = options["path"], options.get("ext", ".py")

    def partitions(self):
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [InputPartition(root)]
        found = [f for f in store.get_file_info(fs.FileSelector(root)) if self.hidden or f.base_name[:1] not in "._"]
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == self.kind]

    def _bytes(self, store, path):
        with store.open_input_stream(path) as f:
            return f.read()


class _RepositoryReader(_Each):
    kind, hidden = fs.FileType.Directory, True

    def read(self, partition):
        store, _ = _open(self.path)
        root = partition.value
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if info.type != fs.FileType.File or not info.path.endswith(self.ext):
                continue
            try:
                raw = self._bytes(store, info.path)
            except OSError:  # unreadable files are left out
                continue
            text = raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
            try:
                raw.decode("utf-8")
                strict = True
            except UnicodeDecodeError:
                strict = False
            yield root.rsplit("/", 1)[-1], info.path[len(root) + 1 :], text, len(text.splitlines()), text.count("\n") + (text[-1:] not in ("", "\n")), strict


class RepositorySource(DataSource):
    """spark.read.format("repository").option("ext", ".py").load(folder)"""

    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return "repo_key string, path string, content string, line_count int, readline_count int, strict_utf8 boolean"

    def reader(self, schema):
        return _RepositoryReader(self.options)


class _LineReader(_Each):
    kind, hidden = fs.FileType.File, False  # writers leave marks such as _SUCCESS

    def read(self, partition):
        store, _ = _open(self.path)
        with store.open_input_stream(partition.value) as f:
            i = 0
            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):  # one line in memory at a time
                if line.strip():
                    json.loads(line)  # an object that does not parse is an error here, not a null later
                    yield partition.value.rsplit("/", 1)[-1], i, line.strip("\r\n")
                    i += 1


class LineSource(DataSource):
    """spark.read.format("numbered_lines").load(file or folder): each object's position, and the object as JSON text for from_json."""

    @classmethod
    def name(cls):
        return "numbered_lines"

    def schema(self):
        return "file string, sample_idx long, value string"

    def reader(self, schema):
        return _LineReader(self.options)


def register(spark) -> None:
    for source in (RepositorySource, LineSource):
        spark.dataSource.register(source)


POINTS = "id string, repo string, revision string, path string, modified array<string>, prefix string, suffix string"
ANSWERS = "middle string"
PREDICTIONS = "context string, prefix string, suffix string"


def numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """sample_idx and the schema's fields of each object; positions go on from file to file in the files' order. Only a row for each
    file goes through the window."""
    lines = spark.read.format("numbered_lines").load(path)
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.join(before, "file").select((F.col("before") + F.col("sample_idx")).alias("sample_idx"), F.from_json("value", schema).alias("v")).select("sample_idx", "v.*")


def points(spark: SparkSession, path: str) -> DataFrame:
    """Completion points as the retrieval plan takes them: sample, id, repo, repo_key, own, modified, prefix, suffix."""
    return numbered(spark, path, POINTS).select(F.col("sample_idx").alias("sample"), "id", "repo", repo_key(F.col("repo"), F.col("revision")).alias("repo_key"), F.col("path").alias("own"), F.coalesce("modified", F.array().cast("array<string>")).alias("modified"), F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"))


def write_lines(df: DataFrame, path: str, order: str, keep_order: bool = False) -> None:
    """One JSON object a row, in the order of a column (left out unless keep_order), null fields absent: a folder of parts whose names
    sort as their rows do, which numbered() reads back."""
    rows = df.orderBy(order)
    names = [c for c in df.columns if keep_order or c != order]
    rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)
