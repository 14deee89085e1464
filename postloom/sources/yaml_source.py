"""`yaml_records`: a data source for folders of many small YAML files, in batch and as a stream.

    spark.dataSource.register(YamlRecords)
    spark.read.format("yaml_records").option("record", schema.json()).load("s3://corpus/structured")

Rows are (file_name, json, error): a file ends in exactly one of the last two. `records` makes them (ok, bad) tables.
Files are listed once and dealt out in tasks of about `taskBytes` bytes and at most `taskFiles` files, so neither a hundred
thousand tiny files nor a few large ones make odd tasks. A stream takes the files in order of (modification time, path); its offset is
the last pair that was planned, and a file counts once it has been at rest for `settle` seconds, so files of one moment arrive together.
"""

from __future__ import annotations

import fnmatch
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROW = "file_name string, json string, error string"


def _listed(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """(modification time in ns, path, size) of the files below a folder (or of one file), in that order."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found
                  if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", ".")))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def dealt(files: list[tuple[int, str, int]], task_bytes: int, task_files: int) -> list[_Files]:
    """Tasks of neighbouring files; a larger file is a task of its own."""
    tasks, held, size = [], [], 0
    for _, path, length in files:
        if held and (size + length > task_bytes or len(held) >= task_files):
            tasks.append(_Files(held))
            held, size = [], 0
        held.append(path)
        size += length
    return tasks + ([_Files(held)] if held else [])


class _Reading:
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.y*ml")
        self.task_bytes, self.task_files = int(options.get("taskBytes", 4 << 20)), int(options.get("taskFiles", 2000))
        self.settle, self.per_batch = float(options.get("settle", 1)), int(options.get("maxFilesPerTrigger", 1 << 62))
        self.record = options.get("record")

    def read(self, partition: _Files) -> Iterator[tuple[str, str | None, str | None]]:
        from pyarrow import fs

        from postloom.sources.readers import yaml_record

        schema = T.StructType.fromJson(json.loads(self.record)) if self.record else None
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            try:
                with system.open_input_stream(path) as stream:
                    text = stream.read().decode("utf-8")
            except UnicodeDecodeError as error:
                yield name, None, f"UnicodeDecodeError: {error.reason}"
                continue
            yield (name, *yaml_record(text, schema))


class YamlReader(_Reading, DataSourceReader):
    def partitions(self) -> list[_Files]:
        return dealt(_listed(self.path, self.pattern), self.task_bytes, self.task_files) or [_Files([])]


class YamlStreamReader(_Reading, DataSourceStreamReader):
    """The offset is [time, path] of the last file planned."""

    planned: list | None = None

    def initialOffset(self) -> dict:
        return {"last": [-1, ""]}

    def _settled(self) -> list[tuple[int, str, int]]:
        limit = time.time_ns() - int(self.settle * 1e9)
        return [f for f in _listed(self.path, self.pattern) if f[0] <= limit]

    def latestOffset(self) -> dict:
        files = self._settled()
        if self.planned is not None:
            files = [f for f in files if [f[0], f[1]] > self.planned][:self.per_batch]
        if files:
            self.planned = [files[-1][0], files[-1][1]]
        return {"last": self.planned or [-1, ""]}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        self.planned = max(self.planned or [-1, ""], end["last"])
        return dealt([f for f in _listed(self.path, self.pattern) if start["last"] < [f[0], f[1]] <= end["last"]], self.task_bytes, self.task_files)

    def commit(self, end: dict) -> None:
        """Nothing to forget: the offset is all there is."""


class YamlRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yaml_records"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return YamlReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return YamlStreamReader(self.options)


def load(spark: SparkSession, path: str, record: T.StructType, *, stream: bool = False, **options) -> DataFrame:
    """(file_name, json, error) of the files of a folder; `record` is the schema a file must fit."""
    spark.dataSource.register(YamlRecords)
    reader = (spark.readStream if stream else spark.read).format("yaml_records").option("record", record.json())
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def records(parsed: DataFrame, record: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(file_name plus the record's columns, file_name plus error)."""
    ok = parsed.filter(F.col("error").isNull()).select("file_name", F.from_json("json", record).alias("r")).select("file_name", "r.*")
    return ok, parsed.filter(F.col("error").isNotNull()).select("file_name", "error")
