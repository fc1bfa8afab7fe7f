"""The list format that a reviewer's tool reads, as a data source: `spark.read.format("wrapped_list")` and `df.write.format("wrapped_list")`.

A file has a header, the names of the fields joined by SEPARATOR, then for each pair its two keys and the values of
both records, a line each. A configuration has one file, `config=<label>/list.txt`, and is one partition when it is read. A
single file with several lists of the same length, one after another, is read with the option `pairs`; the lists are
then numbered from 0.

Options: path; columns (names of the fields joined by SEPARATOR, to write); pairs (to read: pairs that each list must have).
Values with a line break do not fit the format and are refused. Paths are those of file systems that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SEPARATOR = "@_@_@_@"
NAME = "wrapped_list"
SCHEMA = "config string, rank int, lkey string, rkey string, lvalues array<string>, rvalues array<string>"
FILE = "list.txt"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def wrapped_lines(columns: list[str], pairs: list[tuple[str, str, list[str], list[str]]]) -> list[str]:
    """Header and lines of a list."""
    out = [SEPARATOR.join(columns)]
    for lkey, rkey, lvalues, rvalues in pairs:
        if len(lvalues) != len(columns) or len(rvalues) != len(columns):
            raise ValueError(f"a pair has not {len(columns)} values on either side")
        values = [str(lkey), str(rkey), *lvalues, *rvalues]
        if any("\n" in v or "\r" in v for v in values):
            raise ValueError("a value with a line break does not fit the wrapped format")
        out += values
    return out


def parse_wrapped(lines: list[str]) -> tuple[list[str], list[tuple[str, str, list[str], list[str]]]]:
    """Columns, and (left key, right key, left values, right values) of each pair."""
    columns, rest = lines[0].split(SEPARATOR), lines[1:]
    n = len(columns)
    step = 2 + 2 * n
    if len(rest) % step:
        raise ValueError("the wrapped list ends inside a pair")
    return columns, [(rest[i], rest[i + 1], rest[i + 2 : i + 2 + n], rest[i + 2 + n : i + step]) for i in range(0, len(rest), step)]


@dataclass
class _File(InputPartition):
    config: str
    path: str


@dataclass
class _Wrote(WriterCommitMessage):
    files: dict[str, str]  # by configuration, under a name of its own


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pairs = int(options.get("pairs", 0))

    def partitions(self) -> list[_File]:
        system, root = _located(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [_File("", root)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [_File(unquote(f.path.split("/")[-2].removeprefix("config=")), f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name == FILE]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, _ = _located(self.path)
        with system.open_input_stream(partition.path) as stream:
            text = stream.read().decode()
        _, pairs = parse_wrapped(text.removesuffix("\n").split("\n"))
        size = self.pairs or len(pairs)
        if len(pairs) % max(size, 1):
            raise ValueError(f"{partition.path} has a list of fewer than {size} pairs")
        if partition.config and self.pairs and len(pairs) != self.pairs:
            raise ValueError(f"{partition.path} has not {self.pairs} pairs")
        for i, (lkey, rkey, lvalues, rvalues) in enumerate(pairs):
            yield partition.config or str(i // size), i % size + 1, lkey, rkey, lvalues, rvalues


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], options["columns"].split(SEPARATOR), overwrite

    def write(self, iterator: Iterator[Row]) -> _Wrote:
        lists: dict[str, list[Row]] = defaultdict(list)  # k rows a configuration
        for r in iterator:
            lists[r["config"]].append(r)
        system, root = _located(self.path)
        files = {}
        for config, rows in lists.items():
            rows.sort(key=lambda r: r["rank"])
            lines = wrapped_lines(self.columns, [(r["lkey"], r["rkey"], list(r["lvalues"]), list(r["rvalues"])) for r in rows])
            folder = f"{root}/config={quote(config, safe='')}"
            system.create_dir(folder, recursive=True)
            files[config] = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(files[config]) as stream:
                stream.write(("\n".join(lines) + "\n").encode())
        return _Wrote(files)

    def commit(self, messages: list[_Wrote | None]) -> None:
        """Gives all files their names at once; a configuration written by two tasks would have no order, so it is refused."""
        system, root = _located(self.path)
        written: dict[str, str] = {}
        for m in messages:
            for config, path in (m.files if m is not None else {}).items():
                if config in written:
                    self.abort(messages)
                    raise ValueError(f"configuration {config} was written by several tasks: repartition by config")
                written[config] = path
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File and f.base_name == FILE:
                    system.delete_file(f.path)
        for path in written.values():
            system.move(path, f"{path.rpartition('/')[0]}/{FILE}")

    def abort(self, messages: list[_Wrote | None]) -> None:
        system, _ = _located(self.path)
        for m in messages:
            for path in (m.files if m is not None else {}).values():
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)


class WrappedList(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WrappedList)


def write_wrapped(recommended: DataFrame, columns: list[str], path: str) -> None:
    """Recommendations (config, rank, lkey, rkey, lvalues, rvalues) as one list file for each configuration."""
    register(recommended.sparkSession)
    rows = recommended.select("config", F.col("rank").cast("int").alias("rank"), F.col("lkey").cast("string").alias("lkey"), F.col("rkey").cast("string").alias("rkey"), "lvalues", "rvalues")
    rows.repartition("config").write.format(NAME).option("columns", SEPARATOR.join(columns)).mode("overwrite").save(path)


def read_wrapped(spark: SparkSession, path: str, pairs: int = 0) -> DataFrame:
    """The lists under a path; pairs: pairs that each must have, if not 0."""
    register(spark)
    return spark.read.format(NAME).option("pairs", pairs).load(path)
