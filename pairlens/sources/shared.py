"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application: the folder of one that names none
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)  # folders written inside the innermost scratch()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local mode, where nothing names one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="pairlens-")
        named = _own[app]
    return named.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to the shared folder inside it; results must have been used by then."""
    folders: list[str] = []
    token = _open.set(folders)
    try:
        yield
    finally:
        _open.reset(token)
        for folder in folders:
            delete(spark, folder)


class Written:
    """Tables written to the shared folder: they cut lineage, are computed once and survive lost executors. What is left of them goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pairlens/{uuid.uuid4().hex}"
        self.count = 0
        if (folders := _open.get()) is not None:
            folders.append(self.root)
        path, system = _path(spark, self.root)
        system.deleteOnExit(path)

    def table(self, df: DataFrame, file_rows: int = 0, compression: str = "snappy") -> DataFrame:
        """df, written and to be read again; file_rows: rows in a file at most, if not 0."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("maxRecordsPerFile", file_rows).option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pairlens_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of table() that nothing will read again."""
        delete(self.spark, df._pairlens_path)

    def close(self) -> None:
        """Deletes all its tables."""
        delete(self.spark, self.root)
