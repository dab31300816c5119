"""Tables in the folder that all machines share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a local one if Spark runs in one process, else an error."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them can read")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="patternweave-")
    return _local_dir


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(drop_tables)
    _tables.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table stands at ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """A place in the list of tables, for ``drop_tables``."""
    return len(_tables)


def drop_tables(since: int = 0, keep: str = "") -> None:
    """Delete the tables that this process has written since ``since`` (but for ``keep``); results read from them end here."""
    gone, _tables[since:] = _tables[since:], [t for t in _tables[since:] if t[1] == keep]
    for spark, path in gone:
        if path != keep:
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001 - the session has ended, or the folder is gone
                continue


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: lost executors lose nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Named results in a folder of the user's: built once, read again by later runs, deleted by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, name: str, build) -> DataFrame:
        """The stored result ``name``; ``build()`` makes it if it isn't there."""
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")
