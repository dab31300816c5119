"""What the corpus operators share: tables that cut lineage (``sources.tables``),
Arrow batches cut to a bounded number of bytes, shipped code."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import drop_tables, mark, materialize, new_path, shared_dir

__all__ = ["drop_tables", "mark", "materialize", "new_path", "shared_dir"]

#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 2 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="patternweave-code-")) / "patternweave_code.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    to.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``text`` holds about ``limit`` bytes in each part; a single longer text stays whole."""
    column = batch.column(text)
    n = batch.num_rows
    if n == 0:
        return
    if column.type == pa.large_string() or column.type == pa.large_binary():
        kind = "int64"
    else:
        kind = "int32"
    import numpy as np

    ends = np.frombuffer(column.buffers()[1], dtype=kind, count=n + 1 + column.offset)[column.offset :]
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, text: str, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], limit: int = SLICE_BYTES) -> DataFrame:
    """Run ``make()``'s function over bounded parts of ``df``'s rows, as whole texts."""
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, at, limit):
                if (out := f(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def held(column: str, modulus: int) -> F.Column:
    """crc32 of an id as text, mod ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def added(schema: T.StructType, columns: str) -> T.StructType:
    """A copy of ``schema`` with more columns, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(columns).fields])
