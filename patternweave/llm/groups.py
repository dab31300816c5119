"""Groups of rows that a task compares whole, large ones in pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Rows of a block in a task.
BLOCK = 4096


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups, by the first ``keys`` columns, of rows that arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(i).to_numpy() for i in range(keys)])
        edge = np.concatenate(([0], np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield table.slice(a, b - a)
        held = table.slice(int(edge[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def blocked(df: DataFrame, key: str, ident: str, tag: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Add i and j: rows of a key with over ``least`` rows (``most`` if not given) are dealt to blocks, and each pair of
    blocks (i <= j) is a group; in others both are 0.  side: 0 if the row is of block i, else 1.  A block has a 16th of
    the rows, between ``least`` and ``most`` (BLOCK if not given)."""
    most = most or BLOCK
    least = min(least or most, most)
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("rows") / 16)))
    big = runtime.materialize(df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > least).select(F.col(key), F.ceil(F.col("rows") / size).alias("blocks")), tag)
    plain = df.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "side": F.lit(0)})
    if not big.count():
        return plain
    own = F.pmod(F.xxhash64(ident, F.lit(5)), F.col("blocks"))
    split = df.join(big, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = split.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.when(F.col("own") <= F.col("other"), 0).otherwise(1)}).drop("blocks", "own", "other")
    return plain.join(big.select(key), key, "left_anti").select(*split.columns).union(split)
