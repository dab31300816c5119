"""Edge lists, tables and pattern files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import SEPARATORS


def read_edge_text(spark: SparkSession, path: str | list[str], separator: str = "default") -> DataFrame:
    """(src, dst) of lines ``src<sep>dst``; lines that begin with # or % and lines that aren't two ids are left out."""
    sep = SEPARATORS.get(separator, separator)
    parts = F.split(F.trim("value"), "\\Q" + sep + "\\E" if sep.strip() else "[\\s]+", -1)
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[#%]"))
    ids = lines.select(parts.alias("p")).where(F.size("p") >= 2).selectExpr("try_cast(trim(p[0]) as bigint) as src", "try_cast(trim(p[1]) as bigint) as dst")
    return ids.where("src is not null and dst is not null")


def read_edge_table(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> DataFrame:
    return spark.read.parquet(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def write_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """A Parquet table; an earlier one is replaced."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_text(df: DataFrame, path: str, separator: str = "default") -> None:
    """One line a row, fields joined by the separator; an earlier output is replaced."""
    sep = SEPARATORS.get(separator, separator)
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def read_pattern(path: str) -> list[tuple[int, int]]:
    """Edges of a pattern file: two ids a line."""
    rows = (x.split() for x in Path(path).read_text().splitlines() if x.strip() and x[0] not in "#%")
    return [(int(a), int(b)) for a, b, *_ in rows]
