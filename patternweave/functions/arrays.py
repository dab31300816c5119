"""Arithmetic and sorted-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs(n: Column) -> Column:
    """n choose 2, in whole numbers."""
    return F.shiftright(n * (n - 1), 1)


def binomial(n: Column, k: int) -> Column:
    """n choose k, exact at each step; 0 where n < k."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.call_function("div", out * (n.cast("long") - i), F.lit(i + 1).cast("long")) if i else n.cast("long")
    return F.when(n >= k, out).otherwise(F.lit(0).cast("long")) if k else F.lit(1).cast("long")


def common(a: Column, b: Column) -> Column:
    """Number of elements that two sets (as arrays) share."""
    return F.size(F.array_intersect(a, b)).cast("long")


def upto(array: Column, bound: Column) -> Column:
    """Number of elements that are at most ``bound``."""
    return F.size(F.filter(array, lambda x: x <= bound)).cast("long")


def chunks(array: Column, size: int) -> Column:
    """Consecutive chunks of ``size`` elements; a last one of at most a tenth of that joins the one before."""
    n = F.size(array)
    slack = size // 10
    count = F.greatest(F.lit(1), F.floor((n + size - 1 - slack) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(array, i * size + 1, F.when(i == count - 1, F.greatest(n - i * size, F.lit(0))).otherwise(F.lit(size))))
