"""Packed vertices: degree in the high 32 bits, id in the low ones.

The natural order of the packed BIGINT is (degree, id), the total order that
all symmetry-breaking predicates use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1


def pack(vertex: Column, degree: Column) -> Column:
    """The packed vertex; ids outside [0, 2^32) are an error."""
    fits = vertex.between(0, ID_MASK)
    return F.when(fits, F.shiftleft(degree.cast("long"), ID_BITS).bitwiseOR(vertex.cast("long"))).otherwise(F.raise_error(F.lit("vertex ids must be in [0, 2^32)")).cast("long"))


def vertex_id(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(ID_MASK))


def degree(packed: Column) -> Column:
    return F.shiftright(packed, ID_BITS).cast("long")
