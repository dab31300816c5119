"""A graph and what is derived from it, each part built once when first asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vertex import vertex_id
from .operators import blocks, prepare, wedges
from .sources.edges import read_edge_table, read_edge_text, read_pattern


class Graph:
    """An undirected simple graph.

    Raw edges may hold loops, duplicates and both directions.  Derived parts
    are DataFrames; with ``keep`` they are persisted (memory, then disk), which
    pays off if several queries run on one graph.  ``undirected`` promises that
    each edge stands in one row, in either direction, so none is sought twice.
    ``parts`` is how many parts edges are prepared in (None: as Spark is set).
    """

    def __init__(self, raw: DataFrame, keep: bool = False, prune: bool = False, undirected: bool = False, parts: int | None = None):
        self.raw, self.keep, self.prune, self.undirected, self.parts = raw, keep, prune, undirected, parts
        self._kept: list[DataFrame] = []

    @classmethod
    def from_text(cls, spark: SparkSession, path: str | list[str], separator: str = "default", **more: bool) -> Graph:
        return cls(read_edge_text(spark, path, separator), **more)

    @classmethod
    def from_table(cls, spark: SparkSession, path: str, src: str = "src", dst: str = "dst", **more: bool) -> Graph:
        return cls(read_edge_table(spark, path, src, dst), **more)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **more: bool) -> Graph:
        """A small graph from a file that the driver reads: two ids a line, # and % begin comments."""
        return cls.from_pairs(spark, read_pattern(path), **more)

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: list[tuple[int, int]], **more: bool) -> Graph:
        return cls(spark.createDataFrame(pairs, "src long, dst long"), **more)

    def _hold(self, df: DataFrame) -> DataFrame:
        if self.keep:
            self._kept.append(df.persist())
        return df

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    @cached_property
    def edges(self) -> DataFrame:
        """(a, b), a < b by id, distinct."""
        return self._hold(prepare.undirect(self.raw, not self.undirected, self.parts))

    @cached_property
    def degrees(self) -> DataFrame:
        return self._hold(prepare.degrees(self.edges))

    @cached_property
    def oriented(self) -> DataFrame:
        """Packed edges (u, w), u < w."""
        out = prepare.orient(self.edges, self.degrees, self.parts)
        return self._hold(prepare.prune_leaves(out) if self.prune else out)

    @cached_property
    def adjacent(self) -> DataFrame:
        return prepare.both_ways(self.oriented)

    @cached_property
    def colours(self) -> blocks.Colours:
        """Parts of the vertices, from their degrees: the plan of blocks."""
        return blocks.Colours.of(self.degrees)

    @cached_property
    def triangles(self) -> DataFrame:
        return self._hold(blocks.triangles(self))

    @cached_property
    def edge_apexes(self) -> DataFrame:
        return wedges.edge_apexes(self.triangles)

    @cached_property
    def met(self) -> DataFrame:
        """(x, y, mids): the sorted centres of all wedges on x < y where there are two or more."""
        return self._hold(blocks.met_wedges(self))

    @cached_property
    def wedges(self) -> DataFrame:
        return wedges.wedges(self.oriented)

    def with_edges(self, pairs: list[tuple[int, int]]) -> Graph:
        """The graph with more edges."""
        more = self.raw.sparkSession.createDataFrame(pairs, "src long, dst long")
        return Graph(self.raw.select("src", "dst").union(more), self.keep, self.prune, parts=self.parts)

    def without_edges(self, pairs: list[tuple[int, int]]) -> Graph:
        """The graph without some edges, given in either direction."""
        gone = self.raw.sparkSession.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
        return Graph(self.edges.join(gone, ["a", "b"], "left_anti").toDF("src", "dst"), self.keep, self.prune, undirected=True, parts=self.parts)

    def without_vertices(self, ids: list[int]) -> Graph:
        gone = self.raw.sparkSession.createDataFrame([(i,) for i in ids], "v long")
        left = self.edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti")
        return Graph(left.select("a", "b").toDF("src", "dst"), self.keep, self.prune, undirected=True, parts=self.parts)

    @staticmethod
    def ids(df: DataFrame) -> DataFrame:
        """Packed BIGINT columns as vertex ids; others as they are."""
        packed = {"u", "w", "v", "n", "x", "y", "z", "c", "a", "b", "p", "q", "hub"}
        return df.select(*(vertex_id(F.col(c)).alias(c) if (c in packed or c[1:].isdigit()) and t == "bigint" else F.col(c) for c, t in df.dtypes))
