"""Connected components of links, distributed.

Large-star and small-star rounds: each hooks a node's greater neighbours, then
its smaller ones, to the least neighbour.  Every round is written to the
shared folder; sums and minima are taken map-side, and the joins that hand a
minimum back to a hub's links stand on two plain exchanges, so that AQE can
split a hub.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


def _hook(links: DataFrame) -> DataFrame:
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    return links.join(least, "u")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1))), F.max("u")).first())


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): for each node u that isn't the least of its component, that least node v.  ``edges``: long columns a, b."""
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = materialize(large, "large-star")
        small = _hook(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        links = materialize(small, "small-star")
        now = _state(links)
        if now == before:
            break
        before = now
    return links


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between any number of nodes: each node that isn't the least of its part, and that least node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    others = label != np.arange(len(nodes))
    return nodes[others], nodes[label[others]]
