"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import BROADCAST_ROWS, small, stored


def _star(edges: DataFrame, larger: bool, rows: int) -> DataFrame:
    """Hang neighbours on the smallest neighbour: of every node its larger ones, or all not larger.

    ``rows`` bounds the edges. The least neighbours are broadcast if they are few, and otherwise stored, so
    that both sides of the join come from plain shuffles whose hot partitions Spark can split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if larger else both.where("a > b")
    least = side.groupBy("a").agg(F.min("b").alias("low"))
    if 2 * rows > BROADCAST_ROWS:
        least, _ = stored(least, "least")
    least = small(least, 2 * rows)
    if larger:
        joined = both.join(least, "a").where("b > a")
        return joined.select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
    hung = side.join(least, "a")
    return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
        least.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    Large-star and small-star rounds: the number of edges never grows, and the number of rounds grows
    with the logarithm of the longest path. Every round is a stored table, so memory and lineage stay
    bounded; hot nodes are pre-aggregated, and their joins are left to Spark's skew handling.
    """
    mark = F.bit_xor(F.xxhash64("a", "b"))
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(pairs, "edges", mark=mark)
    while seen["rows"]:
        last = (seen["rows"], seen["mark"])
        step = _star(_star(now, True, last[0]), False, last[0]).where("a <> b").distinct()
        now, seen = stored(step, "edges", mark=mark)
        if (seen["rows"], seen["mark"]) == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def roots(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """For local edges between 0..count-1, the least index of each one's component."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
