"""Connected components by alternating large-star and small-star steps.

Edges and labels stay in DataFrames; each step is two shuffles.  Minima have
map-side partial aggregation, and the join of edges with minima is an inner
sort-merge join, so a hub with a third of all edges is split by adaptive
execution.  Each round is written to the shared folder.  The number of
rounds is logarithmic in practice and not capped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    down2 = moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return down2.unionByName(own).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node without any."""
    per = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    centres = edges.select(F.col("v").alias("u")).distinct().withColumn("c", F.lit(1))
    return per.join(centres, "u", "left").where("n > 1 OR c IS NOT NULL").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node on an edge.

    Null ends are dropped; a node linked only to itself is its own component.
    """
    pairs = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    loops = pairs.where("u = v").select("u")
    now = pairs.where("u <> v")
    while not _stars(now):
        now = stored(_small(stored(_large(now), "stars")), "stars")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return (found.unionByName(roots).unionByName(alone)
            .groupBy("node").agg(F.min("component").alias("component")))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] (labels point to smaller indices)."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
