"""Connected components of a graph given as edges, without collecting any of it.

Alternating large-star and small-star rounds: each round links the neighbours of a
node to the least of them, until every node is linked to the least node of its
component and to nothing else.  The number of rounds grows with the logarithm of the
number of nodes.  Minima are found by partial aggregation; hot nodes meet in joins
that adaptive execution can split.  Each round is cut by a checkpoint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import delete, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another, root being the least node reachable."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    (e, at), seen = written(e, "edges"), None
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if not now[0] or now == seen:
            break
        seen = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        before = at
        e, at = written(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        delete(e.sparkSession, before)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over pairs (left, right)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
