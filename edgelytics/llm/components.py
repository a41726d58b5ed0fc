"""Connected components of an edge table, without gathering a component anywhere.

Large-star and small-star steps alternate until the edges no longer change. A step takes
the least neighbour of every node with a combined aggregation and joins it back, so a
hub's rows are split by AQE. Each round is written to the shared folder, which cuts the
lineage; the number of rounds grows with the logarithm of the component sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import stored


def _hang(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour v of u as an edge (v, least neighbour of u)."""
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _hang(both.filter("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = _hang(down, least).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return hung.union(own).filter("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    Nodes are of any ordered type. Repeated edges, either direction and self-loops may
    occur; edges with a null end are left out. No edges give no rows.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    alone = now.select(F.col("a").alias("node"))
    now = stored(now.filter("a != b").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = stored(_small_star(_large_star(now)), "stars")
        after = _state(now)
        if after == state:
            break
        state = after
    joined = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = joined.union(centres)
    loops = alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(loops)
