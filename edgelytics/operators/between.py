"""Trails from one set of neurons to another, grown from both ends.

A trail of m edges is a trail of ceil(m / 2) edges away from a source and one of
floor(m / 2) edges that ends in a target, which meet at a neuron and share no edge. With
d edges at a neuron, both halves hold some d^(k / 2) trails each instead of the d^k that
growing from the sources alone would list before the targets are looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.filters import ALL_EDGES, EdgeFilter
from edgelytics.operators.hops import DOWNSTREAM, MAX_HOPS, PATH_ATTRIBUTES, UPSTREAM, _node, as_paths, check_hops, trails
from edgelytics.operators.hub_join import hub_join
from edgelytics.operators.partners import Roots, store_roots
from edgelytics.session import Stored, materialize


def _stored_roots(edges: DataFrame, roots: Roots) -> Stored:
    if roots is None:
        raise ValueError("both ends are needed; use k_hop_downstream or k_hop_upstream for one")
    if isinstance(roots, Stored):
        return roots
    if isinstance(roots, DataFrame):
        return store_roots(roots.where("root_id is not null"))
    listed = [(int(r),) for r in roots]
    return store_roots(edges.sparkSession.createDataFrame(listed, "root_id long"))


def _halves(edges: DataFrame, roots: Stored, k: int, flt: EdgeFilter, way: tuple[str, str], degrees: DataFrame | None) -> list[DataFrame]:
    """The trails of 1..k edges at one end, each length written: it meets two of the other end."""
    if k == 0:
        return []
    found = trails(edges, roots, k, flt, way, degrees=degrees)
    # all but the last are written as they are grown
    return [*found[:-1], materialize(found[-1], f"half-{way[0]}-{len(found)}").df]


def _same_edge(one: int, two: int) -> Column:
    """Whether two edges of a trail are the same edge."""
    return (
        (F.col(_node(one - 1)) == F.col(_node(two - 1)))
        & (F.col(_node(one)) == F.col(_node(two)))
        & F.col(f"neuropil_{one}").eqNullSafe(F.col(f"neuropil_{two}"))
    )


def _ending(tail: DataFrame, m: int, length: int) -> DataFrame:
    """The second half of a trail of `m` edges, its columns named by their places in the whole."""
    nodes = [F.col(_node(j)).alias(_node(m - j)) for j in range(length)]
    attributes = [F.col(f"{c}_{j}").alias(f"{c}_{m - j + 1}") for j in range(1, length + 1) for c in PATH_ATTRIBUTES]
    return tail.select(F.col(_node(length)).alias("_meet"), *nodes, *attributes)


def paths_between(
    edges: DataFrame,
    sources: Roots,
    targets: Roots,
    k: int = 3,
    flt: EdgeFilter = ALL_EDGES,
    max_hops: int | None = MAX_HOPS,
    edges_by_dst: DataFrame | None = None,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Every trail of 1..k edges from a source to a target, as (root_id, target_id, hops, nodes, edges).

    The rows of `k_hop_downstream` from the sources whose last node is a target: a trail may
    pass through sources and targets on its way, and uses no edge twice. An id that occurs
    several times counts once; one without edges, or a null, has no trail. With
    `edges_by_dst`, the targets' half is grown in that copy.
    """
    check_hops(k, max_hops)
    starts, ends = _stored_roots(edges, sources), _stored_roots(edges, targets)
    mirror = edges if edges_by_dst is None else edges_by_dst
    heads = _halves(edges, starts, (k + 1) // 2, flt, DOWNSTREAM, degrees)
    tails = _halves(mirror, ends, k // 2, flt, UPSTREAM, degrees)
    paths = []
    for m in range(1, k + 1):
        first, second = (m + 1) // 2, m // 2
        if first > len(heads) or second > len(tails):
            break  # one half is never that long
        head = heads[first - 1]
        if second == 0:
            whole = head.join(ends.df.withColumnRenamed("root_id", "_end"), F.col(_node(first)) == F.col("_end"), "left_semi")
        else:
            whole = hub_join(head, _node(first), _ending(tails[second - 1], m, second), "_meet").drop("_meet")
            for one, two in product(range(1, first + 1), range(first + 1, m + 1)):
                whole = whole.where(~_same_edge(one, two))
        paths.append(as_paths(whole, m, DOWNSTREAM))
    found = reduce(DataFrame.unionByName, paths)
    return found.select("root_id", F.element_at("nodes", -1).alias("target_id"), "hops", "nodes", "edges")
