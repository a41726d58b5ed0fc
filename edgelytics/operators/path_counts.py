"""Numbers of trails, without listing the trails.

The last two edges of a trail are counted, not joined. Let a trail of m edges U end at
neuron v. An edge e leaves v, and f leaves e's far end; e must not be in U, f neither in
U nor e itself. With out(x) the edges that leave x, loops(x) those that return to x at
once, and pairs(x, y) those from x to y, the ways to choose e and f among all edges are

    the sum of out(y) over the edges from v to y, less loops(v),
    less pairs(v, source of u) for each u in U (f would be u),

and what these count for an e that is itself in U goes off again: for each u in U that
leaves v towards y, out(y), less 1 if u is a loop, less the number of edges of U that leave y.
Only the neurons that trails matter, not the regions, so trails with the same neurons are
grouped. Trails of k edges need those of k - 2 only: none for k = 2, the roots' edges for 3.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.filters import ALL_EDGES, EdgeFilter
from edgelytics.operators.hops import DOWNSTREAM, _node, trails
from edgelytics.operators.lookup import near_table, split_columns
from edgelytics.operators.partners import edges_of
from edgelytics.session import Stored, materialize


def _pairs(usable: DataFrame, near: str, far: str, of: Stored) -> DataFrame:
    """(x, y, pairs): how many edges lead from each neuron of `of` to each of its partners."""
    found = near_table(usable, near, of, "x").join(of.df, F.col(near) == F.col("x"))
    return found.groupBy("x", F.col(far).alias("y")).agg(F.count("*").alias("pairs"))


def _leaving(usable: DataFrame, near: str, far: str, of: Stored) -> DataFrame:
    """(x, out): how many edges leave each neuron of `of` that any edge leaves."""
    found = near_table(usable, near, of, "x").join(of.df, F.col(near) == F.col("x"))
    return found.groupBy("x").agg(F.count("*").alias("out"))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _two_more(usable: DataFrame, near: str, far: str, grouped: DataFrame, m: int) -> DataFrame:
    """(root_id, rows): how many ways the grouped trails of `m` edges go on by two edges."""
    ends = materialize(grouped.select(F.col(_node(m)).alias("x")).distinct(), "path-ends")
    pairs = materialize(_pairs(usable, near, far, ends), "path-pairs").df
    on_trail = [grouped.select(F.col(_node(i)).alias("x")) for i in range(m + 1)]
    reached = reduce(DataFrame.union, on_trail, pairs.select(F.col("y").alias("x"))).distinct()
    out = materialize(_leaving(usable, near, far, materialize(reached, "path-reached")), "path-out").df
    # out, loops, and the sum of out over the partners, of each neuron at a trail's end
    ahead = (
        pairs.join(out.withColumnsRenamed({"x": "y", "out": "_next"}), "y", "left")
        .groupBy("x")
        .agg(
            F.sum(F.col("pairs") * _zero("_next")).alias("_ahead"),
            F.sum(F.when(F.col("x") == F.col("y"), F.col("pairs")).otherwise(0)).alias("_loops"),
        )
    )
    end = _node(m)
    rows = grouped.join(ahead, F.col(end) == F.col("x"), "left").drop("x")
    ways = _zero("_ahead") - _zero("_loops")
    for i in range(m):  # the edge u_i leaves node i for node i + 1
        source, target = F.col(_node(i)), F.col(_node(i + 1))
        back = pairs.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("pairs").alias(f"_back{i}"))
        rows = rows.join(back, (F.col(end) == F.col("_x")) & (source == F.col("_y")), "left").drop("_x", "_y")
        leaving = out.select(F.col("x").alias("_x"), F.col("out").alias(f"_out{i}"))
        rows = rows.join(leaving, target == F.col("_x"), "left").drop("_x")
        used = [F.when(F.col(_node(j)) == target, 1).otherwise(0) for j in range(m)]
        again = _zero(f"_out{i}") - F.when(source == target, 1).otherwise(0) - reduce(Column.__add__, used)
        ways = ways - _zero(f"_back{i}") - F.when(source == F.col(end), again).otherwise(0)
    return rows.groupBy("root_id").agg(F.sum(F.col("_times") * ways).alias("rows"))


def count_trails(
    edges: DataFrame,
    roots: Stored,
    k: int,
    flt: EdgeFilter = ALL_EDGES,
    direction: tuple[str, str] = DOWNSTREAM,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """(root_id, hops, rows): how many trails of each length 1..k the roots have.

    The numbers of rows that `trails` lists; a root and length without any may be absent
    or 0. Trails are listed up to a length of k - 2, and the roots' own edges.
    """
    near, far = direction
    usable = edges.where(flt.condition).select("src", "dst", "neuropil", *split_columns(edges))
    first = edges_of(usable, roots, near).select("root_id", F.col(far).alias("node_1"))
    first = materialize(first.groupBy("root_id", "node_1").agg(F.count("*").alias("_times")), "path-first").df
    counts = [first.groupBy("root_id").agg(F.sum("_times").alias("rows")).select("root_id", F.lit(1).alias("hops"), "rows")]
    listed = trails(edges, roots, k - 2, flt, direction, ["neuropil"], degrees) if k > 3 else []
    for length in range(2, k + 1):
        m = length - 2
        if m == 0:
            grouped = roots.df.select("root_id", F.lit(1).alias("_times"))
        elif m == 1:
            grouped = first
        elif m > len(listed):  # no trail is that long
            break
        else:
            nodes = ["root_id", *[_node(i) for i in range(1, m + 1)]]
            grouped = materialize(listed[m - 1].groupBy(*nodes).agg(F.count("*").alias("_times")), "path-groups").df
        found = _two_more(usable, near, far, grouped, m)
        counts.append(found.select("root_id", F.lit(length).alias("hops"), "rows"))
    return reduce(DataFrame.union, counts)
