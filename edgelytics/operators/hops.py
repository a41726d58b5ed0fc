"""Multi-hop graph queries: trails, reachable neurons and induced circuits.

A trail may visit a neuron again but never uses the same edge twice. Filters hold
for every edge of a trail, so edges are filtered before any join.

Every hop is one equi-join on a neuron id, whose hubs `hub_join` deals to many tasks.
A frontier is written to shared storage before it is used again: each hop is then
computed once, and Spark knows its size when it chooses how to join. `degrees` (root_id,
out_deg, in_deg), which a stored graph has, spares counting the edges for it; the numbers
may be those of more edges than are passed, so they need not fit the filter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.filters import ALL_EDGES, EdgeFilter
from edgelytics.operators import hub_join as hub
from edgelytics.operators.hub_join import hub_join, sized_join, tasks_for
from edgelytics.operators.lookup import near_table, split_columns
from edgelytics.operators.partners import Roots, edges_of, store_roots
from edgelytics.schema import PATH_EDGE
from edgelytics.session import Stored, materialize

MAX_HOPS = 5
# Roots that one row lists, about, where the roots near a node are packed.
PACK_ROOTS = 4096
DOWNSTREAM = ("src", "dst")
UPSTREAM = ("dst", "src")
EDGE_TEXT = "edge_text"
PATH_ATTRIBUTES = ["syn_count", "neuropil", "dominant_nt", "dominant_score"]


def check_hops(k: int, max_hops: int | None = MAX_HOPS) -> int:
    if k < 1 or (max_hops is not None and k > max_hops):
        raise ValueError(f"k must be between 1 and {max_hops}")
    return k


def _node(hop: int) -> str:
    return "root_id" if hop == 0 else f"node_{hop}"


def _step(edges: DataFrame, far: str, hop: int) -> list[Column]:
    attributes = [c for c in edges.columns if c not in (*DOWNSTREAM, *split_columns(edges))]
    return [F.col(far).alias(_node(hop)), *[F.col(c).alias(f"{c}_{hop}") for c in attributes]]


def _known(degrees: DataFrame | None, end: str) -> DataFrame | None:
    """(neuron, edges that have it at `end`), where it is known."""
    if degrees is None:
        return None
    return degrees.select("root_id", "out_deg" if end == "src" else "in_deg")


def _extend(
    trails: DataFrame,
    edges: DataFrame,
    hop: int,
    near: str,
    far: str,
    degrees: DataFrame | None = None,
    all_edges: bool = False,
) -> DataFrame:
    """Join the edges that continue each trail at its last node, minus those it has used.
    `all_edges`: the trails are the edge table itself."""
    step = edges.select(F.col(near).alias("near"), *_step(edges, far, hop))
    fresh = F.lit(True)
    for used in range(1, hop):
        same_edge = (
            (F.col(_node(used - 1)) == F.col("near"))
            & (F.col(_node(used)) == F.col(_node(hop)))
            & F.col(f"neuropil_{used}").eqNullSafe(F.col(f"neuropil_{hop}"))
        )
        fresh &= ~same_edge
    arriving = _known(degrees, far) if all_edges else None
    joined = hub_join(trails, _node(hop - 1), step, "near", arriving, _known(degrees, near))
    return joined.where(fresh).drop("near")


def trails(
    edges: DataFrame,
    roots: Roots,
    k: int,
    flt: EdgeFilter = ALL_EDGES,
    direction: tuple[str, str] = DOWNSTREAM,
    attributes: Sequence[str] = PATH_ATTRIBUTES,
    degrees: DataFrame | None = None,
) -> list[DataFrame]:
    """The trails of each length 1..k away from the roots, one flat table per length.

    Columns: root_id, then per hop i the node reached and the attributes of edge i,
    which must include the region as a part of the edge key. Edge 1 touches the root.
    Once a length has no trail, its empty table is the last one.
    """
    near, far = direction
    usable = edges.where(flt.condition).select("src", "dst", *attributes, *split_columns(edges))
    current = edges_of(usable, roots, near).select("root_id", *_step(usable, far, 1))
    lengths = [current]
    for hop in range(2, k + 1):
        whole = hop == 2 and roots is None
        if whole:
            # The edge table itself: nothing to save by writing it again.
            frontier, nearby = current, usable
        else:
            stored = materialize(current, f"trails-{hop - 1}")
            lengths[-1] = stored.df
            if stored.rows == 0:
                break
            frontier = stored.df
            nearby = near_table(usable, near, stored, _node(hop - 1))
        current = _extend(frontier, nearby, hop, near, far, degrees, whole)
        lengths.append(current)
    return lengths


def as_paths(trails_of_length: DataFrame, hops: int, direction: tuple[str, str]) -> DataFrame:
    """Flat trails as (root_id, hops, nodes, edges), nodes in edge direction."""
    nodes = [F.col(_node(i)) for i in range(hops + 1)]
    ends = [(i - 1, i) if direction == DOWNSTREAM else (i, i - 1) for i in range(1, hops + 1)]
    steps = [
        F.struct(
            F.col(_node(source)).alias("source_id"),
            F.col(_node(target)).alias("target_id"),
            *[F.col(f"{c}_{max(source, target)}").alias(c) for c in PATH_ATTRIBUTES],
        ).cast(PATH_EDGE)
        for source, target in ends
    ]
    if direction == UPSTREAM:
        nodes, steps = nodes[::-1], steps[::-1]
    return trails_of_length.select(
        "root_id",
        F.lit(hops).alias("hops"),
        F.array(*nodes).alias("nodes"),
        F.array(*steps).alias("edges"),
    )


def _as_texts(trails_of_length: DataFrame, hops: int, direction: tuple[str, str]) -> DataFrame:
    """The same for trails whose edges are texts: nodes joined by `>`, edges by `;`."""
    nodes = [F.col(_node(i)).cast("string") for i in range(hops + 1)]
    steps = [F.col(f"{EDGE_TEXT}_{i}") for i in range(1, hops + 1)]
    if direction == UPSTREAM:
        nodes, steps = nodes[::-1], steps[::-1]
    return trails_of_length.select(
        "root_id",
        F.lit(hops).alias("hops"),
        F.concat_ws(">", *nodes).alias("nodes"),
        F.concat_ws(";", *steps).alias("edges"),
    )


def _k_hop(
    edges: DataFrame,
    roots: Roots,
    k: int,
    flt: EdgeFilter,
    direction: tuple[str, str],
    max_hops: int | None,
    degrees: DataFrame | None,
    text: bool,
) -> DataFrame:
    if text:
        # there are many times more trails than edges, so an edge is put into words before any join
        edge = F.struct(*DOWNSTREAM, *PATH_ATTRIBUTES).cast(PATH_EDGE).cast("string")
        worded = edges.withColumn(EDGE_TEXT, edge)
        by_length = trails(worded, roots, check_hops(k, max_hops), flt, direction, ["neuropil", EDGE_TEXT], degrees)
        return reduce(DataFrame.unionByName, [_as_texts(t, hops, direction) for hops, t in enumerate(by_length, start=1)])
    by_length = trails(edges, roots, check_hops(k, max_hops), flt, direction, degrees=degrees)
    paths = [as_paths(t, hops, direction) for hops, t in enumerate(by_length, start=1)]
    return reduce(DataFrame.unionByName, paths)


def k_hop_downstream(
    edges: DataFrame,
    roots: Roots = None,
    k: int = 2,
    flt: EdgeFilter = ALL_EDGES,
    max_hops: int | None = MAX_HOPS,
    degrees: DataFrame | None = None,
    text: bool = False,
) -> DataFrame:
    """Every trail of 1..k edges that leaves a root, as (root_id, hops, nodes, edges).
    With `text`, nodes and edges are texts: joined by `>` and `;`, each edge as Spark prints it."""
    return _k_hop(edges, roots, k, flt, DOWNSTREAM, max_hops, degrees, text)


def k_hop_upstream(
    edges: DataFrame,
    roots: Roots = None,
    k: int = 2,
    flt: EdgeFilter = ALL_EDGES,
    max_hops: int | None = MAX_HOPS,
    degrees: DataFrame | None = None,
    text: bool = False,
) -> DataFrame:
    """Every trail of 1..k edges that ends in a root; nodes run from the far end to the root.
    `text` as in `k_hop_downstream`."""
    return _k_hop(edges, roots, k, flt, UPSTREAM, max_hops, degrees, text)


def path_preview(paths: DataFrame) -> DataFrame:
    """Length, first and last node, and node and edge counts of each path."""
    return paths.select(
        "root_id",
        (F.size("nodes") - 1).alias("hops"),
        F.element_at("nodes", 1).alias("start"),
        F.element_at("nodes", -1).alias("end"),
        F.size("nodes").alias("nodes"),
        F.size("edges").alias("edges"),
    )


def _two_hop(
    edges: DataFrame,
    roots: Roots,
    flt: EdgeFilter,
    direction: tuple[str, str],
    names: list[str],
    degrees: DataFrame | None,
) -> DataFrame:
    attributes = ["syn_count", "neuropil"]
    by_length = trails(edges, roots, 2, flt, direction, attributes, degrees)
    if len(by_length) == 1:  # no first hop, so this has the right columns and no rows
        by_length.append(_extend(by_length[0], edges.select("src", "dst", *attributes), 2, *direction))
    return as_chains(by_length[1], names)


def as_chains(trails_of_two: DataFrame, names: Sequence[str]) -> DataFrame:
    """Flat trails of two edges as (root_id, the two nodes by name, attributes of both edges)."""
    first, second = names
    return trails_of_two.select(
        "root_id",
        F.col("node_1").alias(first),
        F.col("node_2").alias(second),
        *[f"{c}_{hop}" for c in ("syn_count", "neuropil") for hop in (1, 2)],
    )


def two_hop_upstream(
    edges: DataFrame,
    roots: Roots = None,
    flt: EdgeFilter = ALL_EDGES,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Chains pre2 -> pre1 -> root. Attributes `_1` belong to the edge at the root."""
    return _two_hop(edges, roots, flt, UPSTREAM, ["pre1_id", "pre2_id"], degrees)


def two_hop_downstream(
    edges: DataFrame,
    roots: Roots = None,
    flt: EdgeFilter = ALL_EDGES,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Chains root -> post1 -> post2. Attributes `_1` belong to the edge at the root."""
    return _two_hop(edges, roots, flt, DOWNSTREAM, ["post1_id", "post2_id"], degrees)


def _neighbours(usable: dict[str, DataFrame], frontier: Stored, degrees: DataFrame | None) -> tuple[DataFrame, int]:
    """(root_id, node_id) of all neighbours, in either direction, of a frontier's nodes, as
    often as edges reach them; and how many rows these are at most."""
    ways, rows = [], 0
    roots_of = materialize(frontier.df.groupBy("node_id").agg(F.count("*").alias("roots")), "frontier-counts").df
    for near, table in usable.items():
        nearby = near_table(table, near, frontier, "node_id")
        joined, made = sized_join(frontier.df, "node_id", nearby, near, roots_of, _known(degrees, near), left_exact=True)
        ways.append(joined.select("root_id", F.col("dst" if near == "src" else "src").alias("node_id")))
        rows += made
    return ways[0].union(ways[1]), rows


def _most(pairs: DataFrame, key: str) -> int:
    """The rows of the key that has most."""
    return pairs.groupBy(key).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0] or 0


def _pair_keys(pairs: Stored, rows: int, degrees: DataFrame | None, far: str) -> list[str]:
    """What to deal (root_id, `far`) by that edges of `pairs` (root_id, node_id) reach, `rows`
    in all: the root alone, whose pairs then lie together and pack well, where no root can
    reach more than a task's share; else both."""
    if degrees is None or tasks_for(pairs.df.sparkSession, rows) is None:
        return ["root_id", far]
    widest = degrees.agg(F.max(F.col("out_deg") + F.col("in_deg"))).first()[0] or 0
    return ["root_id"] if _most(pairs.df, "root_id") * widest <= hub.CELL_ROWS else ["root_id", far]


def _dealt(pairs: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """`pairs` where those with equal keys meet, in as many tasks as `rows` of them need: a hash
    table of them, or a sort, then fits a task. They come from joins, which make more than
    they read, so they are combined after this shuffle only."""
    tasks = tasks_for(pairs.sparkSession, rows)
    return pairs if tasks is None else pairs.repartition(tasks, *keys)


def _nearby(
    edges: DataFrame,
    roots: Roots,
    k: int,
    flt: EdgeFilter,
    max_hops: int | None,
    edges_by_dst: DataFrame | None,
    degrees: DataFrame | None,
) -> tuple[DataFrame, Stored]:
    """`k_hop_nodes`, and the level that the last hop started from."""
    check_hops(k, max_hops)
    mirror = edges if edges_by_dst is None else edges_by_dst
    usable = {
        end: table.where(flt.condition).select("src", "dst", *split_columns(table))
        for end, table in (("src", edges), ("dst", mirror))
    }
    if isinstance(roots, DataFrame):
        roots = store_roots(roots)
    outgoing = edges_of(usable["src"], roots, "src").select("root_id", F.col("dst").alias("node_id"))
    incoming = edges_of(usable["dst"], roots, "dst").select("root_id", F.col("src").alias("node_id"))
    touched = materialize(outgoing.union(incoming).distinct(), "nodes-1").df
    itself = touched.select("root_id", F.col("root_id").alias("node_id")).distinct()
    levels = [itself, touched.where("node_id <> root_id")]
    frontier = Stored(itself if k == 1 else levels[-1])
    for hop in range(2, k + 1):
        if hop > 2:
            frontier = materialize(levels[-1], f"nodes-{hop - 1}")
            levels[-1] = frontier.df
        if frontier.rows == 0:
            break
        reached, rows = _neighbours(usable, frontier, degrees)
        keys = _pair_keys(frontier, rows, degrees, "node_id")
        if hop == k:  # no level of its own is needed: these are all levels together
            levels = [_dealt(reduce(DataFrame.union, [*levels, reached]), rows, keys).distinct()]
        else:
            near = levels[-2].union(levels[-1])
            marked = near.withColumn("known", F.lit(True)).union(reached.withColumn("known", F.lit(False)))
            found = _dealt(marked, rows, keys).groupBy("root_id", "node_id").agg(F.max("known").alias("known"))
            levels.append(found.where(~F.col("known")).drop("known"))
    return reduce(DataFrame.union, levels), frontier


def k_hop_nodes(
    edges: DataFrame,
    roots: Roots = None,
    k: int = 3,
    flt: EdgeFilter = ALL_EDGES,
    max_hops: int | None = MAX_HOPS,
    edges_by_dst: DataFrame | None = None,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Neurons within k edges of each root, direction ignored, as (root_id, node_id).

    Includes the root, and is empty for a root without a passing edge. Breadth-first:
    a node at distance d has its neighbours at distance d-1, d or d+1, so a new level
    is the neighbours of the last one without the last two levels. No trail is listed.
    With `edges_by_dst`, incoming edges are looked up in that copy.
    """
    return _nearby(edges, roots, k, flt, max_hops, edges_by_dst, degrees)[0]


def _near_roots(pairs: DataFrame, roots: Roots, most: int) -> tuple[Stored, int]:
    """The roots near each node of (root_id, node_id), as (node_id, part, roots), stored, and
    how many parts there are.

    In a shuffle, a list of roots takes far less than a row for each. The same root lies in the same
    part for every node, so the parts of two nodes are compared one by one; there are as many
    as keep a list to PACK_ROOTS, about. `most`: the nodes near a root, at most.
    """
    if roots is None:  # steps count in either direction: the roots near a node are the nodes near it as a root
        pairs = pairs.toDF("node_id", "root_id")
    else:
        pairs = materialize(pairs, "circuit-nodes").df
        most = _most(pairs, "node_id")
    parts = max(1, math.ceil(most / PACK_ROOTS))
    part = F.pmod(F.xxhash64("root_id"), F.lit(parts)).cast("int")
    packed = pairs.withColumn("part", part).groupBy("node_id", "part").agg(F.collect_list("root_id").alias("roots"))
    return materialize(packed, "circuit-roots"), parts


def circuit(
    edges: DataFrame,
    roots: Roots = None,
    k: int = 3,
    flt: EdgeFilter = ALL_EDGES,
    max_hops: int | None = MAX_HOPS,
    edges_by_dst: DataFrame | None = None,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Passing edges with both ends within k undirected hops of a root, per root."""
    if isinstance(roots, DataFrame):
        roots = store_roots(roots)
    nodes, last = _nearby(edges, roots, k, flt, max_hops, edges_by_dst, degrees)
    usable = edges.where(flt.condition).select("src", "dst", "neuropil", "syn_count", "dominant_nt", *split_columns(edges))
    usable = usable if roots is not None else materialize(usable, "circuit-edges").df
    widest = _most(usable, "src") + _most(usable, "dst") if roots is None else 0
    near, parts = _near_roots(nodes, roots, (1 + _most(last.df, "root_id")) * widest)
    packed = near.df.where("node_id is not null and part is not null")
    if roots is not None:  # only edges with both ends near any root can lie in a circuit
        usable = near_table(usable, "src", near, "node_id")
        anywhere = materialize(packed.select("node_id").distinct(), "circuit-members").df
        for end in ("src", "dst"):
            usable = usable.join(anywhere, F.col(end) == F.col("node_id"), "left_semi")
        usable = materialize(usable, "circuit-edges").df
    usable = usable.drop(*split_columns(edges))
    leaving, pairs = sized_join(usable, "src", packed, "node_id", right_weight=F.size("roots"))
    leaving = leaving.drop("node_id")
    tasks = tasks_for(edges.sparkSession, pairs)
    if tasks is not None:  # the lists are dealt as for the join before, so once for both
        leaving, packed = leaving.repartition(tasks, "dst"), packed.repartition(tasks, "node_id")
    arriving = packed.select(F.col("node_id").alias("dst"), "part", F.col("roots").alias("others"))
    if parts == 1:  # a key fewer, so that the lists stay as they are dealt
        leaving, arriving, same = leaving.drop("part"), arriving.drop("part"), ["dst"]
    else:
        same = ["dst", "part"]
    return leaving.join(arriving, same).select(
        F.explode(F.array_intersect("roots", "others")).alias("root_id"),
        F.col("src").alias("source_root_id"),
        F.col("dst").alias("target_root_id"),
        "neuropil",
        "syn_count",
        "dominant_nt",
    )


def circuit_documents(connections: DataFrame, pieces: int) -> DataFrame:
    """Circuit rows nested as documents, as (root_id, piece, circuits[0].connections[]).

    Every root's connections are dealt to `pieces` documents, 0 to pieces - 1, by the sum
    of their two neuron ids, whatever the circuit's size; pieces without a connection have
    no row. Choose as many as keep a piece of the largest circuit small enough for a task.
    """
    columns = [c for c in connections.columns if c != "root_id"]
    ends = F.col("source_root_id") + F.col("target_root_id")
    piece = F.pmod(ends, F.lit(pieces)).cast("int").alias("piece")
    spread = connections.select("root_id", piece, F.struct(*columns).alias("row"))
    nested = spread.groupBy("root_id", "piece").agg(
        F.sort_array(F.collect_list("row")).alias("connections")
    )
    return nested.select("root_id", "piece", F.array(F.struct("connections")).alias("circuits"))
