"""Every neighbourhood query of a neuron under one filter."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.filters import ALL_EDGES, EdgeFilter
from edgelytics.operators.hops import (
    DOWNSTREAM,
    PATH_ATTRIBUTES,
    UPSTREAM,
    as_chains,
    as_paths,
    check_hops,
    circuit,
    trails,
)
from edgelytics.operators.partners import store_roots
from edgelytics.operators.path_counts import count_trails
from edgelytics.session import materialize

SECTIONS = (
    "presynaptic",
    "postsynaptic",
    "two_hop_upstream",
    "two_hop_downstream",
    "k_hop_upstream",
    "k_hop_downstream",
    "circuit",
)


def neuron_report(
    edges: DataFrame,
    roots: DataFrame,
    k: int = 3,
    flt: EdgeFilter = ALL_EDGES,
    edges_by_dst: DataFrame | None = None,
    degrees: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The rows of the seven sections of the report of each root, by section name.

    Partners, two-hop chains and k-hop paths of one direction are the same trails cut at
    different lengths, so one expansion per direction serves three sections; each length
    is written once. The expansions and the circuit do not depend on each other and run
    side by side. Columns are those of the section's own operator; partners have the
    attributes of paths.
    """
    check_hops(k)
    mirror = edges if edges_by_dst is None else edges_by_dst
    wanted = store_roots(roots)

    def listed(table: DataFrame, direction: tuple[str, str], partners: str, way: str, names: list[str]) -> dict[str, DataFrame]:
        by_length = trails(table, wanted, max(k, 2), flt, direction, degrees=degrees)
        by_length[-1] = materialize(by_length[-1], "trails-last").df
        first = by_length[0]
        second = by_length[1] if len(by_length) > 1 else None
        attributes = [F.col(f"{c}_1").alias(c) for c in PATH_ATTRIBUTES]
        if second is None:  # no first hop: the columns, and no rows
            missing = [F.lit(None).cast(first.schema[f"{c}_1"].dataType).alias(f"{c}_2") for c in PATH_ATTRIBUTES]
            second = first.select("*", F.col("node_1").alias("node_2"), *missing).limit(0)
        paths = [as_paths(t, hops, direction) for hops, t in enumerate(by_length[:k], start=1)]
        return {
            partners: first.select("root_id", F.col("node_1").alias("partner_id"), *attributes),
            f"two_hop_{way}": as_chains(second, names),
            f"k_hop_{way}": reduce(DataFrame.unionByName, paths),
        }

    def circuits() -> dict[str, DataFrame]:
        found = circuit(edges, wanted, k, flt, edges_by_dst=mirror, degrees=degrees)
        return {"circuit": materialize(found, "circuit").df}

    with ThreadPoolExecutor() as pool:
        parts = [
            pool.submit(listed, mirror, UPSTREAM, "presynaptic", "upstream", ["pre1_id", "pre2_id"]),
            pool.submit(listed, edges, DOWNSTREAM, "postsynaptic", "downstream", ["post1_id", "post2_id"]),
            pool.submit(circuits),
        ]
        found = {name: df for part in parts for name, df in part.result().items()}
    return {name: found[name] for name in SECTIONS}


def neuron_report_counts(
    edges: DataFrame,
    roots: DataFrame,
    k: int = 3,
    flt: EdgeFilter = ALL_EDGES,
    edges_by_dst: DataFrame | None = None,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """How many rows each section of `neuron_report` has for each root, as (root_id, section, rows).

    No path is listed for it: see `operators.path_counts`. Circuit rows are counted where
    they are found. The two directions and the circuit run side by side.
    """
    check_hops(k)
    mirror = edges if edges_by_dst is None else edges_by_dst
    wanted = store_roots(roots)

    def counted(table: DataFrame, direction: tuple[str, str], partners: str, way: str) -> DataFrame:
        by_hops = materialize(count_trails(table, wanted, max(k, 2), flt, direction, degrees), "trail-counts").df
        sections = [(partners, F.col("hops") == 1), (f"two_hop_{way}", F.col("hops") == 2), (f"k_hop_{way}", F.col("hops") <= k)]
        return reduce(DataFrame.union, [_summed(by_hops.where(which), section) for section, which in sections])

    def circuits() -> DataFrame:
        found = circuit(edges, wanted, k, flt, edges_by_dst=mirror, degrees=degrees)
        rows = found.groupBy("root_id").agg(F.count("*").alias("rows"))
        return materialize(_summed(rows, "circuit"), "circuit-counts").df

    with ThreadPoolExecutor() as pool:
        parts = [
            pool.submit(counted, mirror, UPSTREAM, "presynaptic", "upstream"),
            pool.submit(counted, edges, DOWNSTREAM, "postsynaptic", "downstream"),
            pool.submit(circuits),
        ]
        found = [part.result() for part in parts]
    none = wanted.df.select(
        "root_id",
        F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"),
        F.lit(0).cast("bigint").alias("rows"),
    )
    return _total(reduce(DataFrame.union, found, none))


def _summed(rows: DataFrame, section: str) -> DataFrame:
    return _total(rows.select("root_id", F.lit(section).alias("section"), "rows"))


def _total(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root_id", "section").agg(F.sum("rows").alias("rows"))
