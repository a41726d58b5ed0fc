"""One-hop graph queries.

`roots` is None (every neuron), a list of ids, or a table with `root_id`. A table that
serves several queries may be passed as `Stored`; its ids must then be distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.filters import ALL_EDGES, EdgeFilter
from edgelytics.operators.lookup import near_ids, near_table
from edgelytics.schema import NEURONS, NT_COLUMNS
from edgelytics.session import Stored, materialize

Roots = DataFrame | Stored | Sequence[int] | None

# Up to this many ids become a plain predicate, which the Parquet scan can use to
# skip row groups; a longer list becomes a join.
LITERAL_IDS = 1_000


def edges_of(edges: DataFrame, roots: Roots, end: str) -> DataFrame:
    """The edges whose `end` column is a root, with that neuron as `root_id`.

    Without roots nothing is joined: every edge belongs to the neuron at its `end`.
    """
    if roots is None:
        return edges.withColumn("root_id", F.col(end))
    if not isinstance(roots, DataFrame | Stored):
        ids = sorted({int(r) for r in roots})
        if len(ids) <= LITERAL_IDS:
            found = near_ids(edges, end, ids).where(F.col(end).isin(ids))
            return found.withColumn("root_id", F.col(end))
        roots = edges.sparkSession.createDataFrame([(r,) for r in ids], NEURONS)
    wanted = roots if isinstance(roots, Stored) else store_roots(roots)
    nearby = near_table(edges, end, wanted, "root_id")
    return nearby.join(wanted.df, F.col(end) == F.col("root_id"))


def store_roots(roots: DataFrame) -> Stored:
    """The distinct roots as a written table: they are often the result of a large
    query, which then runs only once."""
    return materialize(roots.select("root_id").distinct(), "roots")


def _partners(edges: DataFrame, roots: Roots, near: str, far: str, flt: EdgeFilter) -> DataFrame:
    found = edges_of(edges.where(flt.condition), roots, near)
    return found.select(
        "root_id",
        F.col(far).alias("partner_id"),
        "syn_count",
        "neuropil",
        "dominant_nt",
        "dominant_score",
        *NT_COLUMNS,
    )


def postsynaptic(edges: DataFrame, roots: Roots = None, flt: EdgeFilter = ALL_EDGES) -> DataFrame:
    """Direct partners that a root sends to. See `strongest_first` for the listing order."""
    return _partners(edges, roots, "src", "dst", flt)


def presynaptic(edges: DataFrame, roots: Roots = None, flt: EdgeFilter = ALL_EDGES) -> DataFrame:
    """Direct partners that a root receives from."""
    return _partners(edges, roots, "dst", "src", flt)


def strongest_first(partners: DataFrame) -> DataFrame:
    """Order a partner listing per root by descending synapse count, ties by id and region."""
    return partners.orderBy("root_id", F.desc("syn_count"), "partner_id", "neuropil")


def preview(partners: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` rows of a partner listing."""
    return strongest_first(partners).limit(n)


def outgoing_edges(edges: DataFrame, roots: Roots = None) -> DataFrame:
    """Every outgoing edge of the roots, unfiltered."""
    return edges_of(edges, roots, "src").select(
        F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "syn_count", "neuropil"
    )


def dataset_pairs(
    edges: DataFrame, limit: int, flt: EdgeFilter = EdgeFilter(threshold=1)
) -> DataFrame:
    """The `limit` strongest connections under a filter, as (pre, post, region) rows."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    listed = edges.where(flt.condition).select(
        F.col("src").alias("pre_id"),
        F.col("dst").alias("post_id"),
        "syn_count",
        "dominant_nt",
        "neuropil",
    )
    order = [F.desc("syn_count"), "pre_id", "post_id", "neuropil", "dominant_nt"]
    return listed.orderBy(*order).limit(limit)


def gold_pairs(
    gold: DataFrame, limit: int, flt: EdgeFilter = EdgeFilter(threshold=1)
) -> DataFrame:
    """`dataset_pairs` straight from the region-partitioned dataset, where only the
    directory of the requested region is read. Rows with a null id are skipped."""
    ends = F.col("pre_pt_root_id").isNotNull() & F.col("post_pt_root_id").isNotNull()
    as_edges = gold.where(ends).withColumnsRenamed(
        {"pre_pt_root_id": "src", "post_pt_root_id": "dst"}
    )
    return dataset_pairs(as_edges, limit, flt)
