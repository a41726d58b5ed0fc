"""Synapse-count histograms.

`connection_cube` counts raw rows by (region, dominant-NT text, synapse count) in
one pass. Counts add up, so cubes of separate inputs merge by summing, and every
histogram, total, quantile and tail below is a roll-up of this small table. Tied
rows are spread over their labels only after counting, never on the raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import explode_nt
from edgelytics.schema import CUBE, require_columns


def connection_cube(gold: DataFrame) -> DataFrame:
    """Row counts by (neuropil, dominant_nt, syn_count); null keys are kept."""
    require_columns(gold, ["neuropil", "dominant_nt", "syn_count"])
    counted = gold.groupBy("neuropil", "dominant_nt", "syn_count").agg(F.count("*").alias("count"))
    return counted.select(CUBE.names)


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all inputs together."""
    keys = ["neuropil", "dominant_nt", "syn_count"]
    merged = reduce(DataFrame.unionByName, cubes).groupBy(keys)
    return merged.agg(F.sum("count").alias("count"))


def _histogram(cube: DataFrame, *keys: str) -> DataFrame:
    present = cube.dropna(subset=["syn_count", *[k for k in keys if k == "neuropil"]])
    return present.groupBy(*keys, "syn_count").agg(F.sum("count").alias("count"))


def hist_global(cube: DataFrame) -> DataFrame:
    """(syn_count, count) over all rows, also those without a region."""
    return _histogram(cube)


def hist_by_neuropil(cube: DataFrame) -> DataFrame:
    return _histogram(cube, "neuropil")


def hist_by_neuropil_nt(cube: DataFrame, include_unassigned: bool = False) -> DataFrame:
    """(neuropil, nt, syn_count, count); a tied row counts once toward each of its labels."""
    return _histogram(explode_nt(cube, include_unassigned), "neuropil", "nt")


def hist_by_nt(cube: DataFrame, include_unassigned: bool = False) -> DataFrame:
    """(nt, syn_count, count) over the rows that have a region."""
    by_region = explode_nt(cube.dropna(subset=["neuropil"]), include_unassigned)
    return _histogram(by_region, "nt")


def with_total_pairs(hist: DataFrame, *keys: str) -> DataFrame:
    """Add the number of rows behind each histogram as `total_pairs`."""
    return hist.withColumn("total_pairs", F.sum("count").over(W.partitionBy(*keys)))


def all_histograms(cube: DataFrame, include_unassigned: bool = False) -> DataFrame:
    """Every histogram as (neuropil, nt, syn_count, count); null stands for all regions
    or all labels."""
    every = F.lit(None).cast("string")
    by_label = hist_by_neuropil_nt(cube, include_unassigned)
    parts = [
        hist_global(cube).select(every.alias("neuropil"), every.alias("nt"), "syn_count", "count"),
        hist_by_neuropil(cube).select("neuropil", every.alias("nt"), "syn_count", "count"),
        hist_by_nt(cube, include_unassigned).select(
            every.alias("neuropil"), "nt", "syn_count", "count"
        ),
        by_label.select("neuropil", "nt", "syn_count", "count"),
    ]
    return reduce(DataFrame.union, parts)


def hist_slice(
    histograms: DataFrame, neuropil: str | None = None, nt: str | None = None
) -> DataFrame:
    """The (syn_count, count) histogram of one region, one label, both, or everything,
    out of `all_histograms` or a stored summary. The optimizer drops the other parts."""
    chosen = F.col("neuropil").eqNullSafe(neuropil or None) & F.col("nt").eqNullSafe(nt or None)
    return histograms.where(chosen).select("syn_count", "count")


def hist_tail(hist: DataFrame, threshold: int) -> DataFrame:
    """The part of a histogram at or above the threshold."""
    return hist.where(F.col("syn_count") >= threshold)


def tail_total(hist: DataFrame, threshold: int) -> DataFrame:
    """How many rows lie at or above the threshold, zero if none."""
    total = F.coalesce(F.sum("count"), F.lit(0))
    return hist_tail(hist, threshold).agg(total.cast("bigint").alias("pairs"))


def row_count(cube: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("count"), F.lit(0))
    return cube.agg(total.cast("bigint").alias("total_rows"))


def syn_stats(cube: DataFrame) -> DataFrame:
    return cube.agg(F.min("syn_count").alias("syn_min"), F.max("syn_count").alias("syn_max"))


def syn_cdf(cube: DataFrame) -> DataFrame:
    """Rows at or below each synapse count. The unpartitioned window sees one row per
    distinct count, however many raw rows there are."""
    running = F.sum("count").over(W.orderBy("syn_count"))
    return hist_global(cube).withColumn("running", running)


def _at_quantile(q: float, total: Column) -> Column:
    # Index round-half-even(q * (total - 1)) in the sorted values, else the largest value.
    index = F.rint(F.lit(q) * (total - 1))
    reached = F.min(F.when(F.col("running") - 1 >= index, F.col("syn_count")))
    return F.coalesce(reached, F.max("syn_count"))


def syn_quantiles(cube: DataFrame, quantiles: list[float]) -> DataFrame:
    """Nearest-index quantiles as (quantile, syn_count).

    The index counts all rows, also those with a null synapse count, which have no
    place in the sorted values. No rows without any synapse count.
    """
    by_count = cube.groupBy("syn_count").agg(F.sum("count").alias("count"))
    ranked = by_count.select(
        "syn_count",
        F.sum("count").over(W.orderBy(F.asc_nulls_last("syn_count"))).alias("running"),
        F.sum("count").over(W.partitionBy()).alias("total"),
    )
    values = ranked.where("syn_count is not null").groupBy("total").agg(
        *[_at_quantile(q, F.col("total")).alias(f"q{i}") for i, q in enumerate(quantiles)]
    )
    rows = [
        F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("syn_count"))
        for i, q in enumerate(quantiles)
    ]
    return values.select(F.inline(F.array(*rows)))


def unique_counts(connections: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """Exact distinct counts of senders, receivers, their union, and regions.

    Each neuron is reduced map-side to one row that says in which roles it occurs,
    so the three id counts cost one shuffle of distinct ids. Regions are counted in
    the cube if there is one.
    """
    roles = F.array(
        F.struct(F.col("pre_pt_root_id").alias("id"), F.lit(1).alias("pre"), F.lit(0).alias("post")),
        F.struct(F.col("post_pt_root_id").alias("id"), F.lit(0).alias("pre"), F.lit(1).alias("post")),
    )
    neuron = connections.select(F.inline(roles)).where("id is not null").groupBy("id")
    ids = neuron.agg(F.max("pre").alias("pre"), F.max("post").alias("post")).agg(
        F.sum("pre").alias("pre_pt_root_id"),
        F.sum("post").alias("post_pt_root_id"),
        F.count("*").alias("neuron_ids_union"),
        F.lit(0).cast("bigint").alias("neuropil"),
    )
    zero = [F.lit(0).cast("bigint").alias(c) for c in ids.columns[:3]]
    regions = (connections if cube is None else cube).agg(*zero, F.countDistinct("neuropil").alias("neuropil"))
    return ids.union(regions).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ids.columns]
    )
