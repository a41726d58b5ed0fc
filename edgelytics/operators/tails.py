"""Threshold views: rows at or above every synapse count, per region and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import vocabulary_rank

# Bubble diameters, opacities and grid width of the region chart.
MIN_SIZE, MAX_SIZE = 14, 72
SHOWN, FADED = 0.95, 0.2
GRID_COLUMNS = 10


def tail_counts(hist: DataFrame, *keys: str) -> DataFrame:
    """Add `at_or_above`: the rows with this or a larger synapse count, per key."""
    from_largest = W.partitionBy(*keys).orderBy(F.desc("syn_count"))
    upward = from_largest.rowsBetween(W.unboundedPreceding, W.currentRow)
    return hist.withColumn("at_or_above", F.sum("count").over(upward))


def pairs_at_or_above(tails: DataFrame, threshold: int, *keys: str) -> DataFrame:
    """Look a threshold up in a stored tail table: `pairs` per key, zero above its range."""
    reached = F.when(F.col("syn_count") >= threshold, F.col("at_or_above"))
    return tails.groupBy(*keys).agg(F.coalesce(F.max(reached), F.lit(0)).alias("pairs"))


def region_dominant_nt(by_label: DataFrame, threshold: int) -> DataFrame:
    """Per region the label with most rows at or above the threshold, as (neuropil, nt, pairs).

    `by_label` holds the histograms by region and label. Equal counts go to the first
    label of the vocabulary. A region whose rows all lie below the threshold still names
    one of its labels, with zero pairs.
    """
    in_tail = F.when(F.col("syn_count") >= threshold, F.col("count")).otherwise(0)
    per_label = (
        by_label.groupBy("neuropil", "nt")
        .agg(F.sum(in_tail).alias("pairs"))
        .withColumn("rank", vocabulary_rank(F.col("nt")))
        .where("rank is not null")
    )
    best_first = W.partitionBy("neuropil").orderBy(F.desc("pairs"), "rank")
    best = per_label.withColumn("place", F.row_number().over(best_first)).where("place = 1")
    return best.select("neuropil", "nt", "pairs")


def _pairs(hist: DataFrame, threshold: int) -> DataFrame:
    return pairs_at_or_above(tail_counts(hist, "neuropil"), threshold, "neuropil")


def region_bubbles(
    by_region: DataFrame, by_label: DataFrame, threshold: int, nt: str | None = None
) -> DataFrame:
    """One chart bubble per region: tail count, size, opacity, grid cell, hover label.

    The histograms by region, and by region and label, come from a cube or from a stored
    summary. With `nt`, counts are those of that label. The unpartitioned windows run
    over one row per region.
    """
    tails = _pairs(by_region, threshold)
    dominant = region_dominant_nt(by_label, threshold).select("neuropil", F.col("nt").alias("dominant_nt"))
    if nt:
        labelled = _pairs(by_label.where(F.col("nt") == nt), threshold)
        tails = tails.select("neuropil").join(labelled, "neuropil", "left").fillna(0, ["pairs"])
        dominant = tails.select("neuropil", F.lit(nt).alias("dominant_nt"))
    largest = F.max("pairs").over(W.partitionBy())
    size = MIN_SIZE + (MAX_SIZE - MIN_SIZE) * F.sqrt(F.col("pairs") / F.col("largest"))
    cell = F.row_number().over(W.orderBy("neuropil")) - 1
    counted = F.concat(F.lit(f"pairs ≥ {threshold}: "), F.col("pairs"))
    named = F.concat(F.lit("dominant: "), F.col("dominant_nt"))
    lines = [named, counted] if nt else [counted, named]
    return (
        tails.join(dominant, "neuropil", "left")
        .withColumns({"largest": largest, "cell": cell})
        .select(
            "neuropil",
            "pairs",
            "dominant_nt",
            F.when(F.col("largest") > 0, size).otherwise(F.lit(float(MIN_SIZE))).alias("marker_size"),
            F.when(F.col("pairs") > 0, SHOWN).otherwise(FADED).alias("opacity"),
            F.pmod("cell", F.lit(GRID_COLUMNS)).alias("grid_x"),
            F.floor(F.col("cell") / GRID_COLUMNS).cast("int").alias("grid_y"),
            F.concat_ws("<br>", "neuropil", *lines).alias("label"),
        )
    )
