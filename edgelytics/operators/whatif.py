"""What-if reweighting of outgoing edges; nothing is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.operators.partners import Roots, edges_of
from edgelytics.session import materialize


def _reweighted(edges: DataFrame, factor: Column) -> DataFrame:
    return edges.select(
        F.col("src").alias("source_id"),
        F.col("dst").alias("target_id"),
        F.col("syn_count").alias("original_syn_count"),
        (F.coalesce("syn_count", F.lit(0)) * factor.cast("double")).alias("effective_syn_count"),
        "neuropil",
    )


def reweight(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Outgoing edges of each scenario neuron, their synapse count times its factor.

    `scenarios` has (root_id, factor), each neuron once; a null or repeated root_id is an
    error, as it would lose or multiply edges. A null synapse count weighs nothing.
    """
    wanted = materialize(scenarios.select("root_id", "factor"), "scenarios").df
    unclear = wanted.groupBy("root_id").agg(F.count("*").alias("times")).where("root_id is null or times > 1")
    if not unclear.isEmpty():
        raise ValueError("every scenario needs a root_id of its own")
    joined = edges.join(wanted, F.col("src") == F.col("root_id"))
    return _reweighted(joined, F.col("factor"))


def silence(edges: DataFrame, roots: Roots = None) -> DataFrame:
    """Outgoing edges of the roots with an effective weight of zero."""
    return boost(edges, roots, 0.0)


def boost(edges: DataFrame, roots: Roots = None, factor: float = 2.0) -> DataFrame:
    """Outgoing edges of the roots with their synapse count multiplied by `factor`."""
    return _reweighted(edges_of(edges, roots, "src"), F.lit(float(factor)))
