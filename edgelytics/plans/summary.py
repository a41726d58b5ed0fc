"""The dashboard summary: one JSON document rolled up from the histogram cube."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators.histogram import (
    connection_cube,
    hist_by_neuropil,
    hist_by_neuropil_nt,
    hist_by_nt,
    hist_global,
    row_count,
    syn_quantiles,
    syn_stats,
    unique_counts,
)
from edgelytics.schema import NT_LABELS
from edgelytics.session import materialize

# The quantiles reported unless others are asked for.
SUMMARY_QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _bars() -> Column:
    return F.sort_array(F.collect_list(F.struct("syn_count", "count"))).alias("histogram")


def _total() -> Column:
    return F.sum("count").alias("total_pairs")


def _sorted_map(key: str, *fields: str) -> Column:
    """One map per group from `key` to a struct of fields, its keys in order."""
    entry = F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value"))

    def by_key(a: Column, b: Column) -> Column:
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    return F.map_from_entries(F.array_sort(F.collect_list(entry), by_key))


def _whole(histograms: DataFrame, key: str, *fields: str) -> DataFrame:
    return histograms.agg(_sorted_map(key, *fields).alias(f"by_{key}"))


def summary_document(
    cube: DataFrame,
    ids: DataFrame,
    input_name: str,
    max_rows: int | None = None,
    quantiles: Sequence[float] | None = SUMMARY_QUANTILES,
    include_unassigned: bool = False,
) -> DataFrame:
    """The summary as a row with the one column `summary_json`.

    `cube` is a `connection_cube`, `ids` the row of `unique_counts`. Without
    `quantiles`, median and quantiles stay empty. The size of the document depends on
    the regions, labels and distinct synapse counts, not on the number of rows.
    """
    by_label = (
        hist_by_neuropil_nt(cube, include_unassigned).groupBy("neuropil", "nt").agg(_total(), _bars())
    )
    labels = by_label.groupBy("neuropil").agg(
        _sorted_map("nt", "total_pairs", "histogram").alias("by_neurotransmitter")
    )
    regions = (
        hist_by_neuropil(cube).groupBy("neuropil").agg(_total(), _bars()).join(labels, "neuropil", "left")
    )
    overall = hist_by_nt(cube, include_unassigned).groupBy("nt").agg(_total(), _bars())
    by_neuropil = _whole(regions, "neuropil", "total_pairs", "histogram", "by_neurotransmitter")
    by_nt = _whole(overall, "nt", "total_pairs", "histogram")
    counts = ids.select(
        F.struct("pre_pt_root_id", "post_pt_root_id", "neuron_ids_union", "neuropil").alias("unique")
    )
    asked = sorted({0.5, *(quantiles or [])})
    entries = F.collect_list(F.struct("quantile", "syn_count"))
    found = syn_quantiles(cube, asked).agg(F.map_from_entries(entries).alias("found"))
    parts = [row_count(cube), syn_stats(cube), found, hist_global(cube).agg(_bars())]
    parts += [counts, by_neuropil, by_nt]
    # Each part is one row with columns of its own.
    rows = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)
    row = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
    listed = [
        (F.lit(str(q)), F.try_element_at("found", F.lit(q))) for q in dict.fromkeys(quantiles or [])
    ]
    by_quantile = F.create_map(*[part for pair in listed for part in pair])
    by_quantile = F.map_filter(by_quantile.cast("map<string,int>"), lambda _, v: v.isNotNull())
    median = F.try_element_at("found", F.lit(0.5)) if quantiles else F.lit(None).cast("int")
    syn = F.struct(
        F.col("syn_min").alias("min"),
        F.col("syn_max").alias("max"),
        median.alias("median"),
        by_quantile.alias("quantiles"),
        "histogram",
    )
    document = F.struct(
        F.lit(input_name).alias("input"),
        F.lit(max_rows).cast("bigint").alias("max_rows"),
        "total_rows",
        F.array(*map(F.lit, NT_LABELS)).alias("neurotransmitters"),
        "unique",
        syn.alias("syn_count"),
        "by_neuropil",
        F.col("by_nt").alias("by_neurotransmitter"),
    )
    as_text = F.to_json(document, {"ignoreNullFields": "false"})
    return row.select(as_text.alias("summary_json"))


def summarize(
    connections: DataFrame,
    input_name: str,
    max_rows: int | None = None,
    quantiles: Sequence[float] | None = SUMMARY_QUANTILES,
) -> DataFrame:
    """The summary document of raw connections; rows without a label count for no label.

    `max_rows` only labels the document: say so if `connections` were capped before.
    """
    cube = materialize(connection_cube(with_dominant(connections)), "cube").df
    ids = unique_counts(connections, cube)
    return summary_document(cube, ids, input_name, max_rows, quantiles)


def summarize_gold(gold: DataFrame, input_name: str, max_rows: int | None = None) -> DataFrame:
    """The summary document of the enriched dataset, from its dominant-NT texts.

    It has no quantiles, and counts rows without a label under the label "". `max_rows`
    only labels the document.
    """
    cube = materialize(connection_cube(gold), "cube").df
    ids = unique_counts(gold, cube)
    return summary_document(cube, ids, input_name, max_rows, None, include_unassigned=True)
