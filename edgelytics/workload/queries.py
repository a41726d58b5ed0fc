"""Registered queries: one per operator, each over the whole derived tables.

Graph queries run for every neuron unless they are about the best-connected one.
Thresholds and hop counts are query parameters of the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from edgelytics.functions import transmitters as nt
from edgelytics.functions.filters import EdgeFilter
from edgelytics.operators import edges as eg
from edgelytics.operators import histogram as hg
from edgelytics.operators import hops, partners, reports, tails, whatif
from edgelytics.operators import sketches as sk
from edgelytics.operators.between import paths_between as between
from edgelytics.operators.histogram import connection_cube
from edgelytics.plans import neuron_report, summary
from edgelytics.schema import CONNECTIONS, CUBE, EDGES, GOLD, NT_COLUMNS
from edgelytics.session import materialize, scratch_path
from edgelytics.sources import summaries
from edgelytics.sources.arrow_ipc import read_ipc
from edgelytics.sources.gold import read_gold, write_gold
from edgelytics.sources.graph import read_graph, upsert_graph, write_graph
from edgelytics.sources.summaries import (
    fetch_summary,
    push_summary,
    read_summary_json,
    write_summary_json,
)
from edgelytics.streaming import incremental
from edgelytics.workload.tables import FIRST_LOAD, SECOND_LOAD, connections, gold, graph, load_graph, stored_loads

Query = Callable[[SparkSession, str], DataFrame]


def column_name(text: str) -> str:
    """A dominant-NT text as a column name."""
    return text.replace(",", "_") or "none"


QUERIES: dict[str, Query] = {}

QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
INPUT_NAME = "connections"
NARROW = [c for c in GOLD.names if c not in NT_COLUMNS]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connection_cube(gold(spark, sf_dir))


def stored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as a written table, for results that roll it up in several ways."""
    return materialize(cube(spark, sf_dir), "cube").df


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges


# Sources and sinks


@query
def scan_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ipc")
    # written in order, so that the positions of the rows in the files give it back
    ordered = connections(spark, sf_dir).repartitionByRange("ord").sortWithinPartitions("ord")
    raw = ordered.drop("ord")

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part = f"{root}/part-{task.partitionId():06d}"
        attempt = f"{part}-{task.taskAttemptId()}.tmp"
        with fs.open_output_stream(attempt) as sink, ipc.new_file(sink, schema) as writer:
            for batch in batches:
                writer.write_batch(batch)
        # A task that is run again replaces its own file.
        fs.move(attempt, f"{part}.arrow")
        yield from ()

    schema = to_arrow_schema(raw.schema)
    raw.mapInArrow(export, raw.schema).write.format("noop").mode("overwrite").save()
    same_edge = W.partitionBy("pre_pt_root_id", "post_pt_root_id", "neuropil").orderBy("ord")
    return read_ipc(spark, folder).withColumn("place", F.row_number().over(same_edge)).drop("ord")


@query
def gold_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gold(connections(spark, sf_dir), scratch_path(spark, "gold"))
    return read_gold(spark, path)


@query
def scan_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gold(
        connections(spark, sf_dir), scratch_path(spark, "gold"), keep_probabilities=False
    )
    columns = ["pre_pt_root_id", "post_pt_root_id", "neuropil", "syn_count", "dominant_nt"]
    return read_gold(spark, path, columns, has_probabilities=False)


@query
def pairs_by_neuropil(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gold(connections(spark, sf_dir), scratch_path(spark, "gold"))
    flt = EdgeFilter(threshold=10, neurotransmitter="gaba", neuropil="N_O")
    return partners.gold_pairs(read_gold(spark, path), 1000, flt)


@query
def first_n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_n_rows(connections(spark, sf_dir), 10_000)


@query
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.row_count(cube(spark, sf_dir))


@query
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.schema_report(connections(spark, sf_dir))


@query
def edges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_graph(spark, sf_dir).edges.select(EDGES.names)


@query
def neurons_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).neurons


@query
def rejected_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.rejected_connections(connections(spark, sf_dir))


@query
def edges_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier, later = stored_loads(spark, sf_dir)
    return upsert_graph(write_graph(earlier, scratch_path(spark, "graph")), later).edges


@query
def edges_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads through one handle; the graph as the first of them left it."""
    empty = write_graph(connections(spark, sf_dir, "false"), scratch_path(spark, "graph"))
    for load in stored_loads(spark, sf_dir):
        upsert_graph(empty, load)
    return read_graph(spark, empty.path, as_of=1).edges


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cube and the distinct ids read the derived rows, which are joined once
    derived = materialize(connections(spark, sf_dir), "connections").df
    return summary.summarize(derived, INPUT_NAME)


def _stored_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_summary_json(_summary(spark, sf_dir), scratch_path(spark, "summary"))
    return summaries.summary_histograms(read_summary_json(spark, path))


@query
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_summary_json(_summary(spark, sf_dir), scratch_path(spark, "summary"))
    return read_summary_json(spark, path)


@query
def summary_document_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_gold(connections(spark, sf_dir), scratch_path(spark, "gold"))
    return summary.summarize_gold(read_gold(spark, path), INPUT_NAME)


@query
def summary_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_histograms(spark, sf_dir)


@query
def summary_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summary_record(_summary(spark, sf_dir), "whole").drop("updated_at", "summary_json")


@query
def summary_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scratch_path(spark, "summaries")
    document = materialize(_summary(spark, sf_dir), "summary").df
    push_summary(document, table, "whole")
    push_summary(document, table, "other")
    push_summary(document, table, "whole")
    return fetch_summary(spark, table, "whole").select("dataset_id", "summary_json")


# Row expressions


@query
def dominant_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("ord", "pre_pt_root_id", "dominant_score")


@query
def dominant_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("ord", "pre_pt_root_id", "dominant_nt")


@query
def nt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = nt.nt_tokens("dominant_nt")
    return gold(spark, sf_dir).select(
        "ord", "pre_pt_root_id", F.size(tokens).alias("labels"), F.array_join(tokens, " + ").alias("text")
    )


@query
def nt_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.explode_nt(gold(spark, sf_dir)).select("ord", "pre_pt_root_id", "syn_count", "nt")


@query
def enriched_no_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.drop_probabilities(gold(spark, sf_dir))


def _with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables hold no NaN: a quarter probability stands in for one.
    spoiled = {c: F.when(F.col(c) == 0.25, float("nan")).otherwise(F.col(c)) for c in NT_COLUMNS}
    return connections(spark, sf_dir).withColumns(spoiled)


@query
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.nan_to_null(_with_nan(spark, sf_dir))


@query
def nan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.nan_counts(_with_nan(spark, sf_dir))


@query
def dominant_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = nt.with_dominant(_with_nan(spark, sf_dir))
    return enriched.select("ord", "pre_pt_root_id", "dominant_score", "dominant_nt")


@query
def tied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.tied_rows(gold(spark, sf_dir)).select(NARROW)


@query
def reweight_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.silence(edges(spark, sf_dir))


@query
def reweight_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.boost(edges(spark, sf_dir), factor=2.0)


@query
def reweight_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = edges(spark, sf_dir)
    factor = (F.col("out_deg") / F.lit(16.0)).alias("factor")
    return whatif.reweight(weighted, eg.out_degree(weighted).select("root_id", factor))


# Filters


def _filtered(spark: SparkSession, sf_dir: str, flt: EdgeFilter) -> DataFrame:
    kept = edges(spark, sf_dir).where(flt.condition)
    return kept.select("src", "dst", "neuropil", "syn_count", "dominant_nt")


@query
def edge_filter_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, EdgeFilter(threshold=25))


@query
def edge_filter_neuropil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, EdgeFilter(neuropil="a_f"))


@query
def edge_filter_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, EdgeFilter(neurotransmitter="gABa"))


@query
def hist_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    histograms = hg.all_histograms(stored_cube(spark, sf_dir))
    slices = {
        "all": hg.hist_slice(histograms),
        "label": hg.hist_slice(histograms, nt="Serotonin"),
        "region": hg.hist_slice(histograms, neuropil="R_F"),
        "both": hg.hist_slice(histograms, neuropil="R_F", nt="Serotonin"),
    }
    named = [df.select(F.lit(name).alias("slice"), "*") for name, df in slices.items()]
    return named[0].union(named[1]).union(named[2]).union(named[3])


@query
def hist_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.hist_tail(hg.hist_by_nt(cube(spark, sf_dir)), 30)


# Graph queries


@query
def postsynaptic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners.strongest_first(partners.postsynaptic(edges(spark, sf_dir)))


@query
def presynaptic(spark: SparkSession, sf_dir: str) -> DataFrame:
    flt = EdgeFilter(threshold=5, neurotransmitter="Glutamate", neuropil="n_o")
    incoming = graph(spark, sf_dir).edges_by_dst
    return partners.strongest_first(partners.presynaptic(incoming, flt=flt))


@query
def top_neuron_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = edges(spark, sf_dir)
    target = partners.store_roots(eg.top_out_degree(stored, 1))
    sent = partners.postsynaptic(stored, target).withColumn("side", F.lit("post"))
    received = partners.presynaptic(graph(spark, sf_dir).edges_by_dst, target).withColumn("side", F.lit("pre"))
    return sent.union(received)


@query
def top_neuron_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = edges(spark, sf_dir)
    return partners.preview(partners.postsynaptic(stored, eg.top_out_degree(stored, 1)), 5)


@query
def two_hop_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=25, neurotransmitter="a")
    return hops.two_hop_upstream(loaded.edges_by_dst, flt=flt, degrees=loaded.degrees)


@query
def two_hop_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = graph(spark, sf_dir)
    return hops.two_hop_downstream(loaded.edges, flt=EdgeFilter(threshold=25), degrees=loaded.degrees)


def _path_text(paths: DataFrame) -> DataFrame:
    return paths.select(
        "root_id",
        "hops",
        F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"),
        F.array_join(F.col("edges").cast("array<string>"), ";").alias("edges"),
    )


@query
def k_hop_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=44)
    return hops.k_hop_downstream(loaded.edges, k=3, flt=flt, degrees=loaded.degrees, text=True)


@query
def k_hop_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=30, neurotransmitter="dopa")
    return hops.k_hop_upstream(loaded.edges_by_dst, k=3, flt=flt, degrees=loaded.degrees, text=True)


@query
def k_hop_from_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=25)
    target = eg.top_out_degree(loaded.edges, 3)
    return hops.k_hop_downstream(loaded.edges, target, k=3, flt=flt, degrees=loaded.degrees, text=True)


@query
def paths_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the three neurons that send most to the three that receive most."""
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=25)
    targets = loaded.degrees.where("in_deg > 0").orderBy(F.desc("in_deg"), "root_id").limit(3)
    found = between(
        loaded.edges, eg.top_out_degree(loaded.edges, 3), targets, k=4, flt=flt,
        edges_by_dst=loaded.edges_by_dst, degrees=loaded.degrees,
    )
    return _path_text(found).withColumn("target_id", F.element_at(F.split("nodes", ">"), -1).cast("bigint"))


@query
def path_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = edges(spark, sf_dir)
    return hops.path_preview(hops.k_hop_upstream(stored, k=2, flt=EdgeFilter(threshold=40)))


@query
def k_hop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=40)
    return hops.k_hop_nodes(loaded.edges, k=2, flt=flt, edges_by_dst=loaded.edges_by_dst, degrees=loaded.degrees)


@query
def circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, flt = graph(spark, sf_dir), EdgeFilter(threshold=48)
    return hops.circuit(loaded.edges, k=3, flt=flt, edges_by_dst=loaded.edges_by_dst, degrees=loaded.degrees)


@query
def circuit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = edges(spark, sf_dir)
    found = hops.circuit(stored, k=1, flt=EdgeFilter(threshold=40, neuropil="a_f"))
    nested = hops.circuit_documents(found, pieces=4)
    return nested.select("root_id", "piece", F.to_json(F.struct("circuits")).alias("document"))


@query
def outgoing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners.outgoing_edges(edges(spark, sf_dir))


@query
def dataset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners.dataset_pairs(edges(spark, sf_dir), 1000, EdgeFilter(1, "serotonin"))


@query
def neuron_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = graph(spark, sf_dir)
    target, flt = eg.top_out_degree(loaded.edges, 1), EdgeFilter(threshold=25)
    return neuron_report.neuron_report_counts(loaded.edges, target, 3, flt, loaded.edges_by_dst, loaded.degrees)


@query
def neuron_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the report, each as one line of text."""
    loaded = graph(spark, sf_dir)
    target, flt = eg.top_out_degree(loaded.edges, 1), EdgeFilter(threshold=40)
    report = neuron_report.neuron_report(loaded.edges, target, 3, flt, loaded.edges_by_dst, loaded.degrees)
    found = []
    for section, listed in report.items():
        if section.startswith("k_hop"):
            listed = _path_text(listed).select("root_id", "nodes")
        elif section.endswith("synaptic"):
            listed = listed.drop("dominant_score")
        values = [F.col(c).cast("string") for c in listed.columns if c != "root_id"]
        found.append(listed.select("root_id", F.lit(section).alias("section"), F.concat_ws(":", *values).alias("line")))
    return reduce(DataFrame.union, found)


@query
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.out_degree(edges(spark, sf_dir))


@query
def top_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.top_out_degree(edges(spark, sf_dir), 1)


@query
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.graph_counts(edges(spark, sf_dir))


# Histograms and reports


@query
def unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.unique_counts(connections(spark, sf_dir))


@query
def approx_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from the sketches of two ingested batches, beside the exact counts; `close`
    if within 3 %, nearly four standard errors."""
    path = _ingested(spark, sf_dir)
    cube, sketches = incremental.current_cube(spark, path), incremental.current_sketches(spark, path)
    estimated = sk.approx_unique_counts(sketches, cube)
    exact = hg.unique_counts(connections(spark, sf_dir))
    names = exact.columns
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]
    listed = [df.select(F.inline(F.array(*rows))) for df in (exact, estimated)]
    met = listed[0].join(listed[1].withColumnRenamed("value", "estimate"), "name")
    close = (F.abs(F.col("estimate") - F.col("value")) <= 0.03 * F.col("value")).alias("close")
    return met.select("name", F.col("value").alias("exact"), close)


@query
def hist_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.hist_global(cube(spark, sf_dir))


@query
def hist_by_neuropil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.with_total_pairs(hg.hist_by_neuropil(cube(spark, sf_dir)), "neuropil")


@query
def hist_by_neuropil_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.with_total_pairs(hg.hist_by_neuropil_nt(cube(spark, sf_dir)), "neuropil", "nt")


@query
def hist_by_neuropil_nt_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.hist_by_neuropil_nt(cube(spark, sf_dir), include_unassigned=True)


@query
def hist_by_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.with_total_pairs(hg.hist_by_nt(cube(spark, sf_dir)), "nt")


@query
def hist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = [nt.with_dominant(connections(spark, sf_dir, part)) for part in (FIRST_LOAD, SECOND_LOAD)]
    return hg.merge_cubes(*map(connection_cube, loads))


@query
def syn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.syn_stats(cube(spark, sf_dir))


@query
def syn_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.syn_quantiles(cube(spark, sf_dir), QUANTILES)


@query
def syn_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.syn_cdf(cube(spark, sf_dir))


@query
def connections_per_neuropil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.connections_per_neuropil(connections(spark, sf_dir))


@query
def dominant_nt_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dominant_nt_distribution(gold(spark, sf_dir))


@query
def avg_dominant_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    averaged = reports.avg_dominant_score(gold(spark, sf_dir))
    return averaged.withColumn("avg_score", F.round("avg_score", 9))


@query
def neuropil_nt_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = reports.neuropil_nt_matrix(gold(spark, sf_dir))
    return matrix.toDF(*[column_name(c) for c in matrix.columns])


@query
def neuropil_nt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.neuropil_nt_counts(gold(spark, sf_dir))


@query
def tail_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.tail_total(hg.hist_global(cube(spark, sf_dir)), 30)


@query
def tail_by_neuropil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tails.tail_counts(hg.hist_by_neuropil(cube(spark, sf_dir)), "neuropil")


@query
def tail_by_neuropil_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tails.tail_counts(hg.hist_by_neuropil_nt(cube(spark, sf_dir)), "neuropil", "nt")


@query
def tail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tail_by_neuropil_nt(spark, sf_dir)
    return tails.pairs_at_or_above(table, 42, "neuropil", "nt")


@query
def region_dominant_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tails.region_dominant_nt(hg.hist_by_neuropil_nt(cube(spark, sf_dir)), 35)


@query
def region_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored_cube(spark, sf_dir)
    return tails.region_bubbles(hg.hist_by_neuropil(counted), hg.hist_by_neuropil_nt(counted), 20)


@query
def region_bubbles_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    # From a stored summary, as a dashboard would.
    histograms = _stored_histograms(spark, sf_dir).where("neuropil is not null")
    by_label = histograms.where("nt is not null")
    return tails.region_bubbles(histograms.where("nt is null"), by_label, 20, nt="Dopamine")


# Incremental ingest


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Two loads, one batch each, as they arrive."""
    arriving, target = scratch_path(spark, "arriving"), scratch_path(spark, "ingested")
    for load in (FIRST_LOAD, SECOND_LOAD):
        connections(spark, sf_dir, load).select(CONNECTIONS.names).write.mode("append").parquet(arriving)
        stream = incremental.read_connection_stream(spark, arriving)
        incremental.ingest(stream, target).trigger(availableNow=True).start().awaitTermination()
    return target


@query
def incremental_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.current_cube(spark, _ingested(spark, sf_dir)).select(CUBE.names)


@query
def incremental_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.current_edges(spark, _ingested(spark, sf_dir))
