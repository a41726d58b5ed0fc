"""Connections to property-graph tables: upsert rules, degrees, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators.hub_join import tasks_for
from edgelytics.schema import CONNECTIONS, EDGE_KEY, EDGES, NT_COLUMNS, require_columns
from edgelytics.session import materialize

# Keys are counted by slots of their hash, each task's at most so many, or more where slots would
# hold over a tenth of HOT_ROWS on average. The keys of a slot with more rows than HOT_ROWS
# are combined before they are shuffled, as one of them may be too much for a task.
SLOTS = 1 << 16
HOT_ROWS = 100_000


def _has_key() -> Column:
    return (
        F.col("pre_pt_root_id").isNotNull()
        & F.col("post_pt_root_id").isNotNull()
        & F.col("neuropil").isNotNull()
    )


def rejected_connections(connections: DataFrame) -> DataFrame:
    """Rows that cannot become an edge because a part of the edge key is null."""
    return connections.where(~_has_key())


def latest_edges(connections: DataFrame) -> DataFrame:
    """One edge per (pre, post, neuropil), with the values of the row with the largest `ord`.

    The aggregate buffer holds numbers only, so this is a hash aggregation with
    map-side combine: a key that repeats in a large part of the rows shrinks to one
    row per map task before the shuffle. The text columns are derived afterwards.
    """
    require_columns(connections, CONNECTIONS.names)
    values = ["syn_count", *NT_COLUMNS]
    latest = (
        connections.where(_has_key())
        .groupBy(
            F.col("pre_pt_root_id").alias("src"), F.col("post_pt_root_id").alias("dst"), "neuropil"
        )
        .agg(*[F.max_by(c, "ord").alias(c) for c in values], F.max("ord").alias("ord"))
    )
    return with_dominant(latest).select(EDGES.names)


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of stored tables, which are read to be counted, in range partitions over `order`: as
    many as the shuffle partitions, or more where a sort would not fit a task."""
    spark = rows.sparkSession
    tasks = tasks_for(spark, rows.count()) or 0
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartitionByRange(*order)
    return rows.repartitionByRange(tasks, *order)


def latest_in_order(connections: DataFrame, order: Sequence[str] = EDGE_KEY) -> DataFrame:
    """The rows of `latest_edges` in range partitions over `order`, each sorted by it.

    `order` is the edge key, after columns of `connections` that follow from the key; they
    are kept. For a stored table, as it is read four times: for two counts, for the bounds of
    the ranges and for its rows. A hash table of whole rows spills them all where keys hardly
    repeat, so rows are sorted only, once, in the ranges they are written in. Keys that
    repeat so often that they would fill a task are combined before the shuffle.
    """
    require_columns(connections, CONNECTIONS.names)
    values = ["syn_count", *NT_COLUMNS]
    extra = [c for c in order if c not in EDGE_KEY]
    keyed = connections.where(_has_key()).withColumnsRenamed({"pre_pt_root_id": "src", "post_pt_root_id": "dst"})
    keyed = keyed.select(*extra, *EDGE_KEY, *values, "ord")
    slots = max(SLOTS, 10 * connections.count() // HOT_ROWS)
    slot = F.pmod(F.xxhash64(*EDGE_KEY), F.lit(slots)).alias("_slot")
    crowded = keyed.groupBy(slot).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT_ROWS).select("_slot")
    hot = materialize(crowded, "hot-keys")
    if hot.rows:
        slotted = keyed.select("*", slot)
        repeated = slotted.join(hot.df, "_slot", "left_semi").groupBy(*extra, *EDGE_KEY)
        combined = repeated.agg(*[F.max_by(c, "ord").alias(c) for c in values], F.max("ord").alias("ord"))
        keyed = slotted.join(hot.df, "_slot", "left_anti").drop("_slot").unionByName(combined)
    last_first = W.partitionBy(*order).orderBy(F.desc("ord"))
    ranked = in_ranges(keyed, order).withColumn("_place", F.row_number().over(last_first))
    latest = ranked.where("_place = 1").drop("_place")
    # as in `latest_edges`, rows without a position have no say in the values
    placed = {c: F.when(F.col("ord").isNotNull(), F.col(c)) for c in values}
    return with_dominant(latest.withColumns(placed)).select(*EDGES.names, *extra)


def upsert_edges(existing: DataFrame, connections: DataFrame) -> DataFrame:
    """Existing edges with the incoming connections applied: equal keys are overwritten.

    Existing edges take part in an anti-join only, so they stay unshuffled where Spark
    finds the written incoming edges small enough to broadcast their keys.
    """
    incoming = materialize(latest_edges(connections), "incoming-edges").df
    untouched = existing.join(incoming.select(EDGE_KEY), EDGE_KEY, "left_anti")
    return untouched.select(EDGES.names).unionByName(incoming)


def neurons(edges: DataFrame) -> DataFrame:
    """Every neuron that an edge touches, once."""
    ends = edges.select(F.col("src").alias("root_id")).union(edges.select("dst"))
    return ends.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(root_id, out_deg, in_deg) of every neuron that an edge touches."""
    ends = F.array(
        F.struct(F.col("src").alias("root_id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("dst").alias("root_id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )
    counted = edges.select(F.inline(ends)).groupBy("root_id")
    return counted.agg(F.sum("out").alias("out_deg"), F.sum("in").alias("in_deg"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("root_id")).agg(F.count("*").alias("out_deg"))


def top_out_degree(edges: DataFrame, n: int = 1) -> DataFrame:
    """The `n` neurons with most outgoing edges; smaller ids first among equals."""
    return out_degree(edges).orderBy(F.desc("out_deg"), "root_id").limit(n)


def graph_counts(edges: DataFrame) -> DataFrame:
    """Number of edges and of neurons, as one row."""
    edge_count = edges.agg(F.count("*").alias("edges"), F.lit(0).cast("bigint").alias("neurons"))
    neuron_count = neurons(edges).agg(
        F.lit(0).cast("bigint").alias("edges"), F.count("*").alias("neurons")
    )
    return edge_count.union(neuron_count).agg(
        F.sum("edges").alias("edges"), F.sum("neurons").alias("neurons")
    )
