"""The property graph as Parquet tables: neurons, edges clustered for lookups, and later loads.

Loads are numbered. A writer claims the next number by creating a file that must not exist
yet, writes its tables under that number, and commits last. A number is used once, so a
load that has been committed is never written again; one whose writer failed keeps its
number and is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators.edges import degrees, in_ranges, latest_in_order, rejected_connections
from edgelytics.operators.lookup import split_by
from edgelytics.schema import (
    CONNECTIONS,
    DEGREES,
    EDGE_KEY,
    EDGES,
    GOLD,
    NEURONS,
    NT_COLUMNS,
    require_columns,
)
from edgelytics.session import Stored, child_names, create_new, materialize, path_exists, remove_path


@dataclass(frozen=True)
class Graph:
    """Tables of one written graph, all loads applied. `edges_by_dst` holds the same edges
    as `edges`; `loads` is the number of the last load that was added to the base.
    `degrees` (root_id, out_deg, in_deg) is exact for a base; each later load adds its own
    edges, so with loads it is an upper bound."""

    path: str
    neurons: DataFrame
    edges: DataFrame
    edges_by_dst: DataFrame
    rejects: DataFrame
    degrees: DataFrame
    loads: int = 0


class LoadConflict(RuntimeError):
    """Another writer took the same load number. Nothing was written; the order of the two
    decides equal keys, so the caller decides whether to try again."""


def _write_files(laid_out: DataFrame, path: str, split: list[str]) -> None:
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*split).parquet(path)


def _write_latest(connections: DataFrame, path: str, directories: int | None) -> None:
    """The edges of stored connections. Range partitions over both ends split a hub neuron;
    sorted files let the scan skip row groups when edges are looked up by neuron id."""
    split = []
    if directories:
        named, name = split_by(connections.withColumn("src", F.col("pre_pt_root_id")), "src", directories)
        connections, split = named.drop("src"), [name]
    _write_files(latest_in_order(connections, [*split, *EDGE_KEY]), path, split)


def _write_edges(
    edges: DataFrame, path: str, first: str, second: str, directories: int | None
) -> None:
    """The same for edges that have each key once."""
    order, split = [first, second, "neuropil"], []
    if directories:
        edges, name = split_by(edges, first, directories)
        order, split = [name, *order], [name]
    # numbers only are shuffled, the text is derived again
    numbers = in_ranges(edges.drop("dominant_score", "dominant_nt"), order).sortWithinPartitions(*order)
    _write_files(with_dominant(numbers).select(*EDGES.names, *split), path, split)


def _write_others(spark: SparkSession, path: str, mirror: bool, directories: int | None) -> None:
    """The tables that follow from the written edges."""
    stored = spark.read.schema(EDGES).parquet(f"{path}/edges").select(EDGES.names)
    if mirror:
        _write_edges(stored, f"{path}/edges_by_dst", "dst", "src", directories)
    degrees(stored).write.mode("overwrite").parquet(f"{path}/degrees")
    spark.read.parquet(f"{path}/degrees").select("root_id").write.mode("overwrite").parquet(f"{path}/neurons")


def _stored(connections: DataFrame | Stored) -> DataFrame:
    """Connections as a written table: edges and rejects read them, edges several times."""
    if isinstance(connections, Stored):
        return require_columns(connections.df, CONNECTIONS.names).select(CONNECTIONS.names)
    return materialize(require_columns(connections, CONNECTIONS.names).select(CONNECTIONS.names), "connections").df


def write_graph(
    connections: DataFrame | Stored, path: str, mirror: bool = False, directories: int | None = None
) -> Graph:
    """Build the graph from connections and replace the tables at `path`, later loads included.
    Connections that are stored already are not written again.

    `mirror` adds a copy of the edges clustered by receiving neuron, for upstream
    queries by id. `directories` splits the edge tables by neuron id (see
    `operators.lookup`): for tables of very many files, so that a query about a few
    neurons opens few of them. Rows without a complete edge key are kept in `rejects`.
    """
    stored = _stored(connections)
    spark = stored.sparkSession
    remove_path(spark, f"{path}/loads")
    _write_latest(stored, f"{path}/edges", directories)
    _write_others(spark, path, mirror, directories)
    rejected_connections(stored).write.mode("overwrite").parquet(f"{path}/rejects")
    return read_graph(spark, path, mirror)


def _next_load(spark: SparkSession, path: str) -> int:
    """Claim the number after the last one that any writer has claimed."""
    taken = [int(name) for name in child_names(spark, f"{path}/loads/claims") if name.isdigit()]
    number = max(taken, default=0) + 1
    if not create_new(spark, f"{path}/loads/claims/{number}"):
        raise LoadConflict(f"load {number} of {path} has been claimed by another writer")
    return number


def upsert_graph(graph: Graph, connections: DataFrame | Stored) -> Graph:
    """Add a load to a graph: its edges replace those with equal keys.

    Only the load is written, as a numbered directory beside the base; the base and other
    loads are not touched. The number is claimed when writing, whatever the handle knows,
    so loads through one handle follow each other; LoadConflict is raised where two writers
    reach for one number at the same time. The load's commit comes last, so a failed one is
    never seen.
    """
    spark = graph.edges.sparkSession
    number = _next_load(spark, graph.path)

    def write(table: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{graph.path}/loads/{table}/load={number}")

    stored = _stored(connections)
    write("edges", latest_in_order(stored))
    written = spark.read.schema(EDGES).parquet(f"{graph.path}/loads/edges/load={number}")
    write("degrees", degrees(written))
    write("rejects", rejected_connections(stored))
    write("commits", spark.range(1).selectExpr("id as committed"))
    return read_graph(spark, graph.path, path_exists(spark, f"{graph.path}/edges_by_dst/_SUCCESS"))


def compact_graph(
    graph: Graph, path: str, mirror: bool = False, directories: int | None = None
) -> Graph:
    """The graph with all loads merged into a new base at a new `path`."""
    if path.rstrip("/") == graph.path.rstrip("/"):
        raise ValueError("compacting reads the old tables, so it needs a new path")
    spark = graph.edges.sparkSession
    remove_path(spark, f"{path}/loads")
    _write_edges(graph.edges.select(EDGES.names), f"{path}/edges", "src", "dst", directories)
    _write_others(spark, path, mirror, directories)
    graph.rejects.write.mode("overwrite").parquet(f"{path}/rejects")
    return read_graph(spark, path, mirror)


def _commits(spark: SparkSession, path: str, as_of: int | None) -> DataFrame:
    commits = spark.read.schema("committed long, load long").parquet(f"{path}/loads/commits")
    return commits if as_of is None else commits.where(F.col("load") <= as_of)


def _loaded(spark: SparkSession, path: str, table: str, schema: StructType, as_of: int | None) -> DataFrame:
    """The rows of the committed loads up to `as_of`, with their `load`."""
    numbered = StructType([*schema.fields, StructField("load", LongType())])
    rows = spark.read.schema(numbered).parquet(f"{path}/loads/{table}")
    return rows.join(_commits(spark, path, as_of).select("load"), "load", "left_semi")


def _merged(base: DataFrame, later: DataFrame) -> DataFrame:
    """The base without the keys that a later edge has, and the later edges."""
    split = [c for c in base.columns if c not in EDGES.names]
    for name in split:
        end, parts = name.rsplit("_mod_", 1)
        later = later.withColumn(name, F.pmod(end, F.lit(int(parts))).cast("int"))
    return base.join(later.select(EDGE_KEY), EDGE_KEY, "left_anti").select(base.columns).unionByName(later)


def read_graph(spark: SparkSession, path: str, mirror: bool = False, as_of: int | None = None) -> Graph:
    """The graph as it stands: the base with the committed loads applied while reading.

    With `as_of`, as it stood after that load; 0 is the base alone.
    """
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
    by_dst = spark.read.schema(EDGES).parquet(f"{path}/edges_by_dst") if mirror else edges
    rejects = spark.read.schema(GOLD).parquet(f"{path}/rejects")
    rejects = rejects.select([c for c in GOLD.names if not c.startswith("dominant_")])
    nodes, counted, loads = spark.read.schema(NEURONS).parquet(f"{path}/neurons"), spark.read.schema(DEGREES).parquet(f"{path}/degrees"), 0
    if path_exists(spark, f"{path}/loads/commits"):
        last, committed = _commits(spark, path, as_of).agg(F.max("load"), F.count("load")).first()
        loads = last or 0
    if loads:
        later = _loaded(spark, path, "edges", EDGES, as_of)
        # a load has a key once: one load is as written, of several the number decides
        if committed > 1:
            values = ["syn_count", *NT_COLUMNS, "ord"]
            later = with_dominant(later.groupBy(EDGE_KEY).agg(*[F.max_by(c, "load").alias(c) for c in values]))
        later = later.select(EDGES.names)
        edges, by_dst = _merged(edges, later), _merged(by_dst, later)
        more = _loaded(spark, path, "degrees", DEGREES, as_of).select(DEGREES.names)
        counted = counted.union(more).groupBy("root_id").agg(F.sum("out_deg").alias("out_deg"), F.sum("in_deg").alias("in_deg"))
        nodes = nodes.union(more.select("root_id")).distinct()
        rejects = rejects.unionByName(_loaded(spark, path, "rejects", CONNECTIONS, as_of).select(rejects.columns))
    return Graph(path, nodes, edges, by_dst, rejects, counted, loads)
