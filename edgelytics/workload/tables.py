"""The edge data model derived from the test tables.

The tables hold no connection list, so one is derived: each order line links its part
(sending neuron) to the customer of its order (receiving neuron) in a region made of
the line's flags. Every part of it is computed from the whole tables. The same
expressions run in Spark and in the SQL counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelytics.functions.transmitters import with_dominant
from edgelytics.session import Stored, path_exists, scratch_path
from edgelytics.sources.graph import Graph, read_graph, write_graph

_PROBABILITY = "case when l_orderkey % 97 = 0 then null else cast(({0}) % 5 as double) / 4 end as {1}"

# `ord` orders the rows of one edge key, which holds the part and the customer: order line
# and supplier then tell rows apart, up to ten million suppliers and 9 * 10^10 orders.
CONNECTION_COLUMNS = [
    "(l_orderkey * 10 + l_linenumber) * 10000000 + l_suppkey % 10000000 as ord",
    "case when l_orderkey % 1009 = 0 then null else l_partkey end as pre_pt_root_id",
    "o_custkey as post_pt_root_id",
    "case when l_orderkey % 103 = 0 then null else concat(l_returnflag, '_', l_linestatus) end as neuropil",
    "case when l_orderkey % 101 = 0 then null else cast(l_quantity as int) end as syn_count",
    _PROBABILITY.format("l_orderkey * 7 + l_linenumber * 3", "gaba_avg"),
    _PROBABILITY.format("l_partkey * 11 + l_linenumber * 5", "ach_avg"),
    _PROBABILITY.format("l_suppkey * 13 + l_linenumber * 7", "glut_avg"),
    _PROBABILITY.format("l_orderkey * 3 + l_partkey", "oct_avg"),
    _PROBABILITY.format("l_partkey * 3 + l_suppkey", "ser_avg"),
    _PROBABILITY.format("l_suppkey * 3 + l_orderkey", "da_avg"),
]

# Two loads for the queries that need an earlier and a later one.
FIRST_LOAD = "o_orderdate < timestamp '1998-04-25 00:00:00'"
SECOND_LOAD = "o_orderdate >= timestamp '1998-04-25 00:00:00'"


def connections(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(where)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(*CONNECTION_COLUMNS)


def stored_loads(spark: SparkSession, sf_dir: str) -> tuple[Stored, Stored]:
    """The connections of the two loads, written in one pass: order lines are joined once for both."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = orders.withColumn("load", F.expr(f"case when {FIRST_LOAD} then 1 when {SECOND_LOAD} then 2 end"))
    joined = lines.join(orders.where("load is not null"), lines.l_orderkey == orders.o_orderkey)
    derived = joined.selectExpr(*CONNECTION_COLUMNS, "load")
    path = scratch_path(spark, "connections")
    derived.write.partitionBy("load").parquet(path)
    written = spark.read.schema(derived.schema).parquet(path)
    first, second = (Stored(written.where(F.col("load") == n).drop("load")) for n in (1, 2))
    return first, second


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dominant(connections(spark, sf_dir))


# Directories of each edge table; a table of very many files takes more.
DIRECTORIES = 4

_loaded: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph tables, loaded before the first graph query of a session.

    Like any graph store they are written once and then queried; they lie in the
    scratch folder and are loaded again if it has been released.
    """
    key = (spark.conf.get("spark.app.id"), sf_dir)
    path = _loaded.get(key)
    if path is None or not path_exists(spark, f"{path}/rejects/_SUCCESS"):
        path = load_graph(spark, sf_dir).path
        _loaded[key] = path
    return read_graph(spark, path, mirror=True)


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """With a copy by receiving neuron, and both split into directories by neuron id."""
    target = scratch_path(spark, "graph")
    return write_graph(connections(spark, sf_dir), target, mirror=True, directories=DIRECTORIES)
