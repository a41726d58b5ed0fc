"""Incremental ingest: each arriving batch of connections updates cube, edges and sketches.

A micro-batch writes one folder per table, a run, and then publishes a snapshot: a small
table that lists the runs that make up everything ingested so far. Readers take the newest
complete snapshot, so no table shows a batch that another one lacks. As soon as FANOUT
runs of one level have come together they are merged into a run of the next level and a
new snapshot lists that one instead: a reader opens a number of runs that grows with the
logarithm of the batches, and a row is rewritten once per level. Runs that a snapshot
lists are never written again, so a failed merge changes nothing, and a batch that the
stream repeats after it has been published is skipped.

Histogram counts add up over raw rows; of edges with equal keys the one of the latest
batch holds, and within a batch the one with the largest `ord`. Rows that cannot become
an edge are kept aside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from edgelytics.functions.transmitters import with_dominant
from edgelytics.operators.edges import latest_edges, rejected_connections
from edgelytics.operators.histogram import connection_cube, merge_cubes
from edgelytics.operators.sketches import id_sketches, merge_sketches
from edgelytics.schema import CONNECTIONS, CUBE, EDGE_KEY, EDGES, NT_COLUMNS, SKETCHES, require_columns
from edgelytics.session import child_names, path_exists, remove_path

FANOUT = 4

TABLES: dict[str, StructType] = {"cube": CUBE, "edges": EDGES, "rejects": CONNECTIONS, "sketches": SKETCHES}


@dataclass(frozen=True, order=True)
class Run:
    """A folder of each table with the batches `first` to `last`, merged `level` times."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}"


def read_connection_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Connections from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(CONNECTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest(connections: DataFrame, path: str, fanout: int = FANOUT) -> DataStreamWriter:
    """A writer that keeps cube, edges, rejects and sketches under `path` up to date.

    Start it with a trigger of your choice; its checkpoint lies under `path` too. One
    stream at a time writes to a path.
    """
    require_columns(connections, CONNECTIONS.names)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number, runs = snapshot(spark, path)
        if not any(run.first <= batch_id <= run.last for run in runs):  # else it stopped after that
            run = Run(batch_id, batch_id, 0)
            batch.persist()  # read once for all tables
            try:
                _write(path, run, {
                    "cube": connection_cube(with_dominant(batch)),
                    "edges": latest_edges(batch),
                    "rejects": rejected_connections(batch),
                    "sketches": id_sketches(batch),
                })
            finally:
                batch.unpersist()
            _publish(spark, path, number + 1, [*runs, run])
        compact(spark, path, fanout)

    return connections.writeStream.foreachBatch(store).option(
        "checkpointLocation", f"{path}/checkpoint"
    )


def _write(path: str, run: Run, tables: dict[str, DataFrame]) -> None:
    # what an attempt left that was never published is replaced
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{table}/{run.name}")


def _publish(spark: SparkSession, path: str, number: int, runs: list[Run]) -> None:
    listed = spark.createDataFrame([(r.first, r.last, r.level) for r in runs], "first long, last long, level long")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshots/{number}")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name in child_names(spark, f"{path}/snapshots") if name.isdigit())


def snapshot(spark: SparkSession, path: str) -> tuple[int, list[Run]]:
    """The number of the newest complete snapshot and its runs, oldest batches first; 0
    and none before the first batch."""
    for number in reversed(_numbers(spark, path)):
        if path_exists(spark, f"{path}/snapshots/{number}/_SUCCESS"):
            rows = spark.read.parquet(f"{path}/snapshots/{number}").collect()  # a row per run
            return number, sorted(Run(r["first"], r["last"], r["level"]) for r in rows)
    return 0, []


def compact(spark: SparkSession, path: str, fanout: int = FANOUT) -> int:
    """Merge every `fanout` runs of a level into one of the next; returns how many merges."""
    merges = 0
    while True:
        number, runs = snapshot(spark, path)
        due = next(
            (same[:fanout] for level in sorted({r.level for r in runs})
             if len(same := [r for r in runs if r.level == level]) >= fanout),
            None,
        )
        if due is None:
            return merges
        merged = Run(due[0].first, due[-1].last, due[0].level + 1)
        _write(path, merged, {table: _merged(spark, path, table, due) for table in TABLES})
        _publish(spark, path, number + 1, sorted([merged, *[r for r in runs if r not in due]]))
        merges += 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last `keep` snapshots, and the runs that none of them lists;
    returns the deleted folders. DataFrames made from older snapshots become invalid."""
    complete = [n for n in _numbers(spark, path) if path_exists(spark, f"{path}/snapshots/{n}/_SUCCESS")]
    kept = complete[-max(1, keep):]
    needed = {
        f"{r['first']}-{r['last']}"
        for number in kept
        for r in spark.read.parquet(f"{path}/snapshots/{number}").collect()
    }
    gone = [f"{path}/snapshots/{n}" for n in complete if n not in kept]
    for table in TABLES:
        gone += [f"{path}/{table}/{name}" for name in child_names(spark, f"{path}/{table}") if name not in needed]
    for folder in gone:
        remove_path(spark, folder)
    return gone


def _rows(spark: SparkSession, path: str, table: str, runs: list[Run]) -> DataFrame:
    """The rows of the runs, with the last batch of their run."""
    schema = TABLES[table]
    if not runs:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    parts = [
        spark.read.schema(schema).parquet(f"{path}/{table}/{run.name}").withColumn("batch", F.lit(run.last).cast("long"))
        for run in runs
    ]
    return reduce(DataFrame.union, parts)


def _latest(batches: DataFrame) -> DataFrame:
    # a run has a key once, so its number decides; `ord` need not grow from batch to batch
    values = ["syn_count", *NT_COLUMNS, "ord"]
    latest = batches.groupBy(EDGE_KEY).agg(*[F.max_by(c, "batch").alias(c) for c in values])
    return with_dominant(latest).select(EDGES.names)


_MERGE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cube": lambda rows: merge_cubes(rows.select(CUBE.names)).select(CUBE.names),
    "edges": _latest,
    "rejects": lambda rows: rows.select(CONNECTIONS.names),
    "sketches": lambda rows: merge_sketches(rows),
}


def _merged(spark: SparkSession, path: str, table: str, runs: list[Run]) -> DataFrame:
    return _MERGE[table](_rows(spark, path, table, runs))


def _current(spark: SparkSession, path: str, table: str) -> DataFrame:
    return _merged(spark, path, table, snapshot(spark, path)[1])


def current_cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube of everything ingested so far."""
    return _current(spark, path, "cube")


def current_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edge of the latest batch per key, of everything ingested so far."""
    return _current(spark, path, "edges")


def current_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Rows ingested so far that miss a part of the edge key."""
    return _current(spark, path, "rejects")


def current_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The id sketches of everything ingested so far, for `operators.sketches.approx_unique_counts`."""
    return _current(spark, path, "sketches")
