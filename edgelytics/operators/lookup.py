"""Edge tables split into directories by neuron id, and reading only the needed ones.

A split table carries a partition column such as `src_mod_256`, whose name says which
end of the edge it is taken from and how many parts there are. Queries that start from
a few neurons then list and open the directories of those neurons only. Tables without
such a column are read as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelytics.session import Stored


def split_by(edges: DataFrame, end: str, parts: int) -> tuple[DataFrame, str]:
    """Add the split column for one end; returns the table and the column's name."""
    name = f"{end}_mod_{parts}"
    return edges.withColumn(name, F.pmod(end, F.lit(parts)).cast("int")), name


def split_columns(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if re.fullmatch(r"(src|dst)_mod_\d+", c)]


def _split(edges: DataFrame, end: str) -> tuple[str, int] | None:
    for name in split_columns(edges):
        if name.startswith(f"{end}_"):
            return name, int(name.rsplit("_", 1)[1])
    return None


def near_ids(edges: DataFrame, end: str, ids: Iterable[int]) -> DataFrame:
    """Only the directories that can hold edges with one of the ids at `end`."""
    split = _split(edges, end)
    if split is None:
        return edges
    name, parts = split
    return edges.where(F.col(name).isin(sorted({i % parts for i in ids})))


def near_table(edges: DataFrame, end: str, neurons: Stored, column: str) -> DataFrame:
    """The same for the ids in a stored table. The parts that occur are joined by the split
    column, so Spark prunes directories while it runs; nothing passes through the driver."""
    split = _split(edges, end)
    if split is None:
        return edges
    name, parts = split
    part = F.pmod(column, F.lit(parts)).cast("int").alias("_part")
    # the condition, always true, tells Spark that looking up the parts first pays
    wanted = neurons.df.select(part).distinct().where(F.col("_part") >= 0)
    return edges.join(F.broadcast(wanted), F.col(name) == F.col("_part"), "left_semi")  # a number per directory
