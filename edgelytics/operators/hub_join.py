"""An equi-join on neuron ids whose hub keys are dealt to many tasks.

A neuron with l rows on one side and r on the other makes l * r rows. Spark splits a
partition by the bytes it reads, not by the rows it makes, so a hub's output would come
from one task. Both sides of a hub are therefore cut into pieces, and each piece of one
meets each piece of the other as a key of its own. Rows are the same as those of a plain
join; how many pieces a key has follows from its counts alone. A join without hubs that
makes many rows is likewise dealt to as many tasks as its rows need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelytics.session import materialize

# Rows that one key may make in a task, about; a hub's cell is up to this large.
CELL_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks share so many rows, CELL_ROWS each; None if few enough to leave to Spark."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / CELL_ROWS)) if rows > 4 * CELL_ROWS else None


def hub_join(
    left: DataFrame,
    left_key: str,
    right: DataFrame,
    right_key: str,
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
) -> DataFrame:
    """All columns of both sides for each pair of rows with equal, non-null keys.

    Column names of the two sides must differ. Keys are counted first, by combined
    aggregations; only keys that make over CELL_ROWS rows are cut. A side whose counts are
    known, as (key, rows) that may be upper bounds, is not read for it, unless the bounds
    say that the join makes many rows: how many tasks share them then takes true counts.
    """
    return sized_join(left, left_key, right, right_key, left_counts, right_counts)[0]


def sized_join(
    left: DataFrame,
    left_key: str,
    right: DataFrame,
    right_key: str,
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    right_weight: Column | None = None,
    left_exact: bool = False,
) -> tuple[DataFrame, int]:
    """`hub_join`, and how many rows it makes at most. With `right_weight`, a row of the right
    side counts as so many, such as the values in its list. `left_exact`: the left counts are
    no bounds, so that side is never read to be counted."""
    spark, cells = left.sparkSession, CELL_ROWS
    side = max(1, math.isqrt(cells))

    def counted_side(table: DataFrame, key: str, known: DataFrame | None, name: str, weight: Column | None = None) -> DataFrame:
        if known is None:
            rows = F.count("*") if weight is None else F.sum(weight)
            return table.groupBy(F.col(key).alias("_key")).agg(rows.alias(name))
        return known.toDF("_key", name)

    def key_counts(left_known: DataFrame | None, right_known: DataFrame | None) -> DataFrame:
        ones = counted_side(left, left_key, left_known, "_l")
        others = counted_side(right, right_key, right_known, "_r", right_weight)
        return ones.join(others, "_key").select("_key", "_l", "_r", (F.col("_l") * F.col("_r")).alias("_rows"))

    hub = F.col("_rows") > cells

    def totals(counts: DataFrame) -> tuple[int, int]:
        rows, hubs = counts.agg(F.sum("_rows"), F.count(F.when(hub, 1))).first()
        return rows or 0, hubs

    joined = F.col(left_key) == F.col(right_key)
    if left_counts is not None or right_counts is not None:
        rows, hubs = totals(key_counts(left_counts, right_counts))
        if not hubs and tasks_for(spark, rows) is None:
            return left.join(right, joined), rows
    # sides are read to be counted, so the counts are written before they are used again
    counted = materialize(key_counts(left_counts if left_exact else None, None), "key-counts").df
    rows, hubs = totals(counted)
    if not hubs:
        # Spark would choose the tasks by the bytes they read
        tasks = tasks_for(spark, rows)
        if tasks is None:
            return left.join(right, joined), rows
        return left.repartition(tasks, left_key).join(right.repartition(tasks, right_key), joined), rows
    # a side may have fewer rows than a cell is wide: the other side's pieces are longer then
    wide = F.least(F.col("_l"), F.lit(side))
    high = F.ceil(F.lit(cells) / wide)
    grid = counted.where(hub).select(
        "_key", F.ceil(F.col("_l") / wide).cast("int").alias("_a"), F.ceil(F.col("_r") / high).cast("int").alias("_b")
    )

    def dealt(table: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in one of its own side's pieces, once for each piece of the other side."""
        named = table.join(grid, F.col(key) == F.col("_key"), "left")
        many = {c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)}
        place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]), many[own]).cast("int")
        return named.select(
            *[F.col(f"`{c}`") for c in table.columns], place.alias(f"{own}_at"),
            F.explode(F.sequence(F.lit(0), many[other] - 1)).alias(f"{other}_at"),
        )

    one = dealt(left, left_key, "_a", "_b")
    two = dealt(right, right_key, "_b", "_a").withColumnsRenamed({"_a_at": "_a_to", "_b_at": "_b_to"})
    # so many partitions whatever the bytes: what the join makes decides, not what it reads
    parts = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * rows / cells)))
    one = one.repartition(parts, left_key, "_a_at", "_b_at")
    two = two.repartition(parts, right_key, "_a_to", "_b_to")
    met = joined & (F.col("_a_at") == F.col("_a_to")) & (F.col("_b_at") == F.col("_b_to"))
    return one.join(two, met).drop("_a_at", "_b_at", "_a_to", "_b_to"), rows
