"""Exploratory reports over the enriched connections, and row caps."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelytics.schema import NT_LABELS
from edgelytics.session import materialize


def connections_per_neuropil(gold: DataFrame) -> DataFrame:
    """Rows per region, most first; rows without a region form their own group."""
    counted = gold.groupBy("neuropil").agg(F.count("*").alias("connections"))
    return counted.orderBy(F.desc("connections"), "neuropil")


def dominant_nt_distribution(gold: DataFrame) -> DataFrame:
    """Rows per dominant-NT text, most first; a tie is its own text."""
    counted = gold.groupBy("dominant_nt").agg(F.count("*").alias("connections"))
    return counted.orderBy(F.desc("connections"), "dominant_nt")


def avg_dominant_score(gold: DataFrame) -> DataFrame:
    """Mean dominant score per dominant-NT text, highest first."""
    averaged = gold.groupBy("dominant_nt").agg(F.avg("dominant_score").alias("avg_score"))
    return averaged.orderBy(F.desc("avg_score"), "dominant_nt")


def label_texts() -> list[str]:
    """Every dominant-NT text there can be: each subset of the labels in vocabulary order,
    the empty one for rows without a label."""
    sizes = range(len(NT_LABELS) + 1)
    return [",".join(labels) for size in sizes for labels in combinations(NT_LABELS, size)]


def neuropil_nt_matrix(gold: DataFrame) -> DataFrame:
    """Rows per region (down) and dominant-NT text (across), zero where there are none.

    There is a column for each of `label_texts`, so every row is in exactly one cell and
    no job has to look the texts up.
    """
    return gold.groupBy("neuropil").pivot("dominant_nt", label_texts()).count().fillna(0)


def neuropil_nt_counts(gold: DataFrame) -> DataFrame:
    """The matrix in long form, with every combination that occurs."""
    return gold.groupBy("neuropil", "dominant_nt").agg(F.count("*").alias("connections"))


def schema_report(df: DataFrame) -> DataFrame:
    """Each column's name and type, in order, beside the table's row count."""
    columns = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    counted = df.agg(F.count("*").alias("total_rows"))
    return counted.select(F.inline(columns), "total_rows")


def first_n_rows(df: DataFrame, n: int, ord_column: str = "ord") -> DataFrame:
    """The n rows that come first by `ord_column` (not null), ties by the other columns.

    The rows are sorted once, by ranges, and written. Ranges before the one in which the
    cap falls are kept whole, and only that one is cut, so the cap may be as large as the
    table. One row count per range is summed up; the number of the cut range and the rows
    left for it reach the driver.
    """
    order = [ord_column, *[c for c in df.columns if c != ord_column]]
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = materialize(ranges.withColumn("_range", F.spark_partition_id()), "ranges").df
    counted = ranked.groupBy("_range").agg(F.count("*").alias("rows"))
    counted = counted.withColumn("running", F.sum("rows").over(W.orderBy("_range")))
    cut = counted.where(F.col("running") >= n).orderBy("_range").first()
    if cut is None:
        return ranked.drop("_range")
    within = ranked.where(F.col("_range") == cut["_range"]).orderBy(*order)
    left = n - (cut["running"] - cut["rows"])
    return ranked.where(F.col("_range") < cut["_range"]).union(within.limit(left)).drop("_range")
