"""The enriched connections as a Parquet dataset partitioned by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from edgelytics.functions.transmitters import drop_probabilities, with_dominant
from edgelytics.schema import GOLD, GOLD_NARROW


def write_gold(
    connections: DataFrame,
    path: str,
    keep_probabilities: bool = True,
) -> str:
    """Enrich connections and replace the dataset at `path`, one directory per region.

    Rows are rebalanced by region: AQE spreads a large region over many tasks and
    files and packs small ones together. Files are ordered by synapse count, so that
    a threshold skips row groups. Rows without a region go to the null directory.
    """
    gold = with_dominant(connections)
    if not keep_probabilities:
        gold = drop_probabilities(gold)
    (
        gold.hint("rebalance", "neuropil")
        .sortWithinPartitions("neuropil", "syn_count")
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "static")
        .partitionBy("neuropil")
        .parquet(path)
    )
    return path


def read_gold(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    has_probabilities: bool = True,
) -> DataFrame:
    """Scan the dataset with a fixed schema, so region names are never read as numbers.

    Filters on `neuropil` choose directories; filters on `syn_count` reach the files.
    """
    schema = GOLD if has_probabilities else GOLD_NARROW
    gold = spark.read.schema(schema).parquet(path)
    return gold.select(*(columns or schema.names))
