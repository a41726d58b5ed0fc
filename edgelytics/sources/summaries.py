"""Stored summary documents: JSON files, and a table with one record per dataset id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelytics.schema import SUMMARY_DOCUMENT, SUMMARY_RECORD

# Record columns and where their numbers sit in the document.
_NUMBERS = {
    "total_rows": "$.total_rows",
    "max_rows": "$.max_rows",
    "pre_pt_root_id": "$.unique.pre_pt_root_id",
    "post_pt_root_id": "$.unique.post_pt_root_id",
    "neuron_ids_union": "$.unique.neuron_ids_union",
    "neuropil": "$.unique.neuropil",
    "syn_min": "$.syn_count.min",
    "syn_max": "$.syn_count.max",
    "syn_median": "$.syn_count.median",
}


def write_summary_json(document: DataFrame, path: str) -> str:
    """Write a one-column, one-row summary document as JSON text, replacing `path`."""
    document.select("summary_json").write.mode("overwrite").text(path)
    return path


def read_summary_json(spark: SparkSession, path: str) -> DataFrame:
    """The summary document in a JSON file, or in a folder with one, as `summary_json`."""
    return spark.read.text(path, wholetext=True).select(
        F.trim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("summary_json")
    )


def parse_summary(document: DataFrame) -> DataFrame:
    """The fields of a JSON summary document as typed columns."""
    parsed = F.from_json("summary_json", SUMMARY_DOCUMENT, {"mode": "FAILFAST"})
    return document.select(parsed.alias("summary")).select("summary.*")


def summary_histograms(document: DataFrame) -> DataFrame:
    """All histograms of a document as (neuropil, nt, syn_count, count) rows; null stands
    for all regions or all labels."""
    none, keys = F.lit(None).cast("string"), ["neuropil", "nt"]
    parsed = parse_summary(document)
    regions = parsed.select(F.explode("by_neuropil").alias("neuropil", "found"))
    overall = parsed.select(F.explode("by_neurotransmitter").alias("nt", "found"))
    cells = regions.select("neuropil", F.explode("found.by_neurotransmitter").alias("nt", "found"))
    parts = [
        parsed.select(none.alias("neuropil"), none.alias("nt"), "syn_count.histogram"),
        regions.select("neuropil", none.alias("nt"), "found.histogram"),
        overall.select(none.alias("neuropil"), "nt", "found.histogram"),
        cells.select(*keys, "found.histogram"),
    ]
    return reduce(DataFrame.union, parts).select(*keys, F.inline("histogram"))


def _safe_int(path: str) -> Column:
    """The number at a path, its fraction cut off; text, true and false are not numbers."""
    value = F.try_variant_get(F.try_parse_json("summary_json"), path, "variant")
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$")
    found = F.try_variant_get(F.try_parse_json("summary_json"), path, "double")
    whole = F.try_variant_get(F.try_parse_json("summary_json"), path, "bigint")
    return F.when(number, F.coalesce(whole, found.try_cast("bigint")))


def summary_record(document: DataFrame, dataset_id: str) -> DataFrame:
    """A summary document as a record: the text plus its main numbers as columns.

    A number that is absent or not numeric becomes null; invalid JSON fails.
    """
    broken = F.get_json_object("summary_json", "$").isNull()
    checked = document.select(
        F.when(broken, F.raise_error(F.lit("summary is not valid JSON")))
        .otherwise(F.col("summary_json"))
        .alias("summary_json")
    )
    return checked.select(
        F.lit(dataset_id).alias("dataset_id"),
        "summary_json",
        F.get_json_object("summary_json", "$.input").alias("input"),
        *[_safe_int(path).alias(name) for name, path in _NUMBERS.items()],
        F.current_timestamp().alias("updated_at"),
    )


def push_summary(document: DataFrame, table_path: str, dataset_id: str) -> None:
    """Insert or replace the record of one dataset id; other records are not touched."""
    (
        summary_record(document, dataset_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(table_path)
    )


def fetch_summary(spark: SparkSession, table_path: str, dataset_id: str) -> DataFrame:
    """The record of one dataset id; no row if there is none."""
    table = spark.read.schema(SUMMARY_RECORD).parquet(table_path)
    return table.where(F.col("dataset_id") == dataset_id).select(SUMMARY_RECORD.names)
