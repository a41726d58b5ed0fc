"""Helpers shared by the operators: words, text batches, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from edgelytics.session import materialize

#: The characters that separate words, and a run of others, as Java and Python patterns take them.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared scratch folder and read back."""
    return materialize(df, label).df


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes. bytes.split() cuts them at exactly BLANKS."""
    return column.cast(pa.large_binary()).to_pylist()


def text_column(column: str = "text") -> Column:
    """The text as a string; null stays null."""
    return F.col(column).cast("string")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that `column` has about `most` bytes in each piece; a row is never cut."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column))
        if data.nbytes <= most or batch.num_rows < 2:
            yield batch
            continue
        start = size = 0
        for row, length in enumerate(pc.binary_length(data).to_pylist()):
            size += length or 0
            if size >= most:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def frequency_floor(table: DataFrame, count: str, most: int) -> int:
    """The least count of a row among the most frequent ones, as many as `most` allows.

    It is the lower end of a class of counts, so that a small table of class sizes decides
    it and nothing is sorted.
    """
    steps = 8  # classes to each doubling, 512 in all at most
    named = F.floor(F.log2(F.col(count)) * steps).cast("int")
    sizes = table.filter(F.col(count) > 0).groupBy(named.alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.min(count).alias("least"))
    taken, least = 0, (1 << 63) - 1
    for r in sorted(sizes.collect(), key=lambda r: -r["class"]):
        taken += r["rows"]
        if taken > most:
            break
        least = r["least"]
    return least


def most_frequent(table: DataFrame, count: str, most: int) -> tuple[list[Row], int]:
    """(rows, least): all rows with at least `least` in `count`, as `frequency_floor` has it;
    only these come to the driver."""
    least = frequency_floor(table, count, most)
    return table.filter(F.col(count) >= least).collect(), least
