"""Spark data source `arrow_ipc`: connections from Arrow IPC (Feather v2) files.

    register(spark)
    spark.read.format("arrow_ipc").load("/data/connections.feather")

Options: `path` (a file, or a folder with *.feather / *.arrow / *.ipc files),
`columns` (comma-separated; only these are decoded) and `first_file`. The `ord` column is
made from the position of a row: file, record batch, row. Files are numbered in the order
of their paths from `first_file` on; give each later load the number of files read before
it, so that its rows come after theirs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from edgelytics.schema import CONNECTIONS

_SUFFIXES = (".feather", ".arrow", ".ipc")
# Files up to this size are one task and are not opened while planning.
_WHOLE_FILE_BYTES = 128 * 1024 * 1024
# Footers of larger files are read this many at a time while planning.
_FOOTER_THREADS = 32
# Bits of `ord` for the batch within its file and the row within its batch.
_BATCH_BITS, _ROW_BITS = 18, 25
# What is left of a bigint for the file.
_FILE_BITS = 63 - _BATCH_BITS - _ROW_BITS


# Spark's names for a file system that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    scheme, sep, rest = path.partition("://")
    uri = f"{_SCHEMES.get(scheme, scheme)}{sep}{rest}"
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as unknown:
        raise ValueError(
            f"Arrow IPC files are read through Arrow's own file systems, which do not know {path!r}: "
            "use a local, hdfs, s3, gs or abfs path"
        ) from unknown


@dataclass
class _Batches(InputPartition):
    path: str
    file_index: int
    first: int
    last: int | None  # exclusive; None is the end of the file


class _IpcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, first_file: int = 0) -> None:
        self.schema = schema
        self.path = path
        self.first_file = first_file

    def partitions(self) -> list[_Batches]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(root)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == pafs.FileType.Directory:
            listed = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = sorted((f for f in listed if f.path.endswith(_SUFFIXES)), key=lambda f: f.path)
        else:
            files = [found]

        def split(index: int, file: pafs.FileInfo) -> list[_Batches]:
            index += self.first_file
            if file.size <= _WHOLE_FILE_BYTES:
                return [_Batches(file.path, index, 0, None)]
            with fs.open_input_file(file.path) as handle:
                batches = ipc.open_file(handle).num_record_batches
            pieces = min(batches, -(-file.size // _WHOLE_FILE_BYTES))
            cuts = [batches * i // pieces for i in range(pieces + 1)]
            return [_Batches(file.path, index, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

        with ThreadPoolExecutor(_FOOTER_THREADS) as pool:
            return [part for parts in pool.map(split, *zip(*enumerate(files))) for part in parts]

    def read(self, partition: _Batches) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        target = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as handle:
            names = ipc.open_file(handle).schema.names
            wanted = [n for n in target.names if n != "ord"]
            missing = [n for n in wanted if n not in names]
            if missing:
                raise ValueError(f"Missing columns in {partition.path}: {missing}")
            # With nothing but `ord` asked for, one column still has to tell the row count.
            fields = [names.index(n) for n in wanted] or [0]
            options = ipc.IpcReadOptions(included_fields=sorted(fields))
            reader = ipc.open_file(handle, options=options)
            last = reader.num_record_batches if partition.last is None else partition.last
            for number in range(partition.first, last):
                yield _conform(reader.get_batch(number), target, partition.file_index, number)


def _conform(
    batch: pa.RecordBatch, target: pa.Schema, file_index: int, number: int
) -> pa.RecordBatch:
    fits = batch.num_rows < 1 << _ROW_BITS and number < 1 << _BATCH_BITS and file_index < 1 << _FILE_BITS
    if not fits:
        raise ValueError("too many rows in a record batch, batches in a file or files to number them")
    start = ((file_index << _BATCH_BITS) | number) << _ROW_BITS
    columns = []
    for field in target:
        if field.name == "ord":
            columns.append(pa.array(np.arange(start, start + batch.num_rows, dtype=np.int64)))
        else:
            columns.append(batch.column(field.name).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=target)


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        unknown = [c for c in asked if c not in CONNECTIONS.names]
        if unknown:
            raise ValueError(f"Unknown columns: {unknown}")
        return StructType([CONNECTIONS[c] for c in asked or CONNECTIONS.names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IpcReader(schema, self.options["path"], int(self.options.get("first_file", 0)))


def register(spark: SparkSession) -> None:
    # By value, so that executors need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules["edgelytics.schema"])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArrowIpcSource)


def read_ipc(
    spark: SparkSession, path: str, columns: list[str] | None = None, first_file: int = 0
) -> DataFrame:
    """Connections of an Arrow IPC file or folder; `columns` limits what is decoded, and
    `first_file` is the number of the first file, for loads after the first."""
    register(spark)
    reader = spark.read.format("arrow_ipc").option("first_file", first_file)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path)
