"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


@dataclass
class Stored:
    """A table written to the scratch folder."""

    df: DataFrame

    @cached_property
    def rows(self) -> int:
        """The exact row count, taken from the file footers."""
        return self.df.count()


def get_session(app_name: str = "edgelytics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    All are Spark's defaults but two: UTC, and splitting a skewed join partition even
    where the next step then needs a shuffle of its own.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder: on a
    cluster a machine-local path would not be visible to the other executors.
    """
    app = spark.conf.get("spark.app.id")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/edgelytics-{app}"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="edgelytics-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path, never used before, in the scratch folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> Stored:
    """Write `df` to shared storage and read it back: computed once, safe when executors
    are lost, and of a size that the optimizer knows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path))


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch folder; DataFrames reading it become invalid."""
    remove_path(spark, scratch_dir(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file, or return False if it exists: of several writers one gets True."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(found.getParent())
    return files.createNewFile(found)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in files.listStatus(found))
