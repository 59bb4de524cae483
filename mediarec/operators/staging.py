"""Written tables that cut lineage between the steps of a long job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
# Shuffle files of a job go as soon as it has ended: for jobs whose result is written, so that nothing reads them again.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]):
    """Settings of the session while a block of code runs."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the session's `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a folder of its own;
    on a cluster a machine-local folder would be lost with its executor.
    """
    global _local_root
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="mediarec-stage-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def _app_folder(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/mediarec/{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete every table this application staged; call it when its results are written."""
    drop_path(spark, _app_folder(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one table this application staged, for loops that stage a table each round."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame | None) -> None:
    """Delete the files of a staged table that nothing reads any more; None is no table."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
        drop_path(df.sparkSession, folder)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path among the staged tables, for files in another format than Parquet."""
    return f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` once as Parquet and return a scan of it.

    Unlike a checkpoint of the row data this computes the plan a single time,
    stays columnar, and survives the loss of any executor. The shuffle files of
    the write are deleted with its end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, CLEANED):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
