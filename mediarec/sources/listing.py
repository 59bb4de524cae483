"""Inventory of stored files, listed by tasks: no file status passes through the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediarec.operators.staging import stage

#: Rows of one Arrow batch that leaves a task.
BATCH = 10_000

Store = tuple[fs.FileSystem, str]


def _hidden(name: str) -> bool:
    """Names that Spark's own scans pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(root: str, suffix: str, open_store: Callable[[str], Store]):
    """Task that lists folders, named by their path below `root`, one level deep."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                # The root has to exist; a folder may go while the walk is on its way.
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=folder != ""))
                kept = [(f"{folder}/{e.base_name}" if folder else e.base_name, e.type == fs.FileType.Directory) for e in found
                        if not _hidden(e.base_name) and (e.type == fs.FileType.Directory or e.base_name.endswith(suffix))]
                for at in range(0, len(kept), BATCH):
                    names, folders = zip(*kept[at:at + BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())],
                                                     ["name", "folder"])

    return listed


def file_inventory(spark: SparkSession, path: str, suffix: str,
                   open_store: Callable[[str], Store] = fs.FileSystem.from_uri) -> DataFrame:
    """(`id`, `path`) of the files below a folder whose names end in `suffix`; contents are not read.

    The tree is walked level by level. A level's folders are a table, dealt out
    one at a time; tasks write what they find, and the folders among it are the
    next level. The driver learns a number per level. `id` is the file's name
    without the suffix. Names with a leading dot or underscore are passed over,
    as in Spark's scans; a folder that doesn't exist is an error. A task holds
    the entries of one folder. `open_store` gives the tasks a file system and the
    folder's path in it, for stores whose address pyarrow doesn't know.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    shown, task = place.toString().rstrip("/"), _entries(place.toUri().toString(), suffix, open_store)
    level, n, levels = spark.createDataFrame([("",)], "name string"), 1, []
    while n:
        # A number of tasks given here is not merged again by adaptive execution.
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        found = stage(level.repartition(tasks).mapInArrow(task, "name string, folder boolean"), "listing", "folder")
        levels.append(found.where(~F.col("folder")).select("name"))
        level = found.where("folder").select("name")
        n = level.count()
    name = F.substring_index("name", "/", -1)
    return reduce(DataFrame.unionByName, levels).select(
        F.left(name, F.length(name) - F.lit(len(suffix))).alias("id"), F.concat(F.lit(f"{shown}/"), "name").alias("path"))
