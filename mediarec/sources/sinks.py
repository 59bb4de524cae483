"""Stage outputs and exports.

Partitioned exports go through the `rebalance` hint: adaptive execution cuts
a large partition value into several files of even size and packs small ones,
so neither one huge task nor a flood of small files results.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame

from mediarec.schemas import require_columns


def write_stage(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """Parquet stage output; `compression="none"` gives plain index tables."""
    df.write.mode(mode).options(**options).parquet(path)


# Fixed value: the slice that is written although no row belongs to it.
EMPTY_SLICES = ("train/cold",)


def write_slices(df: DataFrame, path: str, mode: str = "errorifexists", always: tuple[str, ...] = EMPTY_SLICES) -> None:
    """Ground-truth slices as JSON records, one folder per slice; those in `always` get a folder even without rows."""
    require_columns(df, "slice", "media_id", "id_no", "score")
    df.hint("rebalance", "slice").write.mode(mode).partitionBy("slice").json(path)
    spark = df.sparkSession
    for name in always:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slice={name.replace('/', '%2F')}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Id sets as JSON records, one folder per split and set."""
    require_columns(df, "split", "id_set", "id")
    df.hint("rebalance", "split", "id_set").write.mode(mode).partitionBy("split", "id_set").json(path)


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Item vectors in Parquet, one folder per modality."""
    require_columns(df, "item_id", "modality", "vec")
    df.hint("rebalance", "modality").write.mode(mode).partitionBy("modality").parquet(path)


def write_factors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(`id`, `vec`) in Parquet."""
    require_columns(df, "id", "vec").select("id", "vec").write.mode(mode).parquet(path)


def save_als(model: ALSModel, path: str) -> None:
    model.write().save(path)


def load_als(path: str) -> ALSModel:
    return ALSModel.load(path)


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric rows as JSON records."""
    df.write.mode(mode).json(path)
