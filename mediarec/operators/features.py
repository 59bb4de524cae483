"""Content features: inventories, pooling, assembly and lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from mediarec.schemas import require_columns


def pending_items(catalog: DataFrame, done: DataFrame, col: str = "id") -> DataFrame:
    """Distinct catalogue ids that have no output yet."""
    return catalog.select(col).distinct().join(done.select(col), col, "left_anti")


def select_targets(features: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature rows of catalogue items, and one row with `kept` and `rejected` counts."""
    known = catalog.select("item_id").distinct()
    kept = features.join(known, "item_id", "left_semi")
    flagged = features.select("item_id").join(known.withColumn("_known", F.lit(True)), "item_id", "left")
    counts = flagged.agg(
        F.count_if(F.col("_known").isNotNull()).alias("kept"),
        F.count_if(F.col("_known").isNull()).alias("rejected"))
    return kept, counts


def _mean_vector(vec: str) -> Column:
    # Summarizer combines partial means map-side, so a long sequence is never gathered.
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))


def pool_segments(df: DataFrame, id_col: str, pos: str, vec: str, size: int = 10) -> DataFrame:
    """(`id`, `segment`, `vec`): mean vector of each run of `size` positions."""
    segment = F.floor(F.col(pos) / size).alias("segment")
    return df.groupBy(id_col, segment).agg(_mean_vector(vec).alias(vec))


def pool_mean(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(`id`, `vec`): mean vector of the whole sequence."""
    return df.groupBy(id_col).agg(_mean_vector(vec).alias(vec))


def assemble_modalities(features: DataFrame, factors: DataFrame, ids: DataFrame | None,
                        modalities: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """One training row per item: a column per modality and `cf`, and a loss count.

    Features outside the id list go before the first vector moves; the rest are
    shuffled once, by item, and gathered without sorting. Items lacking a
    modality or a factor are left out; the second table says how many were
    asked for, complete and dropped. Two vectors of one modality are an error.
    """
    wanted = list(modalities)
    require_columns(features, "item_id", "modality", "vec")
    chosen = features.where(F.col("modality").isin(*wanted) & F.col("vec").isNotNull())
    cf = factors.select(F.col("id").alias("item_id"), F.col("vec").alias("cf"))
    asked = None
    if ids is not None:
        asked = ids.select(F.col("id").alias("item_id")).distinct()
        chosen = chosen.join(asked, "item_id", "left_semi")
    # As many entries as modalities.
    wide = chosen.groupBy("item_id").agg(F.collect_list(F.struct("modality", "vec")).alias("_v"))

    def only(m: str) -> Column:
        found = F.filter("_v", lambda v: v["modality"] == m)
        again = F.raise_error(F.concat(F.lit(f"two vectors of {m} for item "), F.col("item_id").cast("string")))
        return F.when(F.size(found) > 1, again.cast("array<double>")).otherwise(F.get(found, F.lit(0))["vec"]).alias(m)

    wide = wide.select("item_id", *[only(m) for m in wanted])
    rows = (wide if asked is None else asked.join(wide, "item_id", "left")).join(cf, "item_id", "left")
    complete = F.lit(True)
    for c in [*wanted, "cf"]:
        complete = complete & F.col(c).isNotNull()
    counts = rows.agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(complete).alias("complete"),
        F.count_if(~complete).alias("dropped"))
    return rows.where(complete), counts


def lookup_vectors(ids: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of an id list, and one row with `found` and `missing` counts."""
    asked = ids.select("id").distinct()
    found = asked.join(factors.select("id", "vec"), "id")
    flags = asked.join(factors.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    counts = flags.agg(
        F.count_if(F.col("_hit").isNotNull()).alias("found"),
        F.count_if(F.col("_hit").isNull()).alias("missing"))
    return found, counts
