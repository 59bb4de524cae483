"""Ground-truth slices, id sets and histories taken from the split log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from mediarec.config import CATEGORIES
from mediarec.operators.skew import HOT_ROWS, hot_key_join
from mediarec.operators.staging import stage
from mediarec.schemas import require_columns


def complete_items(inventory: DataFrame, modalities: Iterable[str]) -> DataFrame:
    """`id` of the items with a file for every modality; `inventory` is (`id`, `modality`)."""
    wanted = list(modalities)
    flags = inventory.where(F.col("modality").isin(*wanted)).groupBy("id").agg(
        *[F.max(F.col("modality") == m).alias(f"_{i}") for i, m in enumerate(wanted)])
    for i in range(len(wanted)):
        flags = flags.where(F.col(f"_{i}"))
    return flags.select("id")


def require_modalities(df: DataFrame, inventory: DataFrame, modalities: Iterable[str],
                       col: str = "media_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose item has a file for every modality; the catalogue and the log are filtered the same way.

    Rows per item are counted first, so that the rows of a popular item are
    spread over several tasks; `df` is read twice and should be a stored table.
    """
    complete = complete_items(inventory, modalities).withColumnRenamed("id", col)
    counted = stage(df.groupBy(col).agg(F.count(F.lit(1)).alias("_rows")).join(complete, col), "complete-items")
    return hot_key_join(df, counted, col, "_rows", hot_rows).drop("_rows").select(*df.columns)


def export_slices(df: DataFrame, meta: DataFrame | None = None, categories: Iterable[str] = CATEGORIES,
                  category: str | None = None) -> DataFrame:
    """(`slice`, `media_id`, `id_no`, `score`): every ground-truth slice in one table.

    Slices are `<split>/total`, `/cold` and `/warm`; with `meta`, also
    `test/total_<category>`, `test/cold_<category>` and `test/warm_<category>`.
    Where the rows have their category already, `category` names that column and
    nothing is joined. A row joins each slice it belongs to: two, or four for a
    categorised test row.
    """
    require_columns(df, "media_id", "id_no", "score", "split", "wc_split")
    kind = F.when(F.col("wc_split") == F.concat(F.lit("c_"), "split"), "cold").when(
        F.col("wc_split") == F.concat(F.lit("w_"), "split"), "warm")
    names = [F.concat("split", F.lit("/total")), F.concat("split", F.lit("/"), kind)]
    label = None
    if category is not None:
        label = F.when(F.col(category).isin(*list(categories)), F.col(category))
    elif meta is not None:
        labels = meta.where(F.col("channel_category").isin(*list(categories))).select(
            "media_id", F.col("channel_category").alias("_cat"))
        df, label = df.join(labels, "media_id", "left"), F.col("_cat")
    if label is not None:
        tail = F.when(F.col("split") == "test", F.concat(F.lit("_"), label))
        names += [F.concat(n, tail) for n in names]
    return df.select(
        F.explode(F.array_compact(F.array(*names))).alias("slice"), "media_id", "id_no", "score")


def split_manifest(df: DataFrame) -> DataFrame:
    """(`split`, `id_set`, `id`): the six distinct id sets of each split.

    Sets are all/cold/warm of items and of users. They are rows and not
    arrays, because the users of a split would not fit one row.
    """
    kind = F.substring("wc_split", 1, 1)
    group = F.when(kind == "c", "cold").when(kind == "w", "warm")
    pairs = F.array(
        F.struct(F.lit("item").alias("side"), F.col("media_id").alias("id")),
        F.struct(F.lit("user").alias("side"), F.col("id_no").alias("id")))
    # One aggregate: an id's cold and warm flags decide its sets.
    flags = (
        df.select("split", group.alias("_group"), F.inline(pairs)).where(F.col("id").isNotNull())
        .groupBy("split", "side", "id").agg(
            F.bool_or(F.col("_group") == "cold").alias("_cold"), F.bool_or(F.col("_group") == "warm").alias("_warm"))
    )
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("_cold"), "cold"), F.when(F.col("_warm"), "warm")))
    return flags.select("split", F.explode(sets).alias("_set"), "side", "id").select(
        "split", F.concat("_set", F.lit("_"), "side").alias("id_set"), "id")


def user_histories(df: DataFrame, max_items: int = 1000,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """(`id_no`, `part`, `items`, `views`): items of each user, in sorted lists.

    Repeat views are counted in `views`, which runs parallel to `items`. A
    user with more than `max_items` items gets several parts of about that
    size, dealt by md5 of the item, so no list grows without bound.
    """
    pairs = stage(df.dropna(subset=["id_no", "media_id"]).groupBy("id_no", "media_id").agg(
        F.count(F.lit(1)).alias("views")), "views")
    sizes = stage(pairs.groupBy("id_no").agg(F.count(F.lit(1)).alias("_items")), "view-sizes")
    n_parts = F.ceil(F.col("_items") / F.lit(max_items))
    digest = F.conv(F.substring(F.md5("media_id"), 1, 8), 16, 10).cast("long")
    # One user can own most of the pairs: spread that user before the lists are built.
    return (
        hot_key_join(pairs, sizes, "id_no", "_items", hot_rows)
        .groupBy("id_no", (digest % n_parts).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("media_id", "views"))).alias("h"))
        .select("id_no", "part", F.col("h.media_id").alias("items"), F.col("h.views").alias("views"))
    )
