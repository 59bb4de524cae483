"""Log and catalogue to a cleaned, balanced, time-split data set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from mediarec.config import CoreConfig, SplitConfig, StaticConfig
from mediarec.operators.degrees import attach_degrees, core_keys
from mediarec.operators.exports import complete_items, export_slices, split_manifest
from mediarec.operators.filters import clean_log, cleaned_pairs
from mediarec.operators.metadata import item_meta, user_meta
from mediarec.operators.skew import HOT_ROWS
from mediarec.operators.splitting import balance_by_category, items_per_day, split_days
from mediarec.operators.staging import stage


@dataclass
class Prepared:
    """The data stage's tables: log rows and catalogue of complete items, the catalogue with views and mean watch time,
    users (of all balanced rows), ground-truth slices, id sets, and the item table they all come from."""

    log: DataFrame
    meta: DataFrame
    item_meta: DataFrame
    users: DataFrame
    slices: DataFrame
    manifest: DataFrame
    items: DataFrame


def core_log(log: DataFrame, meta: DataFrame, core: CoreConfig,
             static: StaticConfig = StaticConfig()) -> DataFrame:
    """Cleaned log pruned to its core: two reads of the raw log, one of them narrow."""
    pairs = stage(cleaned_pairs(log, meta, static), "clean-pairs")
    users, items = core_keys(pairs, core.min_per_user, core.min_per_item, core.rounds)
    return attach_degrees(clean_log(log, static), users, items)


def item_table(pairs: DataFrame, users: DataFrame, items: DataFrame, meta: DataFrame, split: SplitConfig,
               inventory: DataFrame | None = None, modalities: Sequence[str] = ()) -> DataFrame:
    """One row per balanced item: count, category, first date, split, and whether all its files are there; staged.

    `pairs` is (`id_no`, `media_id`, `n`, `first_ds`), `users` and `items` are what
    the pruning left. Dates come from pairs whose user survived, so the log
    itself isn't needed to split it.
    """
    catalogue = balance_by_category(meta.join(items.select("media_id"), "media_id", "left_semi"), split.categories, split.cap)
    kept = stage(items.join(catalogue.select("media_id", "channel_category"), "media_id"), "balanced-items")
    seen = stage(pairs.join(kept.select("media_id"), "media_id", "left_semi").join(users.select("id_no"), "id_no", "left_semi")
                 .groupBy("media_id").agg(F.min("first_ds").alias("upload_ds")), "first-seen")
    # One row per calendar day.
    days = split_days(items_per_day(seen), split)
    table = kept.join(seen, "media_id").join(F.broadcast(days), "upload_ds")
    if inventory is None:
        return stage(table.withColumn("complete", F.lit(True)), "item-table")
    have = complete_items(inventory, modalities).select(F.col("id").alias("media_id"), F.lit(True).alias("complete"))
    return stage(table.join(have, "media_id", "left").na.fill(False, ["complete"]), "item-table")


def item_log(log: DataFrame, users: DataFrame, items: DataFrame, static: StaticConfig = StaticConfig(),
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cleaned rows of the listed users and items, with all columns of the item table: the one join of wide rows."""
    return attach_degrees(clean_log(log, static), users, items, hot_rows)


def balanced_log(log: DataFrame, meta: DataFrame, core: CoreConfig,
                 split: SplitConfig = SplitConfig(),
                 static: StaticConfig = StaticConfig(), inventory: DataFrame | None = None,
                 modalities: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Core log rows of the balanced catalogue with their item's columns, and the item table; both staged.

    Pruning, balancing, dates and splits run on the narrow (user, item, n, date)
    table. The wide rows are read once, when everything about users and items is known.
    """
    pairs = stage(cleaned_pairs(log, meta, static, dates=True), "clean-pairs")
    users, items = core_keys(pairs, core.min_per_user, core.min_per_item, core.rounds)
    table = item_table(pairs, users, items, meta, split, inventory, modalities)
    return stage(item_log(log, users, table, static), "balanced-log"), table


def prepare(log: DataFrame, meta: DataFrame, core: CoreConfig, split: SplitConfig = SplitConfig(),
            static: StaticConfig = StaticConfig(), inventory: DataFrame | None = None,
            modalities: Sequence[str] = ("vision", "audio")) -> Prepared:
    """The whole data stage; results are lazy tables over two staged ones, the rows and the items."""
    rows, items = balanced_log(log, meta, core, split, static, inventory, modalities)
    complete = rows.where("complete")
    catalogue = meta.join(items.where("complete").select("media_id"), "media_id", "left_semi")
    return Prepared(
        complete.drop("channel_category", "complete"), catalogue, item_meta(complete, catalogue), user_meta(rows),
        export_slices(complete, categories=split.categories, category="channel_category"), split_manifest(complete), items)


__all__ = ["Prepared", "balanced_log", "core_log", "item_log", "item_table", "prepare"]
