"""Category balancing and the split of items by first-seen date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mediarec.config import CATEGORIES, SplitConfig
from mediarec.operators.skew import HOT_ROWS, hot_key_join
from mediarec.operators.staging import stage

# Buckets in which a category is cut down first, so that no task sorts a whole category.
CAP_BUCKETS = 64


def balance_by_category(meta: DataFrame, categories: Iterable[str] = CATEGORIES,
                        cap: int = 10_000, buckets: int = CAP_BUCKETS) -> DataFrame:
    """At most `cap` catalogue rows in each named category, lowest ids first.

    The lowest `cap` ids of a category lie among the lowest `cap` of each of
    its hash buckets, so a first ranking per bucket leaves at most
    `cap * buckets` rows for the final ranking of a category.
    """
    pool = meta.where(F.col("channel_category").isin(*categories))
    bucket = F.pmod(F.xxhash64("media_id"), F.lit(buckets))
    pool = pool.withColumn("_bucket", bucket)
    first = W.partitionBy("channel_category", "_bucket").orderBy("media_id")
    final = W.partitionBy("channel_category").orderBy("media_id")
    return (
        pool.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap)
        .withColumn("_n", F.row_number().over(final)).where(F.col("_n") <= cap)
        .drop("_n", "_bucket")
    )


def item_first_seen(log: DataFrame) -> DataFrame:
    """First date of each item, taken as its upload date."""
    return log.groupBy("media_id").agg(F.min("ds").alias("upload_ds"))


def items_per_day(first_seen: DataFrame) -> DataFrame:
    """Items per upload date."""
    return first_seen.groupBy("upload_ds").agg(F.count(F.lit(1)).alias("count"))


def cumulative_ratio(days: DataFrame, total: int | None = None) -> DataFrame:
    """Running item count over upload dates and its share of `total`.

    `total=None` uses the true sum. The window has no partition key; its input
    is one row per calendar day, whatever the size of the log.
    """
    order = W.partitionBy(F.lit(0)).orderBy("upload_ds")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total_col = F.sum("count").over(whole) if total is None else F.lit(total).cast("long")
    return (
        days.withColumn("total", total_col)
        .withColumn("cumsum", F.sum("count").over(running))
        .withColumn("cum_ratio", F.col("cumsum") / F.col("total"))
    )


def temporal_split(days: DataFrame, train: float = 0.9, valid: float = 0.95) -> DataFrame:
    """Label days by running ratio: below `train`, up to `valid`, above it."""
    ratio = F.col("cum_ratio")
    split = F.when(ratio > valid, "test").when(ratio >= train, "valid").otherwise("train")
    return days.withColumn("split", split).withColumn("wc_split", F.concat(F.lit("c_"), "split"))


def day_bucket(day: Column, seed: int) -> Column:
    """0..99 from the first eight hex digits of md5(seed, day)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), day.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def _warm_label(day: Column, seed: int) -> Column:
    bucket = day_bucket(day, seed)
    return F.when(bucket < 10, "test").when(bucket < 19, "valid").otherwise("train")


def warm_split(train_days: DataFrame, seed: int = 42) -> DataFrame:
    """Deal the train days out: 10 % warm test, 9 % warm valid, the rest warm train."""
    return (train_days.withColumn("split", _warm_label(F.col("upload_ds"), seed))
            .withColumn("wc_split", F.concat(F.lit("w_"), "split")))


def split_days(days: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """(`upload_ds`, `split`, `wc_split`) for every day: cold valid and test, warm rest."""
    cold = temporal_split(cumulative_ratio(days, cfg.total), cfg.train, cfg.valid)
    train = F.col("split") == "train"
    warm = _warm_label(F.col("upload_ds"), cfg.seed)
    return cold.select(
        "upload_ds", F.when(train, warm).otherwise(F.col("split")).alias("split"),
        F.when(train, F.concat(F.lit("w_"), warm)).otherwise(F.col("wc_split")).alias("wc_split"))


def item_splits(log: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """(`media_id`, `upload_ds`, `split`, `wc_split`, `_rows`) with the item's log rows.

    The per-item table is staged: the day totals, the assignment and the skew
    check of the later join all read it instead of the log.
    """
    seen = stage(log.where(F.col("media_id").isNotNull()).groupBy("media_id").agg(
        F.min("ds").alias("upload_ds"), F.count(F.lit(1)).alias("_rows")), "first-seen")
    # One row per calendar day, so this side cannot grow with the log.
    return seen.join(F.broadcast(split_days(items_per_day(seen), cfg)), "upload_ds")


def attach_split(log: DataFrame, assignment: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join the item assignment onto the log.

    With a `_rows` column in the assignment, rows of very popular items are
    spread over several tasks.
    """
    if "_rows" in assignment.columns:
        return hot_key_join(log, assignment, "media_id", "_rows", hot_rows).drop("_rows")
    return log.join(assignment, "media_id")


def assign_splits(log: DataFrame, cfg: SplitConfig = SplitConfig(),
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Log rows with `upload_ds`, `split` and `wc_split` of their item."""
    return attach_split(log, item_splits(log, cfg), hot_rows)
