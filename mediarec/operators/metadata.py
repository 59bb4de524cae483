"""Item, user and category summaries of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def view_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per value of `key`."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def item_meta(log: DataFrame, meta: DataFrame) -> DataFrame:
    """Catalogue rows of viewed items with their views and mean watch time.

    The log is aggregated before the join, so a popular item meets the
    catalogue as one row.
    """
    stats = log.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("count"), F.avg("watch_time").alias("avg_watch_time"))
    return meta.join(stats, "media_id")


def user_meta(log: DataFrame) -> DataFrame:
    """Views, first and last date, mean watch time, age, gender and active days per user."""
    return (
        log.where(F.col("id_no").isNotNull()).groupBy("id_no").agg(
            F.count(F.lit(1)).alias("count"),
            F.max("ds").alias("last_ds"),
            F.min("ds").alias("start_ds"),
            F.avg("watch_time").alias("avg_watch_time"),
            F.max("age").alias("age"),
            F.max("gender").alias("gender"))
        .withColumn("dateDiff", F.datediff("last_ds", "start_ds"))
    )


def summary(df: DataFrame) -> DataFrame:
    """Rows, distinct items and distinct users, as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("media_id").alias("items"),
        F.countDistinct("id_no").alias("users"))


def category_summary(meta: DataFrame) -> DataFrame:
    """Items per category, largest first."""
    return view_counts(meta, "channel_category").orderBy(F.desc("count"), "channel_category")


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()
