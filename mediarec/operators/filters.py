"""Row filters of the viewing log and the static cleaning stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from mediarec.config import StaticConfig
from mediarec.operators.degrees import attach_degrees, degree_tables, pair_counts
from mediarec.operators.staging import stage
from mediarec.schemas import LOG_COLUMNS, require_columns


def project_log(df: DataFrame, cols: Iterable[str] = LOG_COLUMNS) -> DataFrame:
    """Keep the named log columns."""
    cols = list(cols)
    return require_columns(df, *cols).select(*cols)


def _not_fraud() -> Column:
    return F.col("fraud_level") == 0


def _not_live() -> Column:
    return ~F.col("live")


def _has_key(col: str) -> Column:
    return F.col(col).isNotNull() & (F.col(col) != "")


def drop_fraud(df: DataFrame) -> DataFrame:
    """Keep rows with fraud level 0; null is dropped."""
    return df.where(_not_fraud())


def drop_live(df: DataFrame) -> DataFrame:
    """Keep rows that are not live; null is dropped."""
    return df.where(_not_live())


def require_key(df: DataFrame, col: str = "id_no") -> DataFrame:
    """Drop null and empty keys; blanks are not trimmed."""
    return df.where(_has_key(col))


def score_column() -> Column:
    """Watched share; null for a zero duration, may exceed 1."""
    return F.try_divide(F.col("watch_time").cast("double"), F.col("duration").cast("double"))


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", score_column())


def watch_time_between(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Watch time within [lo, hi], both ends included."""
    return df.where(F.col("watch_time").between(lo, hi))


def min_score(df: DataFrame, bound: float) -> DataFrame:
    """Score present and at least `bound`."""
    return df.where(F.col("score") >= bound)


def where_category(df: DataFrame, *categories: str) -> DataFrame:
    return df.where(F.col("channel_category").isin(*categories))


def where_split(df: DataFrame, split: str, wc: str | None = None) -> DataFrame:
    """Rows of a split; `wc` is 'c' (cold) or 'w' (warm) to narrow it."""
    df = df.where(F.col("split") == split)
    return df if wc is None else df.where(F.col("wc_split") == f"{wc}_{split}")


def clean_log(log: DataFrame, cfg: StaticConfig = StaticConfig()) -> DataFrame:
    """Projection, all row predicates and the score, without the catalogue check."""
    df = require_key(drop_live(drop_fraud(project_log(log))), "id_no")
    df = watch_time_between(df, cfg.min_watch, cfg.max_watch)
    return min_score(with_score(df), cfg.min_score)


def common_items(log: DataFrame, meta: DataFrame) -> DataFrame:
    """Distinct item ids present in both log and catalogue."""
    return log.select("media_id").distinct().join(meta.select("media_id"), "media_id", "left_semi")


def keep_items(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Log rows whose item is in `ids`; repeated ids do not multiply rows."""
    return log.join(ids.select("media_id"), "media_id", "left_semi")


def cleaned_pairs(log: DataFrame, meta: DataFrame, cfg: StaticConfig = StaticConfig(), dates: bool = False) -> DataFrame:
    """Row counts (with `dates`, also first dates) per (user, item) of the cleaned log, catalogue items only.

    The catalogue check runs on the counted pairs, never on the log rows.
    """
    return keep_items(pair_counts(clean_log(log, cfg), dates), meta)


def static_filter(log: DataFrame, meta: DataFrame, cfg: StaticConfig = StaticConfig()) -> DataFrame:
    """Cleaned log rows of catalogue items with `itemCnt` per user and `userCnt` per item.

    The narrow (user, item, n) table is written once; both degree tables come
    from it and the wide rows are only read again for the final join.
    """
    pairs = stage(cleaned_pairs(log, meta, cfg), "clean-pairs")
    return attach_degrees(clean_log(log, cfg), *degree_tables(pairs))


def filter_funnel(log: DataFrame, meta: DataFrame, cfg: StaticConfig = StaticConfig()) -> DataFrame:
    """Rows and distinct items left after each cleaning predicate, in one pass.

    Every row gets the number of predicates it passes in order; rows are then
    summed per item, so the catalogue join and the distinct counts run on one
    row per item.
    """
    stages = ["raw", "not_fraud", "not_live", "user_present", "watch_time", "score", "in_catalogue"]
    tests = [
        _not_fraud(), _not_live(), _has_key("id_no"),
        F.col("watch_time").between(cfg.min_watch, cfg.max_watch),
        score_column() >= cfg.min_score,
    ]
    depth = F.lit(len(tests))
    for i in range(len(tests) - 1, -1, -1):
        depth = F.when(F.coalesce(tests[i], F.lit(False)), depth).otherwise(F.lit(i))
    per_item = project_log(log).select("media_id", depth.alias("depth")).groupBy("media_id").agg(
        *[F.count_if(F.col("depth") >= i).alias(f"r{i}") for i in range(len(tests) + 1)])
    known = meta.select("media_id").distinct().withColumn("known", F.lit(True))
    last = len(tests)
    per_item = per_item.join(known, "media_id", "left").withColumn(
        f"r{last + 1}", F.when(F.col("known"), F.col(f"r{last}")).otherwise(F.lit(0)))
    totals = per_item.agg(*[
        e for i in range(len(stages)) for e in (
            F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"rows{i}"),
            F.count_if((F.col(f"r{i}") > 0) & F.col("media_id").isNotNull()).alias(f"items{i}"))])
    lines = F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"),
                 F.col(f"rows{i}").alias("rows"), F.col(f"items{i}").alias("items"))
        for i, s in enumerate(stages)])
    return totals.select(F.inline(lines))
