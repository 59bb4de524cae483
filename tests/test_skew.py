"""Plans with a third of the rows on one key."""

import pytest
from pyspark.sql import functions as F

from mediarec.operators import exports, filters, splitting
from mediarec.plans import prepare

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def log(spark):
    n = F.col("id")
    return spark.range(0, 120_000, 1, 8).select(
        F.concat(F.lit("u"), n % 5000).alias("id_no"),
        F.when(n % 3 == 0, F.lit("m0")).otherwise(F.concat(F.lit("m"), n % 3001)).alias("media_id"),
        F.xxhash64(n).cast("string").alias("log_time"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")).alias("ds"),
        F.lit(0.5).alias("score"), F.lit("test").alias("split"), F.lit("w_test").alias("wc_split"))


def items(spark):
    return spark.range(3001).select(
        F.concat(F.lit("m"), "id").alias("media_id"), F.lit("NEWS").alias("channel_category"))


def biggest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def plan_after_run(df, capsys):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_item_check_is_split(spark, log, small_limits, capsys):
    out = filters.keep_items(log, items(spark))
    assert "skew=true" in plan_after_run(out, capsys)
    assert out.count() == log.count()


def test_slices_are_split(spark, log, small_limits, capsys):
    assert "skew=true" in plan_after_run(exports.export_slices(log, items(spark)), capsys)


def test_split_join_is_salted(log, small_limits):
    out = splitting.assign_splits(log.drop("split", "wc_split"), hot_rows=4000)
    assert out.count() == log.count()
    assert biggest_share(out) < 0.25


def test_modality_check_of_a_log_is_salted(spark, log, small_limits):
    files = items(spark).select(F.col("media_id").alias("id"), F.lit("audio").alias("modality"))
    out = exports.require_modalities(log, files.where("id <> 'm7'"), ["audio"], hot_rows=4000)
    assert out.columns == log.columns and out.count() == log.where("media_id <> 'm7'").count()
    assert biggest_share(out) < 0.25


def test_the_wide_join_of_the_data_stage_is_salted(spark, log, small_limits):
    """Rows meet the item table once; splits, categories and files ride on it."""
    raw = log.drop("split", "wc_split", "score").withColumns({
        "id_country": F.lit("0"), "age": F.lit(1), "gender": F.lit("x"), "fraud_level": F.lit(0), "live": F.lit(False),
        "watch_time": F.lit(60_000).cast("long"), "duration": F.lit(100_000).cast("long")})
    users = raw.groupBy("id_no").agg(F.count(F.lit(1)).alias("itemCnt"))
    table = raw.groupBy("media_id").agg(F.count(F.lit(1)).alias("userCnt")).withColumn("split", F.lit("test"))
    out = prepare.item_log(raw, users, table, hot_rows=4000)
    assert out.count() == raw.count() and "split" in out.columns
    assert biggest_share(out) < 0.25
