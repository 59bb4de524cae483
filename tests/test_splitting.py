import datetime as dt

import pytest
from frames import rows
from pyspark.sql import functions as F

from mediarec.config import SplitConfig
from mediarec.operators import exports, splitting

D0 = dt.date(2024, 1, 1)


def days(spark, counts):
    return spark.createDataFrame([(D0 + dt.timedelta(i), c) for i, c in enumerate(counts)], "upload_ds date, count long")


def test_ratio_bounds_are_exact(spark):
    # Running ratios 0.89, 0.90, 0.95, 0.96, 1.0.
    got = splitting.temporal_split(splitting.cumulative_ratio(days(spark, [89, 1, 5, 1, 4]))).orderBy("upload_ds")
    assert [(r["split"], r["wc_split"]) for r in got.collect()] == [
        ("train", "c_train"), ("valid", "c_valid"), ("valid", "c_valid"), ("test", "c_test"), ("test", "c_test")]


def test_literal_total(spark):
    got = splitting.cumulative_ratio(days(spark, [10, 30]), total=80).orderBy("upload_ds").collect()
    assert [(r["total"], r["cumsum"], r["cum_ratio"]) for r in got] == [(80, 10, 0.125), (80, 40, 0.5)]


def test_warm_split_shares(spark):
    got = {r["wc_split"]: r["count"] for r in
           splitting.warm_split(days(spark, [1] * 6000)).groupBy("wc_split").count().collect()}
    assert got.keys() == {"w_train", "w_valid", "w_test"}
    assert abs(got["w_test"] / 6000 - 0.10) < 0.02 and abs(got["w_valid"] / 6000 - 0.09) < 0.02


def test_warm_split_depends_on_seed_only(spark):
    d = days(spark, [1] * 300)
    assert rows(splitting.warm_split(d, 1)) == rows(splitting.warm_split(d.repartition(5), 1))
    assert rows(splitting.warm_split(d, 1)) != rows(splitting.warm_split(d, 2))


@pytest.fixture(scope="module")
def log(spark):
    base = [(f"u{i % 13}", f"m{i % 200}", D0 + dt.timedelta((i % 200) // 2 + (i * 7) % 5), float(i)) for i in range(1000)]
    return spark.createDataFrame(base, "id_no string, media_id string, ds date, score double")


@pytest.mark.parametrize("hot_rows", [4_000_000, 2])
def test_assignment_covers_and_separates_items(log, hot_rows):
    out = splitting.assign_splits(log, SplitConfig(), hot_rows).cache()
    assert out.count() == log.count()
    assert out.groupBy("media_id").agg(F.countDistinct("wc_split").alias("n")).where("n > 1").count() == 0
    first = log.groupBy("media_id").agg(F.min("ds").alias("ds"))
    assert rows(out.select("media_id", "upload_ds").distinct()) == rows(first)
    assert not rows(out.where("wc_split = 'c_train'"))


@pytest.mark.parametrize("buckets", [1, 3, 64])
@pytest.mark.parametrize("cap", [1, 4, 100])
def test_cap(spark, cap, buckets):
    meta = spark.createDataFrame(
        [(f"m{i:03}", c) for i, c in enumerate(["NEWS"] * 40 + ["DRAMA"] * 3 + ["ETC"] * 30)],
        "media_id string, channel_category string")
    got = splitting.balance_by_category(meta, cap=cap, buckets=buckets)
    want = [f"m{i:03}" for i in range(min(cap, 40))] + [f"m{i:03}" for i in range(40, 40 + min(cap, 3))]
    assert rows(got, "media_id") == [(m,) for m in want]
    assert got.columns == meta.columns


def test_slices(spark):
    df = spark.createDataFrame(
        [("m1", "a", 0.5, "test", "c_test"), ("m2", "b", 0.6, "test", "w_test"), ("m3", "c", 0.7, "train", "w_train"),
         ("m4", "d", 0.8, "test", "c_test")], "media_id string, id_no string, score double, split string, wc_split string")
    meta = spark.createDataFrame([("m1", "NEWS"), ("m2", "ETC"), ("m3", "NEWS")], "media_id string, channel_category string")
    got = rows(exports.export_slices(df, meta), "slice", "media_id")
    assert got == sorted([
        ("test/total", "m1"), ("test/cold", "m1"), ("test/total_NEWS", "m1"), ("test/cold_NEWS", "m1"),
        ("test/total", "m2"), ("test/warm", "m2"), ("train/total", "m3"), ("train/warm", "m3"),
        ("test/total", "m4"), ("test/cold", "m4")], key=repr)
    assert exports.export_slices(df).count() == 8


def test_manifest(spark):
    df = spark.createDataFrame(
        [("m1", "a", "test", "c_test"), ("m2", "a", "test", "w_test"), ("m1", "b", "test", "c_test")],
        "media_id string, id_no string, split string, wc_split string")
    assert rows(exports.split_manifest(df)) == sorted([
        ("test", "all_item", "m1"), ("test", "all_item", "m2"), ("test", "cold_item", "m1"), ("test", "warm_item", "m2"),
        ("test", "all_user", "a"), ("test", "all_user", "b"), ("test", "cold_user", "a"), ("test", "cold_user", "b"),
        ("test", "warm_user", "a")], key=repr)


@pytest.mark.parametrize("hot_rows", [4_000_000, 5])
def test_histories_are_whole(spark, hot_rows):
    pairs = [("a", f"m{i}") for i in range(50)] * 2 + [("b", "m1")]
    df = spark.createDataFrame(pairs, "id_no string, media_id string")
    out = exports.user_histories(df, 10, hot_rows)
    flat = out.select("id_no", F.explode(F.arrays_zip("items", "views")).alias("p")).select("id_no", "p.items", "p.views")
    assert rows(flat) == sorted([("a", f"m{i}", 2) for i in range(50)] + [("b", "m1", 1)], key=repr)
    assert out.where("id_no = 'a'").count() > 2
    assert all(r["items"] == sorted(r["items"]) for r in out.collect())


def test_modalities(spark):
    inv = spark.createDataFrame([("1", "vision"), ("1", "audio"), ("2", "vision"), ("3", "audio"), ("3", "audio")],
                                "id string, modality string")
    df = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), ("4",)], "media_id string")
    assert rows(exports.require_modalities(df, inv, ["vision", "audio"])) == [("1",), ("1",)]


def test_histories_leave_out_null_items(spark):
    df = spark.createDataFrame([("u", "a"), ("u", None), (None, "a")], "id_no string, media_id string")
    assert [tuple(r) for r in exports.user_histories(df, 10).collect()] == [("u", 0, ["a"], [1])]
