import datetime as dt

import pytest
from frames import rows
from pyspark.sql import functions as F

from mediarec.operators import filters
from mediarec.schemas import LOG

DAY = dt.date(2024, 1, 1)


def log(spark, *entries):
    """Entries of (user, item, watch, duration, fraud, live)."""
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), w, u, "kr", 30, "f", f, i, lv, d, DAY) for u, i, w, d, f, lv in entries], LOG)


def meta(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "media_id string")


def test_boundaries(spark):
    df = log(spark,
             ("a", "1", 30_000, 100_000, 0, False),      # score exactly 0.3, lowest watch time
             ("b", "1", 29_999, 30_000, 0, False),       # too short
             ("c", "1", 7_200_000, 7_200_000, 0, False), # highest watch time
             ("d", "1", 7_200_001, 7_200_001, 0, False),
             ("e", "1", 29_999 + 1, 100_001, 0, False),  # score just below
             ("f", "1", 60_000, 0, 0, False),            # zero duration
             ("g", "1", 60_000, 30_000, 0, False),       # score above one
             (None, "1", 60_000, 60_000, 0, False),
             ("", "1", 60_000, 60_000, 0, False),
             (" ", "1", 60_000, 60_000, 0, False),       # blanks are not trimmed
             ("h", "1", 60_000, 60_000, 1, False),
             ("i", "1", 60_000, 60_000, None, False),
             ("j", "1", 60_000, 60_000, 0, True),
             ("k", "1", 60_000, 60_000, 0, None))
    assert rows(filters.clean_log(df), "id_no") == [(" ",), ("a",), ("c",), ("g",)]


def test_score_of_zero_duration_is_null(spark):
    df = filters.with_score(log(spark, ("a", "1", 60_000, 0, 0, False), ("b", "1", 60_000, 30_000, 0, False)))
    assert rows(df, "score") == [(2.0,), (None,)]


def test_repeated_catalogue_ids_do_not_multiply_rows(spark):
    df = log(spark, ("a", "1", 60_000, 60_000, 0, False), ("a", "2", 60_000, 60_000, 0, False))
    ids = meta(spark, "1", "1", "3")
    assert rows(filters.keep_items(df, ids), "media_id") == [("1",)]
    assert rows(filters.common_items(df, ids)) == [("1",)]
    assert rows(filters.static_filter(df, ids), "media_id", "itemCnt", "userCnt") == [("1", 1, 1)]


def test_funnel_agrees_with_the_filters(spark):
    df = log(spark, ("a", "1", 60_000, 60_000, 0, False), ("a", "2", 60_000, 60_000, 0, False),
             ("b", "2", 1, 60_000, 0, False), (None, "3", 60_000, 60_000, 0, False),
             ("b", "4", 60_000, 0, 0, False), ("b", "4", 60_000, 60_000, 2, False))
    got = {r["stage"]: (r["rows"], r["items"]) for r in filters.filter_funnel(df, meta(spark, "1", "3")).collect()}
    assert got == {"raw": (6, 4), "not_fraud": (5, 4), "not_live": (5, 4), "user_present": (4, 3),
                   "watch_time": (3, 3), "score": (2, 2), "in_catalogue": (1, 1)}


def test_funnel_of_empty_log(spark):
    got = filters.filter_funnel(log(spark, ("a", "1", 1, 1, 0, False)).limit(0), meta(spark, "1")).collect()
    assert [tuple(r)[2:] for r in got] == [(0, 0)] * 7


def test_missing_column_is_reported(spark):
    with pytest.raises(ValueError, match="fraud_level"):
        filters.project_log(log(spark, ("a", "1", 1, 1, 0, False)).drop("fraud_level"))


def test_where_split(spark):
    df = spark.createDataFrame([("test", "w_test"), ("test", "c_test"), ("train", "w_train")], "split string, wc_split string")
    assert filters.where_split(df, "test").count() == 2
    assert rows(filters.where_split(df, "test", "c"), "wc_split") == [("c_test",)]
    assert filters.where_split(df, "train", "c").count() == 0


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    log(spark, ("a", "1", 60_000, 60_000, 0, False)).write.parquet(path)
    df = filters.clean_log(spark.read.parquet(path)).select("id_no", F.col("score"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df.explain("formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("EqualTo(fraud_level,0)", "Not(EqualTo(live,true))", "GreaterThanOrEqual(watch_time,30000)",
                 "LessThanOrEqual(watch_time,7200000)", "IsNotNull(id_no)"):
        assert part in pushed
    assert "id_country" not in plan[plan.index("ReadSchema"):]
