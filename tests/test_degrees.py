import random
from collections import Counter

import pytest
from frames import rows
from pyspark.sql import functions as F

from mediarec.operators import degrees
from mediarec.operators.skew import hot_key_join
from mediarec.operators.staging import stage


def skewed_log(n=3000, seed=1):
    """A third of the rows on one item, many exact copies of one row."""
    rng = random.Random(seed)
    out = [(f"u{rng.randrange(120)}", f"m{int(rng.paretovariate(0.7)) % 150}") for _ in range(n)]
    out += [(f"u{rng.randrange(120)}", "m1") for _ in range(n // 2)]
    return out + [("u7", "m1")] * 400


def prune(log, a, b, rounds):
    """Brute force: both counts from the same snapshot; returns rows with counts."""
    done = 0
    while True:
        users, items = Counter(u for u, _ in log), Counter(i for _, i in log)
        kept = [r for r in log if users[r[0]] >= a and items[r[1]] >= b]
        done += 1
        if done == rounds or (rounds is None and len(kept) == len(log)):
            return sorted((u, i, users[u], items[i]) for u, i in kept)
        log = kept


COLS = ("id_no", "media_id", "itemCnt", "userCnt")


@pytest.fixture(scope="module")
def log(spark):
    return stage(spark.createDataFrame(skewed_log(), "id_no string, media_id string").repartition(6), "test-log")


@pytest.mark.parametrize("hot_rows", [4_000_000, 50])
def test_with_degree(log, hot_rows):
    got = sorted(tuple(r) for r in degrees.with_degree(log, hot_rows).select(*COLS).collect())
    assert got == prune(skewed_log(), 0, 0, 1)


@pytest.mark.parametrize("rounds", [1, 2, 5, None])
@pytest.mark.parametrize("bounds", [(30, 12)])
def test_core_filter(log, bounds, rounds):
    got = degrees.core_filter(log, *bounds, rounds, hot_rows=100)
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == prune(skewed_log(), *bounds, rounds)


@pytest.mark.parametrize("share, keys", [(0.0, 0), (0.3, 500_000), (9.0, 500_000)])
def test_core_filter_ways_of_dropping(log, monkeypatch, share, keys):
    """Counts taken down or pairs rewritten, by broadcast or by shuffle: same result."""
    monkeypatch.setattr(degrees, "REWRITE_SHARE", share)
    monkeypatch.setattr(degrees, "BROADCAST_KEYS", keys)
    got = degrees.core_filter(log, 30, 12, None)
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == prune(skewed_log(), 30, 12, None)


def test_late_rounds_read_only_the_pairs_of_failed_keys(log, monkeypatch):
    """Rows read by a late round are those of the keys that just failed, from the folders that hold them."""
    read, plans = [], []
    touching = degrees._touching

    def watched(folders, state, done):
        out = touching(folders, state, done)
        keys = {(r["side"], r["key"]) for r in state.where(F.col("failed") == done).select("side", "key").collect()}
        got = out.select("id_no", "media_id").collect()
        assert all((0, r["id_no"]) in keys or (1, r["media_id"]) in keys for r in got) and len(set(got)) == len(got)
        read.append((len(got), folders.pairs.count()))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(degrees, "_touching", watched)
    monkeypatch.setattr(degrees, "FOLDER_ROWS", 100)
    monkeypatch.setattr(degrees, "REWRITE_SHARE", 2.0)
    got = degrees.core_filter(log, 30, 12, None)
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == prune(skewed_log(), 30, 12, None)
    assert len(read) >= 2 and all(n < 0.8 * total for n, total in read[1:]) and read[-1][0] < read[0][0]
    assert all("PartitionFilters: [" in p and "folder" in p for p in plans)


def test_fixpoint_is_stable(log):
    once = degrees.core_filter(log, 30, 12, None)
    assert once.where((F.col("itemCnt") < 30) | (F.col("userCnt") < 12)).count() == 0
    again = degrees.core_filter(once, 30, 12, None)
    assert rows(again, *COLS) == rows(once, *COLS)


def test_pruning_to_nothing(log):
    assert degrees.core_filter(log, 10_000, 10_000, None).count() == 0
    assert degrees.core_filter(log.limit(0), 1, 1, 5).count() == 0


def test_rounds_must_be_positive(log):
    with pytest.raises(ValueError):
        degrees.core_filter(log, 1, 1, 0)


def test_null_keys_are_left_out(spark):
    df = spark.createDataFrame([("a", "1"), (None, "1"), ("a", None)], "id_no string, media_id string")
    assert rows(degrees.with_degree(df), *COLS) == [("a", "1", 1, 1)]


def test_hot_key_join_spreads_copies(spark, log):
    counts = log.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    plain = rows(log.join(counts, "media_id"), "id_no", "media_id", "n")
    assert rows(hot_key_join(log, counts, "media_id", "n", 40), "id_no", "media_id", "n") == plain
    copies = spark.createDataFrame([("u", "m")] * 800, "id_no string, media_id string").repartition(8)
    counts = copies.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = hot_key_join(copies, counts, "media_id", "n", 50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 800 and max(sizes) < 800
