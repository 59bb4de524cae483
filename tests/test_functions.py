import math
import random

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from mediarec.functions import signal, text, vectors
from mediarec.functions.labels import label_index
from mediarec.operators import features


def test_clean_text_agrees_with_python(spark):
    rng = random.Random(0)
    alphabet = list("ab한글é\\「」<> ") + list(text.PUNCTUATION) + [
        "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​"]
    docs = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "-"]
    want = [" ".join("".join(" " if c in text.PUNCTUATION else c for c in d).split()) for d in docs]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    got = [r["t"] for r in df.select("i", text.clean_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == want


def test_item_text(spark):
    df = spark.createDataFrame(
        [("t", [("a",), ("b",)]), (None, [("a",)]), ("t", []), ("t", None), ("t", [(None,), ("b",)])],
        "title string, e array<struct<surface:string>>")
    got = [r[0] for r in df.select(text.item_text(F.col("title"), F.col("e"))).collect()]
    assert got == ["t a, b", " a", "t ", "t ", "t b"]


def test_label_index(spark):
    df = spark.createDataFrame([("ARTIS",), ("SPORT",), ("ETC",), (None,)], "c string")
    assert [r[0] for r in df.select(label_index(F.col("c"))).collect()] == [1, 5, 0, 0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.l2_normalize(F.col("a")), vectors.cosine(F.col("a"), F.col("b")),
                    vectors.dot(F.col("a"), F.col("b")),
                    vectors.concat_modalities("av", {"v": "a", "a": "b"})).collect()
    assert got[0][0] == [0.6, 0.8] and got[1][0] == [0.0, 0.0]
    assert math.isclose(got[0][1], 0.96) and got[1][1] == 0.0
    assert got[0][2] == 24.0
    assert got[0][3] == [3.0, 4.0, 4.0, 3.0]


def frames(df):
    return sorted((r["id"], r["frame"], r["samples"]) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 9, 10, 23, 30, 41])
def test_frames(spark, n):
    x = [float(i + 1) for i in range(n)]
    padded = (x + [0.0] * 30)[:30]
    want = [("c", i, padded[i * 10:i * 10 + 10]) for i in range(3)]
    mono = spark.createDataFrame([("c", x)], "id string, x array<double>")
    assert frames(signal.frame_sequence(mono, "id", ["x"], 3, 10)) == want
    stereo = spark.createDataFrame([("c", [v - 1 for v in x], [v + 1 for v in x])], "id string, l array<double>, r array<double>")
    assert frames(signal.frame_sequence(stereo, "id", ["l", "r"], 3, 10)) == want
    if n:
        tall = mono.select("id", F.posexplode("x").alias("pos", "s"))
        assert frames(signal.frame_rows(tall, "id", "pos", "s", 3, 10)) == want


def test_frame_count_per_clip(spark):
    df = spark.createDataFrame([("a", [1.0] * 5, 1), ("b", [1.0] * 5, 2)], "id string, x array<double>, hop int")
    assert [(i, f) for i, f, _ in frames(signal.frame_sequence(df, "id", ["x"], F.col("hop"), 4))] == [
        ("a", 0), ("b", 0), ("b", 1)]


@pytest.mark.parametrize("hot_rows", [4_000_000, 3])
def test_power(spark, hot_rows):
    data = {"a": [1.0, -2.0, 3.0, 0.5], "b": [0.0, 0.0]}
    tall = spark.createDataFrame([(k, v) for k, x in data.items() for v in x], "id string, x double")
    got = {r["id"]: r["power"] for r in signal.signal_power(tall, "id", "x").collect()}
    assert math.isclose(got["a"], np.mean(np.square(data["a"]))) and got["b"] == 0
    out = rows(signal.power_normalize(tall, "id", "x", 2.0, hot_rows).where("id = 'a'"), "x")
    assert math.isclose(np.mean(np.square([r[0] for r in out])), 2.0)
    assert rows(signal.power_normalize(tall, "id", "x").where("id = 'b'"), "x") == [(None,), (None,)]
    wide = spark.createDataFrame([(data["a"],)], "x array<double>")
    arr = wide.select(signal.scale_power(F.col("x")), signal.mean_square(F.col("x"))).first()
    assert math.isclose(np.mean(np.square(arr[0])), 1.0) and math.isclose(arr[1], got["a"])


def test_pooling(spark):
    seq = [("a", i, [float(i), 1.0]) for i in range(25)] + [("b", 0, [7.0, 8.0])]
    df = spark.createDataFrame(seq, "id string, pos int, vec array<float>").repartition(5)
    got = {(r["id"], r["segment"]): r["vec"] for r in features.pool_segments(df, "id", "pos", "vec").collect()}
    assert got == {("a", 0): [4.5, 1.0], ("a", 1): [14.5, 1.0], ("a", 2): [22.0, 1.0], ("b", 0): [7.0, 8.0]}
    assert {r["id"]: r["vec"] for r in features.pool_mean(df, "id", "vec").collect()} == {"a": [12.0, 1.0], "b": [7.0, 8.0]}


def test_feature_joins(spark):
    feats = spark.createDataFrame(
        [("1", "vision", [1.0]), ("1", "audio", [2.0]), ("2", "vision", [3.0]), ("3", "vision", [4.0]), ("3", "audio", [5.0])],
        "item_id string, modality string, vec array<float>")
    factors = spark.createDataFrame([("1", [9.0]), ("2", [8.0])], "id string, vec array<float>")
    ids = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), ("4",)], "id string")
    data, counts = features.assemble_modalities(feats, factors, ids, ["vision", "audio"])
    assert rows(data, "item_id", "vision", "audio", "cf") == [("1", [1.0], [2.0], [9.0])]
    assert tuple(counts.first()) == (4, 1, 3)
    found, counts = features.lookup_vectors(ids, factors)
    assert rows(found, "id") == [("1",), ("2",)] and tuple(counts.first()) == (2, 2)
    kept, counts = features.select_targets(feats, spark.createDataFrame([("1",), ("1",)], "item_id string"))
    assert kept.count() == 2 and tuple(counts.first()) == (2, 3)
    done = spark.createDataFrame([("2",), ("9",)], "id string")
    assert rows(features.pending_items(ids, done)) == [("1",), ("3",), ("4",)]


def test_frame_rows_keep_positions(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 5, 2.0), (1, 9, 3.0), (1, -1, 9.0), (2, 20, 4.0)], "id int, pos int, x double")
    got = {(r["id"], r["frame"]): r["samples"] for r in signal.frame_rows(df, "id", "pos", "x", 2, 8).collect()}
    assert got[1, 0] == [1.0, 0, 0, 0, 0, 2.0, 0, 0] and got[1, 1] == [0, 3.0, 0, 0, 0, 0, 0, 0]
    assert got[2, 0] == got[2, 1] == [0.0] * 8
    twice = df.unionByName(df.where("pos = 5"))
    with pytest.raises(Exception, match="given twice"):
        signal.frame_rows(twice, "id", "pos", "x", 2, 8).collect()


def test_assembly_moves_vectors_once(spark):
    feats = spark.createDataFrame([("a", "v", [1.0]), ("a", "w", [2.0]), ("b", "v", [3.0])], "item_id string, modality string, vec array<double>")
    factors = spark.createDataFrame([("a", [0.0]), ("b", [0.0])], "id string, vec array<double>")
    ids = factors.select("id")
    rows_, counts = features.assemble_modalities(feats, factors, ids, ["v", "w"])
    plan = rows_._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert [tuple(r) for r in rows_.collect()] == [("a", [1.0], [2.0], [0.0])] and tuple(counts.first()) == (2, 1, 1)
    again = feats.unionByName(feats.where("item_id = 'a' and modality = 'v'"))
    with pytest.raises(Exception, match="two vectors of v"):
        features.assemble_modalities(again, factors, ids, ["v", "w"])[0].collect()
