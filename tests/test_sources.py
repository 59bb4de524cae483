import bz2
import datetime as dt
import json
import os

import pytest
from frames import rows
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from mediarec.config import AlsConfig
from mediarec.operators.factorization import fit_als
from mediarec.operators.staging import stage, stage_root
from mediarec.sources import readers, sinks
from mediarec.sources.listing import file_inventory


def test_log_is_conformed(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), 5, "a", "kr", 1, "f", 0, "m", False, 9, "2024-02-03", 1),
         (dt.datetime(2024, 1, 1), 5, "a", "kr", 1, "f", 0, "m", False, 9, "not a date", 1)],
        "log_time timestamp, watch_time int, id_no string, id_country string, age int, gender string, "
        "fraud_level int, media_id string, live boolean, duration int, ds string, extra int").write.parquet(path)
    df = readers.read_log(spark, path)
    assert "extra" not in df.columns
    assert rows(df, "ds") == sorted([(dt.date(2024, 2, 3),), (None,)], key=repr)
    assert dict(df.dtypes)["watch_time"] == "bigint"


def test_counts_and_id_map(spark, tmp_path):
    (tmp_path / "c.tsv.bz2").write_bytes(bz2.compress(b"user_id\ttrack_id\tcount\n1\tab\t3\n2\tcd\t4\n"))
    assert rows(readers.read_counts(spark, str(tmp_path / "c.tsv.bz2"))) == [(1, "ab", 3), (2, "cd", 4)]
    (tmp_path / "map.json").write_text(json.dumps({"ab": 0, "cd": 7}, indent=1))
    assert rows(readers.read_id_map(spark, str(tmp_path / "map.json"))) == [("ab", 0), ("cd", 7)]


def test_wide_features(spark, tmp_path):
    head = "id\t" + "\t".join(f"f{i}" for i in range(300))
    body = "\n".join(f"x{r}\t" + "\t".join(str(r + i / 4) for i in range(300)) for r in range(3))
    (tmp_path / "w.tsv.bz2").write_bytes(bz2.compress(f"{head}\n{body}\na,b\t1,5\t2\n".encode()))
    out = {r["item_id"]: r for r in readers.read_wide_features(spark, str(tmp_path / "w.tsv.bz2"), "vision").where(
        "item_id like 'x%'").collect()}
    assert set(out) == {"x0", "x1", "x2"} and out["x1"]["modality"] == "vision"
    assert out["x2"]["vec"] == [2 + i / 4 for i in range(300)]


def test_comma_inside_a_wide_line_is_kept(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("id\tf\na,b\t1.5\n")
    assert rows(readers.read_wide_features(spark, str(tmp_path / "w.tsv"), "tags"), "item_id", "vec") == [("a,b", [1.5])]


def test_empty_wide_file(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("")
    assert readers.read_wide_features(spark, str(tmp_path / "w.tsv"), "tags").count() == 0


def test_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text(",min,title\na,3.5,x\nb,oops,y\n")
    assert rows(readers.read_catalog(spark, str(tmp_path / "c.csv"))) == sorted(
        [("a", 3.5, "x"), ("b", None, "y")], key=repr)


def test_slices_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("test/total", "m1", "a", 0.5), ("test/cold", "m2", "b", 0.25)],
                               "slice string, media_id string, id_no string, score double")
    path = str(tmp_path / "slices")
    sinks.write_slices(df, path)
    one = readers.read_slice(spark, path, "test/cold")
    assert rows(one) == [("m2", "b", 0.25)]
    (tmp_path / "one.json").write_text(json.dumps([{"media_id": "m", "id_no": "u", "score": 1.0}]))
    assert rows(readers.read_slice(spark, str(tmp_path / "one.json"))) == [("m", "u", 1.0)]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"train_track": ["a", "b"], "valid_track": ["c"], "test_track": []}, indent=2))
    path = str(tmp_path / "m.json")
    assert rows(readers.read_split_ids(spark, path, "TRAIN")) == [("a",), ("b",)]
    assert rows(readers.read_split_ids(spark, path, "TEST")) == []
    with pytest.raises(ValueError, match="DEV"):
        readers.read_split_ids(spark, path, "DEV")
    tall = spark.createDataFrame([("test", "all_item", "m1"), ("test", "all_user", "u1")], "split string, id_set string, id string")
    sinks.write_manifest(tall, str(tmp_path / "tall"))
    assert rows(readers.read_manifest(spark, str(tmp_path / "tall"), "test", "all_user")) == [("u1",)]


@pytest.fixture
def tiny_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "16k")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ODD = ['plain', 'a,b', '}],{', 'quote " and \\\\ and \\"', 'é漢字😀', '[{"x":1}]', '', ' ', 'line\nbreak', '"' * 300 + ',']


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_large_json_values_are_read_in_parts(spark, tmp_path, tiny_splits, layout):
    """Arrays, dictionaries and manifests, cut anywhere: separators, brackets and quotes inside strings, texts longer than a split."""
    ids = [f"{ODD[i % len(ODD)]}#{i}" for i in range(900)] + [',' * 40_000, '"' * 20_000, "last"]
    for name, value in {"array": [{"media_id": x, "id_no": f"u{i}", "score": i / 2} for i, x in enumerate(ids)], "map": {x: i for i, x in enumerate(ids)},
                        "lists": {"train_track": ids[:400], "other": ["no", "none"], "valid_track": [], "test_track": ids[400:]}}.items():
        (tmp_path / name).mkdir()
        for part in ("1.json", "2.json"):
            (tmp_path / name / part).write_text(json.dumps(value, **layout), encoding="utf-8")
    path = {n: str(tmp_path / n) for n in ("array", "map", "lists")}
    from mediarec.sources.json_elements import elements
    assert elements(spark, path["array"]).select("start").distinct().count() > 5
    assert rows(readers.read_slice(spark, path["array"])) == sorted([(x, f"u{i}", i / 2) for i, x in enumerate(ids)] * 2, key=repr)
    assert rows(readers.read_id_map(spark, path["map"])) == sorted([(x, i) for i, x in enumerate(ids)] * 2, key=repr)
    for split, want in (("TRAIN", ids[:400]), ("VALID", []), ("TEST", ids[400:])):
        assert rows(readers.read_split_ids(spark, path["lists"], split)) == sorted([(x,) for x in want] * 2, key=repr)


def test_small_json_values(spark, tmp_path):
    for text, want in (("[]", []), (" [ ] \n", []), ('[{"media_id":"a"}]', [("a", None, None)]), ('[{"media_id":"a"},\n{"score":1,"id_no":"b,c"}]', [("a", None, None), (None, "b,c", 1.0)])):
        (tmp_path / "a.json").write_text(text)
        assert rows(readers.read_slice(spark, str(tmp_path / "a.json"))) == sorted(want, key=repr)
    (tmp_path / "m.json").write_text("{}")
    assert readers.read_id_map(spark, str(tmp_path / "m.json")).count() == 0


def test_vectors_and_factors_round_trip(spark, tmp_path):
    feats = spark.createDataFrame([("1", "vision", [1.5]), ("1", "audio", [2.5])], "item_id string, modality string, vec array<float>")
    sinks.write_vectors(feats, str(tmp_path / "v"))
    assert rows(readers.read_vectors(spark, str(tmp_path / "v"))) == rows(feats)
    assert rows(readers.read_vectors(spark, str(tmp_path / "v"), "audio"), "vec") == [([2.5],)]
    factors = spark.createDataFrame([("1", [1.5, 2.0])], "id string, vec array<float>")
    sinks.write_factors(factors, str(tmp_path / "f"))
    assert rows(readers.read_factors(spark, str(tmp_path / "f"))) == rows(factors)


def test_als_results_and_stage(spark, tmp_path):
    df = spark.createDataFrame([(u, i, float(u + i)) for u in range(4) for i in range(4)], "userId int, mediaId int, score double")
    model = fit_als(df, AlsConfig(rank=2, max_iter=1, blocks=2))
    sinks.save_als(model, str(tmp_path / "als"))
    assert sinks.load_als(str(tmp_path / "als")).itemFactors.count() == 4
    sinks.write_results(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 16
    sinks.write_stage(df, str(tmp_path / "s"), compression="none")
    assert rows(spark.read.parquet(str(tmp_path / "s"))) == rows(df)
    with pytest.raises(Exception):
        sinks.write_stage(df, str(tmp_path / "s"))


def test_file_inventory(spark, tmp_path):
    for n in ("a.npy", "b.c.npy", "d.txt", "npy"):
        (tmp_path / n).write_bytes(b"x")
    df = file_inventory(spark, str(tmp_path), ".npy")
    assert rows(df) == [("a", f"file:{tmp_path}/a.npy"), ("b.c", f"file:{tmp_path}/b.c.npy")]
    with pytest.raises(Exception, match="FileNotFound"):
        file_inventory(spark, str(tmp_path / "gone"), ".npy").collect()


def test_file_inventory_of_a_tree(spark, tmp_path):
    root, driver = tmp_path / "a b%20c", os.getpid()
    names = [f"k={k}/deep {k % 3}/é%{k}#{k}.npy" for k in range(40)] + ["x.npy/y.npy", "k=0/z.npy"]
    for n in [*names, "_temporary/h.npy", ".h.npy", "k=1/_h.npy", "k=1/other.txt"]:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x")
    (root / "empty").mkdir()

    def open_in_task(uri):
        assert os.getpid() != driver
        return FileSystem.from_uri(uri)
    df = file_inventory(spark, str(root), ".npy", open_in_task)
    assert rows(df, "path") == sorted(((f"file:{root}/{n}",) for n in names), key=repr)
    # What Spark's own listing, which passes through the driver, finds.
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy")
    assert rows(df, "path") == rows(whole.load(str(root)), "path")
    assert file_inventory(spark, str(root / "empty"), ".npy").count() == 0
    assert rows(file_inventory(spark, str(root / "x.npy"), "")) == [("y.npy", f"file:{root}/x.npy/y.npy")]


def test_staged_tables(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    out = stage(df, "test")
    assert rows(out) == rows(df) and out.schema.fieldNames() == ["id", "x"]
    assert stage(df.limit(0), "test").count() == 0
    assert stage_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or stage_root(spark))
