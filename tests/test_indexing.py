import re
from pathlib import Path

import numpy as np
import pytest
from frames import rows
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from mediarec import queries
from mediarec.config import AlsConfig
from mediarec.operators import factorization, half_steps, indexing
from mediarec.operators.staging import stage, stage_root
from mediarec.plans.factorize import factorize, factorize_counts, factorize_splits


@pytest.mark.parametrize("parts", [1, 7])
def test_index_is_dense_and_sorted(spark, parts):
    ids = [f"u{i * 37 % 1000:04}" for i in range(1000)] * 2
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id string").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = indexing.build_index(df, "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r["idx"], r["id"], r["n"]) for r in out.collect())
    assert got == [(i, u, 2) for i, u in enumerate(sorted(set(ids)))]


def test_empty_index(spark):
    assert indexing.build_index(spark.createDataFrame([], "id string"), "id").count() == 0


def test_encode(spark):
    index = spark.createDataFrame([("x", 0), ("y", 1)], "id string, idx int")
    df = spark.createDataFrame([("a", "x", 1), ("a", "z", 2), ("b", "y", 3)], "u string, t string, n int")
    assert rows(indexing.encode_ids(df, index, "t")) == sorted([("a", 0, 1), ("a", None, 2), ("b", 1, 3)], key=repr)
    assert rows(indexing.encode_ids(df, index, "t", "inner")) == [("a", 0, 1), ("b", 1, 3)]
    with pytest.raises(ValueError):
        indexing.encode_ids(df, index, "t", "outer")


@pytest.fixture(scope="module")
def log(spark):
    entries = [(f"u{i % 17}", f"m{(i * i) % 23}", f"2024-01-{1 + i % 3:02}", 0.5 + i % 4,
                ("train", "valid", "test")[(i * i) % 23 % 3]) for i in range(600)]
    return spark.createDataFrame(entries, "id_no string, media_id string, ds string, score double, split string")


@pytest.mark.parametrize("hot_rows", [4_000_000, 5])
def test_index_interactions(log, hot_rows):
    users, items = indexing.build_index(log, "id_no"), indexing.build_index(log, "media_id")
    out = indexing.index_interactions(log, users, items.where("idx < 5"), hot_rows)
    keep = sorted(r["media_id"] for r in log.select("media_id").distinct().collect())[:5]
    assert out.count() == log.where(F.col("media_id").isin(keep)).count()
    assert out.select("media_id", "mediaId").distinct().count() == 5


def test_scores(log):
    per_day = factorization.daily_scores(log, "train")
    assert per_day.columns == ["id_no", "media_id", "ds", "score"]
    whole = factorization.daily_scores(log, "train", per_day=False)
    total = log.where("split = 'train'").agg(F.sum("score")).first()[0]
    for df in (per_day, whole):
        assert abs(df.agg(F.sum("score")).first()[0] - total) < 1e-9
    assert whole.count() < per_day.count()


def test_factors_cover_the_ids(log):
    cfg = AlsConfig.implicit_feedback(rank=6, max_iter=3, blocks=2)
    out = factorize(log, cfg)
    assert rows(out.users, "id") == rows(log.select("id_no").distinct())
    assert {len(r["vec"]) for r in out.items.collect()} == {6}
    again = factorize(log, cfg)
    for a, b in zip(sorted(out.items.collect()), sorted(again.items.collect())):
        assert a["id"] == b["id"] and max(abs(x - y) for x, y in zip(a["vec"], b["vec"])) < 1e-4


def test_one_model_per_split(log):
    out = factorize_splits(log, AlsConfig.implicit_feedback(rank=3, max_iter=1, blocks=2))
    for split, model in out.items():
        assert rows(model.items, "id") == rows(log.where(F.col("split") == split).select("media_id").distinct())


def test_explicit_counts(spark):
    counts = spark.createDataFrame([(u, f"t{i}", 1 + (u * i) % 5) for u in range(12) for i in range(9)],
                                   "user_id long, track_id string, count long")
    index = spark.createDataFrame([(f"t{i}", i) for i in range(7)], "id string, idx int")
    more = counts.unionByName(spark.createDataFrame([(None, "t1", 2), (3, "t2", None), (None, None, None)], counts.schema))
    cfg = AlsConfig.explicit_feedback(rank=4, max_iter=8, blocks=2)
    model, ratings, seen = factorize_counts(more, index, cfg)
    assert seen.asDict() == {"read": 111, "no_user": 2, "no_item": 25, "no_rating": 2, "used": 84} and ratings.count() == 84
    exact = factorization.normal_residual(model, ratings, cfg, "user", "user_id", "track_id", "count").collect()
    assert len(exact) == 12 and all(r["n"] == 7 and r["residual"] < 1e-5 for r in exact)
    assert model.itemFactors.count() == 7 and model.rank == 4
    pred = model.transform(indexing.encode_ids(counts, index, "track_id", "inner"))
    err = pred.agg(F.avg(F.abs(F.col("prediction") - F.col("count")))).first()[0]
    assert err < 0.3


def test_residual_by_hand(log):
    """Against the normal equations written out with dense matrices, for the side that is exact and the one that isn't."""
    cfg = AlsConfig.implicit_feedback(rank=5, max_iter=2, blocks=2)
    out = factorize(log, cfg)
    ratings = [(r.userId, r.mediaId, r.score) for r in out.ratings.collect()]
    for side, own, far, at in (("user", out.model.userFactors, out.model.itemFactors, 0), ("item", out.model.itemFactors, out.model.userFactors, 1)):
        x, y = ({r["id"]: np.array(r["features"]) for r in t.collect()} for t in (own, far))
        gram = sum(np.outer(v, v) for v in y.values())
        got = {r["id"]: r for r in factorization.normal_residual(out.model, out.ratings, cfg, side).collect()}
        assert got.keys() == x.keys()
        for i, v in x.items():
            mine = [(r[1 - at], np.float32(r[2])) for r in ratings if r[at] == i]
            a = gram + sum(abs(s) * np.outer(y[j], y[j]) for j, s in mine) + cfg.reg * sum(s > 0 for _, s in mine) * np.eye(5)
            b = sum((1 + abs(s)) * y[j] for j, s in mine if s > 0)
            assert got[i]["n"] == len(mine)
            assert got[i]["residual"] == pytest.approx(np.linalg.norm(a @ v - b) / np.linalg.norm(b), rel=1e-4, abs=1e-7)
            assert side == "item" or got[i]["residual"] < 1e-4


@pytest.mark.parametrize("implicit", [True, False])
@pytest.mark.parametrize("least", [20_000, 100])
def test_same_factors_as_mllib(spark, monkeypatch, implicit, least):
    """Ids of fewer and of more ratings than the rank, repeated pairs, ratings that aren't positive; any number of blocks."""
    monkeypatch.setattr(half_steps, "_LEAST", least)
    entries = [(3 * (u * u % 41), 7 * (i * u % 29), float((u + i) % 5 + 1)) for u in range(60) for i in range(20)]
    entries += [(500, 0, -1.0), (500, 7, 0.0), (501, 0, 2.0)] if implicit else [(500, 0, -1.0)]
    df = spark.createDataFrame(entries, "userId int, mediaId int, score double")
    cfg = AlsConfig(rank=10, max_iter=3, blocks=2, implicit=implicit)
    mllib = ALS(rank=10, maxIter=3, regParam=cfg.reg, implicitPrefs=implicit, numUserBlocks=2, numItemBlocks=2, seed=cfg.seed,
                userCol="userId", itemCol="mediaId", ratingCol="score").fit(df)
    model = factorization.fit_als(df, cfg)
    for ours, theirs in ((model.userFactors, mllib.userFactors), (model.itemFactors, mllib.itemFactors)):
        a, b = ({r["id"]: np.array(r["features"]) for r in t.collect()} for t in (ours, theirs))
        assert a.keys() == b.keys() and max(np.abs(a[i] - b[i]).max() for i in a) < 1e-5


def test_few_ratings_need_no_wide_equations():
    """An id of three ratings is solved in 3 x 3: ten thousand of them at the published rank in seconds."""
    rng = np.random.default_rng(0)
    y, r = rng.normal(size=(500, 128)).astype(np.float32), rng.normal(size=30_000)
    count = np.full(10_000, 3)
    cfg = AlsConfig.explicit_feedback()
    shapes = []
    dual, sums, plain = half_steps._explicit(cfg)
    solver = (lambda a, b: shapes.append(a.shape[1]) or dual(a, b), sums, plain)
    found = list(half_steps._solved(np.cumsum(count) - 3, count, rng.integers(0, 500, 30_000), r, y, 128, solver))
    assert sum(len(rows) for rows, _ in found) == 10_000 and set(shapes) == {3}


def test_vectors_move_once_a_block(spark):
    """A vector goes to the blocks that need it, not along with every rating."""
    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(40) for i in range(5)], "u int, i int, r float")
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id int, features array<float>")
    sent = half_steps._sent(half_steps.with_blocks(vectors, ratings, "i", "u", 3)).collect()
    assert sum(len(r["src"]) // 4 for r in sent) == 5 * len({r["block"] for r in sent}) <= 15


def test_steps_shuffle_nothing(spark):
    """A block is a task that scans its links and the vectors: every link meets its vector without a copy on disk."""
    ratings = spark.createDataFrame([(u, i, float(u + i)) for u in range(40) for i in range(5)], "u int, i int, r float")
    vectors = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "id int, features array<float>")
    with half_steps.step_settings(spark):
        links, sent = half_steps.pack_links(ratings, "u", "i", 3), half_steps.stage(half_steps.with_blocks(vectors, ratings, "i", "u", 3), "factors")
        blocks = half_steps._by_block(links, 3, sent)
        assert "Exchange" not in blocks._jdf.queryExecution().toString() and blocks.rdd.getNumPartitions() == 3
        rows = blocks.collect()
    met = {}
    for r in rows:
        if r["y"] is not None:
            met.setdefault(r["block"], {}).update(zip(np.frombuffer(r["src"], np.int32).tolist(), np.frombuffer(r["y"], np.float32)[::2].tolist()))
    for r in rows:
        if r["y"] is None:
            for u, i, n in zip(*(np.frombuffer(r[c], t) for c, t in (("dst", np.int32), ("src", np.int32), ("r", np.float32)))):
                assert met[r["block"]][i] == i and n == u + i
    assert sum(len(r["dst"]) // 4 for r in rows if r["y"] is None) == 200


def test_few_factor_tables_at_a_time(spark, monkeypatch):
    """A step finds the vectors it reads and, for the users, those they replace; neither MLlib's model nor earlier items."""
    df = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in range(u % 4 + 1)], "userId int, mediaId int, score float")
    root, solve, seen = Path(stage_root(spark), "mediarec", spark.sparkContext.applicationId), factorization.solve_side, []
    kinds = ("factors-*", "als-*/*Factors")
    before = {p for kind in kinds for p in root.glob(kind)}

    def counting(*args):
        seen.append(len({p for kind in kinds for p in root.glob(kind)} - before))
        return solve(*args)

    monkeypatch.setattr(factorization, "solve_side", counting)
    model = factorization.fit_als(df, AlsConfig(rank=3, max_iter=3, blocks=2, implicit=False))
    assert seen == [1, 2] * 3 and model.userFactors.count() == 30 and model.itemFactors.count() == 4
    assert len({p for kind in kinds for p in root.glob(kind)} - before) == 2


def test_a_rating_of_every_id_starts_the_same(spark):
    df = spark.createDataFrame([(u, i * 7, float(u - i)) for u in range(200) for i in range(u % 9 + 1)], "u int, i int, r float")
    few = factorization._one_of_each(df, "u", "i", "r")
    assert few.count() <= 200 + 9 < df.count()
    for implicit in (True, False):
        als = ALS(rank=4, maxIter=0, implicitPrefs=implicit, numUserBlocks=3, numItemBlocks=3, seed=1, userCol="u", itemCol="i", ratingCol="r")
        for side in ("userFactors", "itemFactors"):
            whole, part = ({r["id"]: list(r["features"]) for r in getattr(als.fit(x), side).collect()} for x in (df, few))
            assert whole == part and len(whole) == (200 if side == "userFactors" else 9)


def test_own_vectors_are_read_where_they_are(spark, monkeypatch):
    """The residual of a side copies neither its ratings' other side twice nor its own vectors."""
    df = spark.createDataFrame([(u, i, float(u % 3 + i)) for u in range(30) for i in range(u % 4 + 1)], "userId int, mediaId int, score float")
    cfg, staged = AlsConfig(rank=3, max_iter=2, blocks=2, implicit=False), []
    model = factorization.fit_als(df, cfg)
    for module in (factorization, half_steps):
        monkeypatch.setattr(module, "stage", lambda rows, name, *by: staged.append(name) or stage(rows, name, *by))
    found = factorization.normal_residual(model, df, cfg)
    assert found.count() == 30 and found.where("residual > 1e-3").count() == 0
    assert sorted(staged) == ["factors", "links", "residuals"]


def test_saved_vectors_are_not_shuffled(spark, sf, monkeypatch):
    """A saved model is compared whole, without its vectors in shuffle files."""
    monkeypatch.setattr(queries, "EXPLICIT", AlsConfig.explicit_feedback(rank=4, max_iter=1, blocks=2))
    df = queries.als_saved(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    sides = re.findall(r"Join FullOuter.*\n[ :+-]*(.*)\n", plan)
    assert len(sides) == 2 and all(side.startswith("Project") and "sha2" in side for side in sides)
    got = df.collect()
    assert got and all(r["same"] and r["n"] == 4 for r in got)


def test_published_settings():
    a, b = AlsConfig.implicit_feedback(), AlsConfig.explicit_feedback()
    assert (a.rank, a.max_iter, a.reg, a.blocks, a.implicit) == (128, 15, 0.1, 128, True)
    assert (b.rank, b.max_iter, b.reg, b.implicit, b.seed) == (128, 15, 0.05, False, 42)
