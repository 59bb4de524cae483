from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from frames import rows
from pyspark.sql import functions as F

from mediarec.config import FusionConfig
from mediarec.operators import fusion, fusion_net as net
from mediarec.plans.evaluate import evaluate, train_fusion

SMALL = FusionConfig(modality="va", hidden=12, dropout=0.0, lr=3e-3, epochs=25, warmup_epochs=2, batch=32)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    v, a = rng.normal(size=(160, 5)), rng.normal(size=(160, 3))
    y = v @ rng.normal(size=(5, 4)) + a @ rng.normal(size=(3, 4)) + 0.5
    df = spark.createDataFrame(
        [(f"i{i}", v[i].tolist(), a[i].tolist(), y[i].tolist()) for i in range(160)],
        "item_id string, vision array<double>, audio array<double>, cf array<double>").repartition(4).cache()
    number = F.substring("item_id", 2, 9).cast("int")
    return df.where(number < 128), df.where(number >= 128)


def test_gradient_matches_differences():
    cfg = replace(SMALL, hidden=4)
    rng = np.random.default_rng(1)
    x = {"v": rng.normal(size=(7, 3)), "a": rng.normal(size=(7, 2))}
    y = rng.normal(size=(7, 2))
    p = net.init_params({"v": 3, "a": 2}, 2, cfg)
    _, grads = net.loss_and_grad(p, x, y, cfg)
    for name, w in p.items():
        for at in list(np.ndindex(w.shape))[:6]:
            keep, eps = w[at], 1e-6
            w[at] = keep + eps
            up = net.loss_and_grad(p, x, y, cfg)[0]
            w[at] = keep - eps
            down = net.loss_and_grad(p, x, y, cfg)[0]
            w[at] = keep
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-6


def test_minibatches_cross_arrow_batches():
    parts = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 5), (5, 6), (6, 19), (19, 23))]
    got = [list(p["x"]) for p in fusion._minibatches(iter(parts), 4)]
    assert [len(p) for p in got] == [4, 4, 4, 4, 4, 3]
    assert [x for p in got for x in p] == list(range(23))
    assert [len(p) for p in fusion._minibatches(iter(parts), 100)] == [23]


def test_schedule():
    cfg = FusionConfig()
    assert net.learning_rate(0, cfg) == 0
    assert net.learning_rate(5, cfg) == pytest.approx(cfg.lr / 2)
    assert net.learning_rate(10, cfg) == pytest.approx(cfg.lr)
    assert net.learning_rate(105, cfg) == pytest.approx((cfg.lr + cfg.min_lr) / 2)
    assert net.learning_rate(200, cfg) == pytest.approx(cfg.min_lr)


def test_ridge_recovers_a_linear_map(data):
    train, valid = data
    model = fusion.fit_fusion(train, valid, replace(SMALL, solver="ridge"))
    assert model.losses[0][1] < 1e-6 and model.losses[0][2] < 1e-6
    scored = {r["item_id"]: r["vec"] for r in fusion.score_fusion(valid, model).collect()}
    want = {r["item_id"]: r["cf"] for r in valid.collect()}
    assert scored.keys() == want.keys()
    assert all(np.allclose(scored[i], want[i], atol=1e-3) for i in want)


def test_conjugate_gradients_equal_the_normal_equations(data, monkeypatch):
    train, valid = data
    whole = fusion.fit_fusion(train, valid, replace(SMALL, solver="ridge"))
    monkeypatch.setattr(fusion, "GRAM_WIDTH", 1)
    monkeypatch.setattr(fusion, "_CELL", 200)
    rounds = fusion.fit_fusion(train, valid, replace(SMALL, solver="ridge"))
    assert np.allclose(whole.params["ridge.w"], rounds.params["ridge.w"], atol=1e-7)
    assert np.allclose(whole.losses[0], rounds.losses[0], atol=1e-9)
    with pytest.warns(UserWarning, match="after 2 rounds"):
        fusion.fit_fusion(train, valid, replace(SMALL, solver="ridge", cg_rounds=2))
    alone = fusion.ablation(train, valid, replace(SMALL, solver="ridge"), ["v", "va"])
    assert alone.columns == ["modality", "train_loss", "valid_loss"] and alone.count() == 2


def test_wide_ridge_recovers_the_planted_map(spark, monkeypatch):
    """3,000 inputs; nothing is projected away and no array has the square of the width."""
    def noise(i):
        return (F.pmod(F.xxhash64("n", i), F.lit(20001)) - 10000) / 10000.0

    wide = F.transform(F.sequence(F.lit(1), F.lit(3000)), noise)
    rows_ = spark.range(3900, numPartitions=8).withColumn("n", F.col("id")).select(
        F.col("id").cast("string").alias("item_id"), wide.alias("vision"))
    some = [F.element_at("vision", i) * c for i, c in ((1, 2.0), (1400, -1.0), (3000, 0.5))]
    made = rows_.withColumn("cf", F.array(some[0] + some[1], some[2] + 1.0))
    held = F.col("item_id").cast("int") >= 3800
    largest = []
    monkeypatch.setattr(fusion, "_summed", lambda *a, f=fusion._summed, **k: (got := f(*a, **k), largest.append(len(got)))[0])
    monkeypatch.setattr(fusion, "_gram", None)
    model = fusion.fit_fusion(made.where(~held), made.where(held), FusionConfig(modality="v", solver="ridge", cg_tolerance=1e-7))
    w = model.params["ridge.w"]
    assert w.shape == (3001, 2) and model.losses[0][2] < 1e-8 and max(largest) == 3 * 3001
    want = np.zeros((3001, 2))
    want[[0, 1399, 2999, 3000], [0, 0, 1, 1]] = 2.0, -1.0, 0.5, 1.0
    assert np.abs(w - want).max() < 1e-3


def test_result_does_not_depend_on_partitions(data):
    train, valid = data
    cfg = replace(SMALL, epochs=3, dropout=0.2)
    fits = [fusion.fit_fusion(train.repartition(n), valid.repartition(n), cfg) for n in (1, 2, 8)]
    for other in fits[1:]:
        assert all(np.allclose(fits[0].params[n], other.params[n], rtol=0, atol=1e-9) for n in other.params)
        assert np.allclose(fits[0].losses, other.losses, rtol=0, atol=1e-9)


@pytest.mark.parametrize("solver", ["mlp", "ridge"])
def test_no_validation_rows_or_loss_is_an_error(data, solver, monkeypatch):
    train, valid = data
    cfg = replace(SMALL, epochs=1, solver=solver)
    with pytest.raises(ValueError):
        fusion.fit_fusion(train, valid.where("false"), cfg)
    for value in ("nan", "inf"):
        broken = [d.withColumn("cf", F.transform("cf", lambda x: x * float(value))) for d in data]
        with pytest.raises(ValueError):
            fusion.fit_fusion(train, broken[1], cfg)
        with pytest.raises(ValueError):
            fusion.fit_fusion(broken[0], valid, cfg)
    monkeypatch.setattr(fusion, "GRAM_WIDTH", 1)
    if solver == "ridge":
        for pair in ((train, broken[1]), (broken[0], valid), (train, valid.where("false"))):
            with pytest.raises(ValueError):
                fusion.fit_fusion(*pair, cfg)


def test_training_lowers_both_losses(data):
    train, valid = data
    model = fusion.fit_fusion(train, valid, replace(SMALL, lr=3e-2))
    first, last = model.losses[0], model.losses[-1]
    assert last[1] < 0.5 * first[1] and last[2] < 0.7 * first[2]


def test_one_batch_is_plain_training(data):
    """With all rows in one batch, an epoch is one full-batch Adam step."""
    train, valid = data
    cfg = replace(SMALL, batch=1000, epochs=3, warmup_epochs=1)
    model = fusion.fit_fusion(train, valid, cfg)
    local = train.collect()
    x = {"v": np.array([r["vision"] for r in local]), "a": np.array([r["audio"] for r in local])}
    y = np.array([r["cf"] for r in local])
    p = net.init_params({"v": 5, "a": 3}, 4, cfg)
    m, v = ({n: np.zeros_like(w) for n, w in p.items()} for _ in range(2))
    losses = []
    for epoch in range(3):
        loss, grads = net.loss_and_grad(p, x, y, cfg)
        net.adam_step(p, m, v, grads, epoch + 1, net.learning_rate(epoch, cfg))
        losses.append(loss)
    assert np.allclose([r[1] for r in model.losses], losses)


def test_steps_are_synchronous_over_many_tasks(data, monkeypatch):
    """However a minibatch is cut into tasks, the fit is the same, and every row counts once an epoch."""
    train, valid = data
    cfg = replace(SMALL, epochs=2, batch=64, dropout=0.2)
    whole = fusion.fit_fusion(train, valid, cfg)
    seen = train.sparkSession.sparkContext.accumulator(0)
    tasks = train.sparkSession.sparkContext.accumulator(0)
    made = fusion._step_task

    def counted(*args):
        run = made(*args)

        def step(batches):
            got = list(batches)
            seen.add(sum(map(len, got)))
            tasks.add(1 if got else 0)
            return run(iter(got))
        return step

    monkeypatch.setattr(fusion, "_step_task", counted)
    monkeypatch.setattr(fusion, "_TASK_ROWS", 8)
    spark = train.sparkSession
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a file or so a task
    cut = fusion.fit_fusion(train, valid, cfg)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen.value == 2 * 128 and tasks.value >= 16
    assert np.allclose(whole.losses, cut.losses, rtol=0, atol=1e-9)
    assert all(np.allclose(whole.params[n], cut.params[n], rtol=0, atol=1e-9) for n in whole.params)


def test_same_seed_same_result(data):
    train, valid = data
    cfg = replace(SMALL, epochs=3, dropout=0.2)
    a, b = (fusion.fit_fusion(train, valid, cfg) for _ in range(2))
    assert np.allclose([r[1:] for r in a.losses], [r[1:] for r in b.losses])
    assert fusion.fit_fusion(train, valid, replace(cfg, seed=9)).losses[-1][1] != a.losses[-1][1]


def test_early_stop(data):
    train, valid = data
    model = fusion.fit_fusion(train, valid, replace(SMALL, lr=5.0, warmup_epochs=0, epochs=60, patience=2))
    assert len(model.losses) < 60


def test_weights_table(spark, data):
    train, valid = data
    model = fusion.fit_fusion(train, valid, replace(SMALL, epochs=1))
    back = fusion.load_weights(model.weights_table(spark))
    assert back.keys() == model.params.keys() and all(np.array_equal(back[n], model.params[n]) for n in back)
    assert model.history(spark).columns == ["epoch", "train_loss", "valid_loss"]
    with pytest.raises(ValueError):
        fusion.fit_fusion(train, valid, replace(SMALL, solver="transformer"))


def test_ablation(spark, data):
    train, valid = data
    cfg = replace(SMALL, solver="ridge")
    got = {r["modality"]: r for r in fusion.ablation(train, valid, cfg, ["v", "a", "va"], [0, 1]).collect()}
    assert len(got) == 3 and got["va"]["valid_loss"] < 1e-6 < got["v"]["valid_loss"]
    for name in got:   # a block of the shared sum equals a fit of its own
        alone = fusion.fit_fusion(train, valid, replace(cfg, modality=name)).losses[0]
        assert got[name]["valid_loss"] == pytest.approx(alone[2], abs=1e-9)
    out = fusion.ablation(train, valid, replace(SMALL, epochs=2), ["v", "va"], [0, 1],
                          evaluate=lambda m: fusion.score_fusion(valid, m).agg(F.count(F.lit(1)).alias("scored")))
    assert out.count() == 4 and rows(out.select("scored").distinct()) == [(32,)]


def test_evaluation_from_features(spark, data):
    train, valid = data
    both = train.unionByName(valid)
    feats = both.select("item_id", F.lit("vision").alias("modality"), "vision").toDF("item_id", "modality", "vec").unionByName(
        both.select("item_id", F.lit("audio").alias("modality"), "audio").toDF("item_id", "modality", "vec"))
    factors = both.select(F.col("item_id").alias("id"), F.col("cf").alias("vec"))
    model, counts = train_fusion(feats, factors, train.select(F.col("item_id").alias("id")),
                         valid.select(F.col("item_id").alias("id")), replace(SMALL, solver="ridge"))
    slices = valid.select(F.lit("test/total").alias("slice"), F.col("item_id").alias("media_id"),
                          F.concat(F.lit("u"), "item_id").alias("id_no"), F.lit(1.0).alias("score"))
    users = factors.select(F.concat(F.lit("u"), "id").alias("id"), "vec")
    by_content = evaluate(slices, users, valid, model).first()
    assert rows(counts.select("part", "asked", "dropped")) == [("train", 128, 0), ("valid", 32, 0)]
    by_factor = evaluate(slices, users, factors).first()
    assert by_factor["recall"] == 1.0 and by_content["recall"] == 1.0 and by_content["n_users"] == 32
    some = evaluate(slices, users, factors.where("id <> 'i130'")).first()
    assert (some["users_missing"], some["items_missing"]) == (0, 1)
