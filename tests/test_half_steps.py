"""Steps of a factorization: packed vectors, one job a step."""

import numpy as np
import pyarrow as pa
import pytest

from mediarec import queries
from mediarec.config import AlsConfig
from mediarec.operators import half_steps
from mediarec.operators.staging import stage


def _step(spark, cfg, users=60, items=12, blocks=3):
    ratings = spark.createDataFrame([(u, i, float(1 + (u + i) % 4)) for u in range(users) for i in range(items) if (u * i) % 3], "u int, i int, r float")
    rng = np.random.default_rng(0)
    y = {i: rng.normal(size=cfg.rank).astype(np.float32) for i in range(items)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in y.items()], "id int, features array<float>")
    with half_steps.step_settings(spark):
        links = half_steps.pack_links(ratings, "u", "i", blocks)
        sent = stage(half_steps.pack_vectors(vectors, blocks, cfg.implicit), "factors")
    return ratings, y, links, sent


@pytest.mark.parametrize("implicit", [True, False])
def test_a_step_is_one_job(spark, implicit):
    """The sums of y y' come with the vectors: neither they nor turned vectors take a job of their own; the result is that of dense matrices."""
    cfg = AlsConfig(rank=4, implicit=implicit)
    ratings, y, links, sent = _step(spark, cfg)
    spark.sparkContext.setJobGroup(f"step-{implicit}", "a step")
    found = half_steps.solve_side(links, 3, sent, 2, cfg)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"step-{implicit}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1
    x = {r["id"]: np.array(r["features"]) for r in half_steps.as_lists(found).collect()}
    own = {}
    for r in ratings.collect():
        own.setdefault(r["u"], []).append((r["i"], r["r"]))
    assert x.keys() == own.keys()
    whole = sum(np.outer(v, v) for v in y.values()) if implicit else 0
    for u, mine in own.items():
        a = whole + sum((s if implicit else 1) * np.outer(y[i], y[i]) for i, s in mine) + cfg.reg * len(mine) * np.eye(4)
        b = sum((1 + s if implicit else s) * y[i] for i, s in mine)
        assert np.allclose(x[u], np.linalg.solve(a, b), atol=1e-5)


def test_vectors_lie_many_to_a_row(spark):
    """A scan hands over stretches of vectors, not one row for each."""
    cfg = AlsConfig(rank=4, implicit=False)
    _, _, links, sent = _step(spark, cfg, users=500)
    found = half_steps.solve_side(links, 3, sent, 2, cfg)
    assert found.count() <= 3 and half_steps.as_lists(found).count() == 333  # users whose number 3 divides have no rating


@pytest.mark.parametrize("spread", [1, 40_000_000])
def test_vectors_may_come_before_the_ratings(spread):
    """Ids close together or far apart, ratings in any order of their cells, vectors in between."""
    ids = np.arange(40, dtype=np.int32) * spread
    rng = np.random.default_rng(1)
    dst, at = np.repeat(np.arange(9, dtype=np.int32), 4), 2 * rng.integers(0, 20, 36)
    src, y = ids[at], rng.normal(size=(40, 3)).astype(np.float32)

    def vectors(some):
        return half_steps._row(half_steps._PACKED, block=0, src=ids[some], y=y[some])

    def links(some):
        return half_steps._row(half_steps._PACKED, block=0, src=src[some], dst=dst[some], r=at[some].astype(np.float32), parts=3)

    held = half_steps._Block(3)
    assert held.read(iter([vectors(slice(0, 15)), links(slice(20, 36)), links(slice(0, 10)), vectors(slice(15, 30)), links(slice(10, 20)), vectors(slice(30, 40))]))
    assert held.ids.tolist() == list(range(9)) and held.count.tolist() == [4] * 9
    assert np.array_equal(held.r, at) and np.array_equal(held.y[held.at], y[at])
    assert len(held.y) == len(np.unique(at))
    assert not half_steps._Block(3).read(iter([vectors(slice(0, 5)), pa.RecordBatch.from_pylist([], schema=half_steps._SCHEMAS[half_steps._PACKED])]))


def test_counts_are_computed_once(spark, sf, monkeypatch):
    """Index and ratings come from one table of counts, not from two joins of the log."""
    monkeypatch.setattr(queries, "EXPLICIT", AlsConfig.explicit_feedback(rank=2, max_iter=1, blocks=2))
    counts, calls = queries.X.counts, []
    monkeypatch.setattr(queries.X, "counts", lambda *a: calls.append(1) or counts(*a))
    assert queries.als_explicit(spark, sf).count() > 0 and len(calls) == 1
