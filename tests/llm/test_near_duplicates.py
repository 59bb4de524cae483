import random

import numpy as np
import pytest

from mediarec.llm import near_duplicates as nd, queries
from mediarec.llm.common import read


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """Smallest id reachable over links of 0.75 or more, by an index of shingles."""
    sets = {i: shingle_set(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i in sorted(sets):
        common = {}
        for g in sets[i]:
            for j in index.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            index[g].append(i)
        for j, x in common.items():
            if 100 * x >= 75 * (len(sets[i]) + len(sets[j]) - x):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    rows = queries.op7_near_duplicates(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_set(t))
               for r, (_, t) in zip(sorted(rows), sorted(docs)))


@pytest.mark.parametrize("block", [512, 8])
def test_crowded_group(spark, block):
    """Many edits of one text: linked, unlinked and chained ones, over several blocks."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
            words[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        docs.append((i * 7 % 120, " ".join(words)))
    got = nd.linked(spark.createDataFrame(docs, "doc_id long, text string"), nd.SketchConfig(block=block)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs)


def test_chain(spark):
    """Every text overlaps with the next one only."""
    words = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(words[i * 10:i * 10 + 110])) for i in range(40)]
    want = brute(docs)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.component_id for r in nd.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("n", [1, 3, 40, 600, 5000])
def test_sketch_fills_and_estimates(n):
    rng = np.random.default_rng(n)
    items = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    one = nd.sketch(items, 512)
    assert (one != np.iinfo(np.uint64).max).all()
    half = np.unique(np.concatenate([items[:n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)]))
    true = len(np.intersect1d(items, half)) / len(np.union1d(items, half))
    assert abs((one == nd.sketch(half, 512)).mean() - true) < 0.12


def test_awkward_rows(spark, awkward, nothing):
    docs = awkward.select("doc_id", "text")
    got = {r.doc_id: r for r in nd.linked(docs).collect()}
    assert nd.linked(docs).count() == awkward.count()
    assert [got[i].component_id for i in (2, 3, 4)] == [2, 3, 4] and got[None].component_id is None
    assert (got[5].component_id, got[8].component_id, got[13].component_id, got[6].component_id) == (1, 7, 12, 6)
    kept = nd.keep_first(awkward)
    assert kept.columns == awkward.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert {i: got[i].component_id for i in want} == want and want[10] == 1
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c)
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert nd.linked(nothing).count() == 0 and nd.keep_first(nothing).count() == 0
