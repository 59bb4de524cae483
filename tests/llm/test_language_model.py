import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediarec.llm import interpolation, queries
from mediarec.llm.common import read


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


@pytest.fixture(scope="module")
def found(spark, sf):
    return queries.op2_deleted_interpolation(spark, sf).toPandas().set_index("doc_id")


def test_base_matches_brute_force(spark, sf, found):
    docs = {r.doc_id: tokens(r.text) for r in read(spark, sf, "documents").collect()}
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in docs.items():
        r = found.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_better_than_words_alone_on_unseen_texts(found):
    unseen = found[found.held_out]
    assert unseen.score.sum() > unseen.base_score.sum()


def test_any_block_and_shard_size(spark, sf):
    docs, all_ = read(spark, sf, "documents"), F.col("doc_id") % 3 != 0
    one = interpolation.scores(docs, all_, F.col("doc_id") % 5 == 0)
    two = interpolation.scores(docs, all_, F.col("doc_id") % 5 == 0, block=5_000, shard_tokens=7_000)
    a, b = (x.toPandas().sort_values("doc_id").reset_index(drop=True) for x in (one, two))
    assert np.allclose(a.score, b.score, rtol=1e-6) and (a.n_known == b.n_known).all()


class Plain:
    """The model with dictionaries: counts of `train`, weights learned from those of them that are `deleted`."""

    def __init__(self, train, deleted):
        def count(docs):
            words, pairs, contexts = Counter(), Counter(), Counter()
            for ws in docs:
                words.update(ws)
                for h, w in zip([b"\n", *ws], ws):
                    pairs[h, w] += 1
            contexts.update(words)
            return words, pairs, contexts, sum(words.values()), len(words)

        self.full, fit = count(train + deleted), count(train)
        self.weights = np.tile([1 / 3, 1 / 3, 1 / 3], (interpolation.BUCKETS, 1))
        self.weights[0] = 0, 0.5, 0.5
        if not self.full[3]:
            self.weights[:] = 0, 0, 1
        tokens_ = [(h, w) for ws in deleted for h, w in zip([b"\n", *ws], ws)]
        while True:
            sums = np.zeros_like(self.weights)
            for h, w in tokens_:
                parts = self.parts(fit, h, w) * self.weights[self.bucket(fit, h)]
                sums[self.bucket(fit, h)] += parts / parts.sum()
            whole = sums.sum(0) / sums.sum() if sums.sum() else np.full(3, 1 / 3)
            new = np.maximum((sums + 3 * whole) / (sums.sum(1, keepdims=True) + 3), 1e-6)
            new[0, 0] = 0
            if not self.full[3]:
                new[:, :2] = 0
            new /= new.sum(1, keepdims=True)
            done, self.weights = np.abs(new - self.weights).max() < 1e-3, new
            if done:
                break

    @staticmethod
    def bucket(counts, h):
        return int(math.log2(counts[2][h] + 1))

    @staticmethod
    def parts(counts, h, w):
        words, pairs, contexts, n, v = counts
        return np.array([pairs[h, w] / contexts[h] if contexts[h] else 0.0, words[w] / max(n, 1), 1 / (v + 1)])

    def probability(self, h, w):
        return float(self.parts(self.full, h, w) @ self.weights[self.bucket(self.full, h)])

    def score(self, ws):
        return sum(math.log10(self.probability(h, w)) for h, w in zip([b"\n", *ws], ws))


def test_score_matches_a_plain_model(spark, sf):
    docs = {r.doc_id: tokens(r.text) for r in read(spark, sf, "documents").collect()}
    training, deleted = F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 == 0
    model = Plain([ws for i, ws in docs.items() if i % 3 and i % 5], [ws for i, ws in docs.items() if i % 3 and not i % 5])
    for r in interpolation.scores(read(spark, sf, "documents"), training, deleted).collect():
        assert r.score == pytest.approx(model.score(docs[r.doc_id]), rel=1e-4)


@pytest.mark.parametrize("share", [2, 10 ** 6])
def test_probabilities_sum_to_one(spark, share):
    """After every context, seen or not, over all words, the end and the unknown word; also when nothing is held out."""
    words = [f"w{i}" for i in range(6)]
    train = [(i, " ".join(words[(i * k) % 6] for k in range(1 + i % 5))) for i in range(60)]
    model = Plain([tokens(t) for i, t in train if (i + 1) % share], [tokens(t) for i, t in train if not (i + 1) % share])
    every = [*(w.encode() for w in words), b"\n", b"unseen"]
    for h in every:
        assert sum(model.probability(h, w) for w in every) == pytest.approx(1.0)
    asked = [(1000 + k, f"{a} {b}") for k, (a, b) in enumerate((a, b) for a in [*words, "unseen"] for b in [*words, "unseen", ""])]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string")
    got = {r.doc_id: r.score for r in interpolation.scores(docs, F.col("doc_id") < 1000, (F.col("doc_id") + 1) % share == 0).collect()}
    for i, text in train + asked:
        assert got[i] == pytest.approx(model.score(tokens(text)), rel=1e-4)


def test_awkward_rows(awkward, nothing):
    every = interpolation.scores(awkward, F.lit(True), F.lit(False))
    rows = every.collect()
    assert len(rows) == awkward.count() and all(r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert interpolation.scores(nothing, F.lit(True), F.lit(False)).count() == 0
    untrained = interpolation.scores(awkward, F.lit(False), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0 for r in untrained)
