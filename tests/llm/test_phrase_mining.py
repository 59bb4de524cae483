import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from mediarec.llm import phrase_mining as pm, queries
from mediarec.llm.common import read

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())


def counted(docs):
    """{lang: (words, Counter of phrases)} of (text, lang) pairs."""
    out = {}
    for text, lang in docs:
        n, phrases = out.setdefault("und" if lang is None else lang, ([0], Counter()))
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWERED)):
            words = re.findall("[^ \t]+", piece)
            n[0] += len(words)
            phrases.update(" ".join(words[i:i + s]) for s in (1, 2, 3) for i in range(len(words) - s + 1))
    return {lang: (n[0], phrases) for lang, (n, phrases) in out.items()}


def ranked(counts, config):
    rows = set()
    for lang, (n, f) in counts.items():
        cand = {p: a for p, a in f.items() if " " in p and a >= config.least}
        longer = Counter()
        for p, a in cand.items():
            w = p.split(" ")
            if len(w) == 3:
                for part in (" ".join(w[:2]), " ".join(w[1:])):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in cand.items():
            if p in longer and 100 * longer[p] >= config.cover * a:
                continue
            w = p.split(" ")
            cuts = [(1_000_000 * a * a // (l * r), k, l, r) for k in range(1, len(w))
                    for l, r in [(f[" ".join(w[:k])], f[" ".join(w[k:])])]]
            score, _, l, r = min(cuts)
            found.append((-score, -a, p.encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(found)[:config.top], 1):
            rows.add((lang, i, p.decode(), -a, l, r, n, -score))
    return rows


def result(df):
    return {tuple(r) for r in df.collect()}


def test_query_matches_brute_force(spark, sf):
    docs = [(r.text, r.lang) for r in read(spark, sf, "documents").collect()]
    got = queries.op13_toivonen_phrases(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result(got) == ranked(counted(docs), pm.MiningConfig())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ünd", "漢字", "a\x00b", "x\x1cy", "Q"]
    made = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=40)) + "." for _ in range(300)]
    made += ["New York City, new york  city;\tNEW YORK\tCITY!"] * 12 + ["one two"] * 9
    docs = [(i, t, rng.choice(["en", None])) for i, t in enumerate(made)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4), [(t, lang) for _, t, lang in docs]


@pytest.mark.parametrize("change", [{}, {"sample": 10 ** 9}, {"sample": 1, "lowered": 1}, {"lowered": 10 ** 9}, {"bits": 64}, {"top": 7, "cover": 90}])
def test_any_sample_gives_the_same(texts, change):
    """Also a sample that misses everything, one that is everything, and a filter that says yes to everything."""
    df, docs = texts
    config = replace(pm.MiningConfig(least=4), **change)
    assert result(pm.collocations(df, config, flush=500)) == ranked(counted(docs), config)


def test_failures_of_the_border_make_further_passes(texts):
    df, docs = texts
    whole, few = (pm.frequent_phrases(df, pm.MiningConfig(least=4, sample=s, lowered=1)) for s in (1, 10 ** 9))
    assert whole[1] == 1 and few[1] == 3  # words, then pairs, then triples
    tables = [{tuple(r) for r in t.collect()} for t, _ in (whole, few)]
    assert tables[0] == tables[1]
    want = {(lang, p, len(p.split(" ")), n) for lang, (_, f) in counted(docs).items() for p, n in f.items() if n >= 4}
    rows = [tuple(r) for r in few[0].where("size > 0").collect()]
    assert len(rows) == len(want) and set(rows) == want  # each phrase in one pass alone


def test_few_failures_take_one_further_pass(spark):
    """A pair and a triple of a word that the sample misses are counted in the pass that meets the word's pairs."""
    common = [(i, f"a b c d e f{i % 3} g h i j", "x") for i in range(400)]
    rare = spark.createDataFrame([(i, "a rare b c", "x") for i in range(400, 500)], "doc_id long, text string, lang string")
    # Rows outside the sample, so that `rare` isn't proposed.
    rare = [tuple(r) for r in rare.where("pmod(xxhash64(doc_id, text), 8) != 0").limit(30).collect()]
    docs = common + rare
    tables, passes = pm.frequent_phrases(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows = [tuple(r) for r in tables.where("size > 0").collect()]
    want = {(lang, p, len(p.split(" ")), n) for lang, (_, f) in counted([d[1:] for d in docs]).items() for p, n in f.items() if n >= 10}
    assert passes == 2 and len(rows) == len(want) and set(rows) == want
    assert {("x", "a rare", 2, 30), ("x", "rare b", 2, 30), ("x", "a rare b", 3, 30), ("x", "rare b c", 3, 30)} < want


def test_arithmetic_is_exact(spark, monkeypatch):
    counts = [("x", "a", 1, 999_999_999_999_989), ("x", "b", 1, 999_999_999_999_877), ("x", "a b", 2, 999_999_999_999_863),
              ("x", "b a", 2, 123_456_789_012_345), ("x", "", 0, 10 ** 16)]
    monkeypatch.setattr(pm, "frequent_phrases", lambda *_: (spark.createDataFrame(counts, "lang string, phrase string, size int, n long"), 1))
    config = pm.MiningConfig()
    table = {"x": (10 ** 16, Counter({p: n for _, p, s, n in counts if s}))}
    assert result(pm.collocations(None, config)) == ranked(table, config)


def test_filter_has_what_it_was_given():
    rng = np.random.default_rng(0)
    some, other = rng.integers(0, 2 ** 63, 500).astype(np.uint64), rng.integers(0, 2 ** 63, 5000).astype(np.uint64)
    f = pm.Filter(1 << 16)
    slots, words = f.set_bits(some)
    f.words[slots] |= words
    assert f.has(some).all() and f.has(other).mean() < 0.01


def test_longest_phrases_are_not_looked_up(monkeypatch):
    """Proposals are shorter than the longest phrases: a pass asks for words and pairs only."""
    words, ids, asked = [b"a", b"b", b"c"], np.array([0, 1, 2, 0, 1, 2, -1, 2, 1]), []
    f = pm.Filter(1 << 16)
    hashes = pm._word_hashes("x", words)
    for found in (hashes, pm._joined(hashes[[0, 1, 2]], hashes[[1, 2, 0]])):
        slots, bits = f.set_bits(found)
        f.words[slots] |= bits
    has = pm.Filter.has
    monkeypatch.setattr(pm.Filter, "has", lambda self, h: asked.append(len(h)) or has(self, h))
    got = {(tuple(k), n) for key, length, _, count in pm._grams("x", words, ids, 3, None, f) if length == 3 for k, n in zip(key.tolist(), count.tolist())}
    assert len(asked) == 2 and got == {((0, 1, 2), 2), ((1, 2, 0), 1), ((2, 0, 1), 1)}


def test_awkward_rows(awkward, nothing):
    config = pm.MiningConfig(least=2)
    docs = [(r.text, r.lang) for r in awkward.collect()]
    assert result(pm.collocations(awkward, config)) == ranked(counted(docs), config)
    assert pm.collocations(nothing, config).count() == 0
