import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mediarec.llm import quality_rules as qr, queries, rule_ensemble as re_
from mediarec.llm.common import read


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def bucket(value, accuracy=0.01):
    """The middle of the bucket a value falls into; zero is its own."""
    if value <= 0:
        return 0.0
    ratio = (1 + accuracy) / (1 - accuracy)
    return 2 * ratio ** math.ceil(round(math.log(value) / math.log(ratio), 9)) / (ratio + 1)


def verdicts(docs, config=qr.RulesConfig()):
    """kept and the bounds of `docs` {id: (text, lang, source)} by weighted quantiles of plain lists."""
    rows, groups = {}, {}
    for i, (text, lang, source) in docs.items():
        n, chars, symbols, dup, repeat = counts(text)
        lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        failed = n < 50 or 100 * repeat > 50 * n
        m = {"word_length": chars / n if n else 0, "symbols": symbols / chars if chars else 0, "dup_lines": dup / lines if lines else 0,
             "repeats": repeat / n if n else 0, "words": n, "chars": chars, "lines": lines}
        rows[i] = (failed, m, (lang, source))
        if not failed:
            groups.setdefault((lang, source), []).append(m)

    def weighted(parts, name, q):
        """parts: (list of texts, weight of all of them; None: one each)."""
        weights = Counter()
        for texts, weight in parts:
            for m in texts:
                weights[bucket(m[name])] += 1 if weight is None else weight / len(texts)
        total, seen = sum(weights.values()), 0.0
        for value in sorted(weights):
            seen += weights[value]
            if seen >= q * total - 1e-6:
                return value

    bounds = {}
    every = [m for g in groups.values() for m in g]
    for key, own in groups.items():
        lang = [m for k, g in groups.items() if k[0] == key[0] for m in g]
        # The language's own sketch has `prior` texts of all in it before it is scaled to `prior` texts itself.
        p = config.prior
        parts = [(own, None), (lang, p * len(lang) / (len(lang) + p)), (every, p * p / (len(lang) + p))]
        for name, event, size in config.steps:
            q1, q3 = (weighted(parts, name, q) for q in (0.25, 0.75))
            spread = config.reach * max(q3 - q1, event / weighted(parts, size, 0.5))
            bounds[key, name] = (q1 - spread, q3 + spread)
    kept = set()
    for i, (failed, m, key) in rows.items():
        inside = all(m[n] <= bounds[key, n][1] + 1e-12 and (n not in config.lower or m[n] >= bounds[key, n][0] - 1e-12) for n, _, _ in config.steps if (key, n) in bounds)
        if not failed and inside:
            kept.add(i)
    return kept, bounds


def test_query_matches_brute_force(spark, sf):
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in read(spark, sf.replace("0.001", "0.01"), "documents").collect()}
    rows = queries.op6_quality_rules(spark, sf.replace("0.001", "0.01")).collect()
    for r in rows:
        assert tuple(r)[1:6] == counts(docs[r.doc_id][0])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept, bounds = verdicts(docs)
    assert {r.doc_id for r in rows if r.kept} == kept
    for name in ("word_length", "symbols", "dup_lines", "repeats"):  # every measure has bounds of the groups' own
        assert len({round(b[1], 6) for (_, n), b in bounds.items() if n == name}) > 1


@pytest.mark.parametrize("text", ["", "a", "a a", "a a a", "a a a a", "a b c a b c", "x a b c y a b c a b c", "one two three " * 50, "a\na\n\n \na\nb"])
def test_counts_of_small_texts(spark, text):
    got = qr.with_counts(spark.createDataFrame([(text,)], "text string")).first().counts
    assert tuple(got)[:5] == counts(text)


def test_sketches_merge_and_stay_within_the_error(spark):
    frame = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7.0).alias("v"))
    fine = qr.sketch(frame, ["g"], {"v": F.col("v")}, 0.01)
    whole = {r.bucket: r.n for r in qr.sketch(frame, [], {"v": F.col("v")}, 0.01).collect()}
    assert {r.bucket: r.n for r in qr.merge(fine, []).collect()} == whole
    got = qr.quantiles(qr.merge(fine, []), [], 0.01, {"low": 0.25, "high": 0.75}).first()
    assert got.low == pytest.approx(20_000 / 7 / 4, rel=0.02) and got.high == pytest.approx(20_000 / 7 * 3 / 4, rel=0.02)


def test_small_groups_lean_on_their_language(spark):
    """300 texts speak for themselves, three hardly at all."""
    rows = [("x", "a", 10.0)] * 300 + [("x", "b", 20.0)] * 3 + [("x", "c", 20.0)] * 900
    frame = spark.createDataFrame(rows, "k_lang string, k_source string, v double")
    fine = qr.sketch(frame, ["k_lang", "k_source"], {"v": F.col("v")}, 0.01)
    both = qr.shrunk(fine, qr.merge(fine, ["k_lang"]), ["k_lang", "k_source"], ["k_lang"], 100)
    assert {(r.k_source, round(r.n, 6)) for r in both.groupBy("k_source").agg(F.sum("n").alias("n")).collect()} == {("a", 400.0), ("b", 103.0), ("c", 1000.0)}
    got = {r.k_source: r for r in qr.quantiles(both, ["k_lang", "k_source"], 0.01, {"q1": 0.2, "q3": 0.75}).collect()}
    assert got["a"].q1 == pytest.approx(10, rel=0.01) and got["a"].q3 == pytest.approx(10, rel=0.01)
    assert got["b"].q1 == pytest.approx(10, rel=0.01) and got["b"].q3 == pytest.approx(20, rel=0.01)


def test_outliers_of_each_measure_are_caught(spark):
    """In every source one text stands out in one measure; all others stay."""
    plain = "The {i} walks by river number {i} and the story goes on with other words than {i} before\n" * 1
    def text(i, s):
        return "".join(f"line {i} {k} of source {s} tells about thing{i * k} and thing{i + k} at place{k * 7 + i}\n" for k in range(12))
    rows = [(s * 1000 + i, text(i, s), "en", f"s{s}") for s in range(4) for i in range(1, 151)]
    base = text(500, 9)
    odd = {9001: base.replace(" ", " #$%", 30), 9002: "".join(line + "\n" for line in base.split("\n")[:3] * 2 + base.split("\n")[3:5]) + "one more line\nand another line\n",
           9003: " ".join(w * 4 for w in base.split()), 9004: base + "".join(base.split("\n")[:6]) + plain}
    rows += [(i, t, "en", f"s{i - 9001}") for i, t in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in qr.keep_good(docs).collect()}
    assert kept == verdicts({r[0]: r[1:] for r in rows})[0]
    assert kept >= {r[0] for r in rows[:600]} and not kept & {9001, 9003, 9004}


def test_too_many_words_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(qr, "POSITIONS", 64)
    fits, too_long = (spark.createDataFrame([("a b " * n,)], "text string") for n in (32, 33))
    assert qr.with_counts(fits).first().counts.n_words == 64
    with pytest.raises(Exception, match="more than 64 words"):
        qr.with_counts(too_long).collect()


def test_bounds_follow_language_and_source(spark):
    """A symbol share that is usual in one source is an outlier in another."""
    plain, marked = "word " * 60 + "end {}", "word# " * 60 + "end {}"
    rows = [(plain.format(i), "en", "a") for i in range(300)] + [(marked.format(i), "en", "b") for i in range(300)] + [(marked.format("x"), "en", "a")]
    config = qr.RulesConfig(max_repeat_percent=100, steps=(("word_length", 1, "words"), ("symbols", 1, "chars"), ("dup_lines", 1, "lines")))
    kept = qr.keep_good(spark.createDataFrame(rows, "text string, lang string, source string"), config)
    assert kept.count() == 600 and kept.where("source = 'a' and text like '%#%'").count() == 0


def test_awkward_rows(awkward, nothing):
    kept = qr.keep_good(awkward)
    numbered = {i: (r.text, r.lang, r.source) for i, r in enumerate(awkward.collect())}
    want = sorted(numbered[i][0] for i in verdicts(numbered)[0])
    assert kept.columns == awkward.columns and sorted(r.text for r in kept.collect()) == want
    assert qr.keep_good(nothing).count() == 0


def test_ensemble_on_held_out_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in read(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = queries.op8_rule_ensemble(spark, "/root/testdata/sf0.01").collect()
    tested = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(tested) > 20 and sum(a == b for a, b in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_compiled_expression_is_the_fitted_lasso(spark):
    """Rules, weights and the logistic function, applied row by row in Python, give the column's scores."""
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rules = re_.learn(docs, read(spark, sf, "labels"))
    table, names = re_.with_stats(docs)
    assert len(rules.terms) > 1
    for r in table.withColumn("score", rules.score(names)).collect():
        margin = rules.intercept + sum(w for w, path in rules.terms if all((r[names[n]] > cut) == above for n, above, cut in path))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    # An id labelled twice counts twice and breaks nothing.
    labels = read(spark, sf, "labels")
    twice = re_.learn(docs, labels.unionByName(labels))
    assert re_.scored(docs, twice, "score").where("score between 0 and 1").count() == docs.count()


def test_paths_of_a_tree():
    debug = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 1 <= 2.5)
     If (feature 0 <= 1.0E-4)
      Predict: 0.0
     Else (feature 0 > 1.0E-4)
      Predict: 1.0
    Else (feature 1 > 2.5)
     Predict: 1.0
"""
    a, b = re_.STATS[1], re_.STATS[0]
    assert re_._paths(debug) == [((a, False, 2.5),), ((a, False, 2.5), (b, False, 1e-4)), ((a, False, 2.5), (b, True, 1e-4)), ((a, True, 2.5),)]
    assert re_._narrowed((("x", True, 1.0), ("x", True, 2.0), ("x", False, 5.0))) == (("x", False, 5.0), ("x", True, 2.0))


def test_ensemble_without_labels(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["out"] for r in re_.scored(awkward, re_.learn(awkward, none), "out").select("out").collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (5, None, 0), (None, 0, 0)], none.schema)
    assert re_.scored(awkward, re_.learn(awkward, ones), "out").first()["out"] > 0.7
    kept = re_.keep_good(awkward, ones)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert re_.keep_good(nothing, ones).count() == 0
