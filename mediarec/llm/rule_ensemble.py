"""Sparse rule ensemble for document quality.

1. Statistics of each text are Spark columns (no Python touches the text).
2. A random forest over the statistics of labelled texts gives trees; every
   path from a root to a node is a conjunctive rule.
3. A logistic regression with an L1 penalty weighs the rules; most get zero.
4. The rules left are compiled into one Spark column expression, so scoring is
   a plain projection: no shuffle, no model object on the executors.

The fit uses a bounded sample of labelled rows (`max_rows`, chosen by a hash of
the id, so every run takes the same); counts grow with neither tree nor rule.

Defined results: a null or blank text has zero statistics and gets a score like
any other; rows without a label are not learned from; without any label the
score is 0.5, with labels of one class only it is their smoothed share.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from mediarec.llm.common import computed_once, fresh, text_of, words
from mediarec.operators.staging import stage

STATS = ("n_words", "word_length", "distinct_share", "upper_share", "symbol_share", "mark_share", "digit_share", "line_words", "richness")


@dataclass(frozen=True)
class EnsembleConfig:
    max_rows: int = 20_000     # bound of the labelled sample the fit reads
    trees: int = 16
    depth: int = 3
    penalty: float = 0.002
    threshold: float = 0.3     # predicted 1 from this score on
    seed: int = 7


@dataclass(frozen=True)
class Rules:
    """`terms`: (weight, ((statistic, above, cut), ...)); `above` means > cut, else <= cut."""

    intercept: float
    terms: tuple

    def score(self, columns: dict[str, str]) -> Column:
        """Probability of label 1 as one expression; `columns` names the column of each statistic."""
        total = F.lit(self.intercept)
        for weight, path in self.terms:
            holds = F.lit(True)
            for name, above, cut in path:
                holds &= (F.col(columns[name]) > cut) if above else (F.col(columns[name]) <= cut)
            total += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def with_stats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with a column for each of STATS, and the names they got."""
    w, *names = fresh(docs, "stat_words", *STATS)
    t, n = text_of(text), F.size(w)
    chars = F.length(F.array_join(w, ""))

    def share(pattern: str) -> Column:
        return F.when(chars > 0, F.length(F.regexp_replace(t, f"[^{pattern}]+", "")) / chars).otherwise(0.0)

    per_word = F.when(n > 0, chars / n).otherwise(0.0)
    distinct = F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(0.0)
    stats = (n.cast("double"), per_word, distinct, share("\\p{Lu}"), share("#*$%&|<>"), share("!?"), share("0-9"),
             n / F.size(F.split(t, "\n", -1)),
             # log of distinct words by log of words: unlike the share, it hardly falls with length.
             F.when(n > 1, F.log(F.size(F.array_distinct(w))) / F.log(n)).otherwise(1.0))
    out = computed_once(docs.withColumn(w, words(t)), **{c: s.cast("double") for c, s in zip(names, stats)})
    return out.drop(w), dict(zip(STATS, names))


def _paths(debug: str) -> list[tuple]:
    """All root-to-node paths of the trees in an ML model's description, as tuples of conditions."""
    found, path = [], []
    for line in debug.splitlines():
        if line.strip().startswith("Tree"):
            path = []
        test = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if test:
            level = len(test[1])
            path = [(lv, c) for lv, c in path if lv < level]
            path.append((level, (STATS[int(test[3])], test[4] == ">", float(test[5]))))
            found.append(tuple(c for _, c in path))
    return found


def _narrowed(path: tuple) -> tuple:
    """The same rule with one bound per statistic and side, in a fixed order."""
    tight: dict = {}
    for name, above, cut in path:
        key = (name, above)
        tight[key] = cut if key not in tight else (max if above else min)(tight[key], cut)
    return tuple(sorted((n, a, c) for (n, a), c in tight.items()))


def fit(labelled: DataFrame, config: EnsembleConfig = EnsembleConfig()) -> Rules:
    """Rules from rows with a 0/1 `label` and the columns of STATS; `labelled` holds at most `max_rows` rows or so."""
    rows = stage(labelled.select(F.col("label").cast("double").alias("label"), *STATS), "rule-training")
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        import math
        p = 0.5 if not n else (ones + 0.5) / (n + 1)
        return Rules(math.log(p / (1 - p)), ())
    vectors = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=config.trees, maxDepth=config.depth, seed=config.seed, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, maxBins=64, minInstancesPerNode=max(1, int(n * 0.002))).fit(vectors)
    paths = sorted({_narrowed(p) for p in _paths(forest.toDebugString)})
    if not paths:
        import math
        return Rules(math.log(ones / (n - ones)), ())
    flags = [f"r{i}" for i in range(len(paths))]
    table = rows.select("label", *[
        F.expr(" AND ".join(f"{c} {'>' if above else '<='} {cut!r}D" for c, above, cut in p)).cast("double").alias(f)
        for f, p in zip(flags, paths)])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=config.penalty, maxIter=60, standardization=True).fit(
        VectorAssembler(inputCols=flags, outputCol="features").transform(table).select("label", "features"))
    terms = tuple((float(w), p) for w, p in zip(lasso.coefficients.toArray(), paths) if w)
    return Rules(float(lasso.intercept), terms)


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, config: EnsembleConfig = EnsembleConfig()) -> Rules:
    """Fit on `labels` (doc_id, quality) joined to `docs` (doc_id, text); `train` selects label rows.

    The sample of label rows is bounded by `max_rows` before it is broadcast.
    """
    rows = labels.select("doc_id", F.col("quality").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if train is not None:
        rows = rows.where(train)
    total = rows.count()
    # 1/1024 steps of a hash of the id; a margin keeps the expected size under the bound.
    share = min(1024, int(1024 * 0.95 * config.max_rows / total)) if total > config.max_rows else 1024
    rows = rows.where(F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(1024)) < max(share, 1))
    # Size bound: about max_rows rows of 12 bytes, see above.
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return fit(with_stats(sample)[0], config)


def scored(docs: DataFrame, rules: Rules, out: str, text: str = "text") -> DataFrame:
    """`docs` with a double column `out`."""
    with_all, names = with_stats(docs, text)
    return with_all.withColumn(out, rules.score(names)).select(*docs.columns, out)


def keep_good(docs: DataFrame, labels: DataFrame, train: Column | None = None, config: EnsembleConfig = EnsembleConfig()) -> DataFrame:
    """The documents predicted to be of quality 1, with their own columns only."""
    (score,) = fresh(docs, "score")
    return scored(docs, learn(docs, labels, train, config), score).where(F.col(score) >= config.threshold).select(*docs.columns)
