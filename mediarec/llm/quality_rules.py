"""Quality rules with thresholds learned per language and source.

Every text is measured with built-in functions. The measures of a (language,
source) group go into a quantile sketch with a bounded relative error: values
fall into buckets that grow by a fixed ratio, so a sketch is a table of bucket
counts and two sketches merge by adding counts. That makes it deterministic,
pre-aggregated by each map task (a hot source costs a few hundred rows per
task) and mergeable into coarser sketches. A group's sketch is merged with its
language's, scaled down to the weight of `prior` texts, and that one with the
sketch of all texts likewise: a large group speaks for itself, a small one leans
on its language as far as it is small.

A bound is a far-out fence: upper quartile plus `reach` times the spread
between the quartiles, and the same downwards. Where most texts of a group have
the same value, as shares often are zero, the spread is the size of the
smallest event in a median text of the group: one symbol among its characters,
one duplicate line among its lines, one repeated window of three words (six
words) among its words. So sources of long texts get narrower bounds than
sources of short ones, and no bound is a constant.

Defined results: a null or blank text has no words and fails the base rules;
null language and null source are groups of their own; a text of more than
2^24 words stops the job with an error (positions have 24 bits); an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mediarec.llm.common import HAS_WORD, computed_once, fresh, text_of, words
from mediarec.operators.staging import stage

POSITIONS = 1 << 24     # words of a text; a window's position takes the low bits of a long
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RulesConfig:
    """`steps` names each measure's smallest event and what it is a share of; `lower` lists measures bounded from below too."""

    min_words: int = 50
    max_repeat_percent: int = 50
    accuracy: float = 0.01          # relative error of a quantile
    reach: float = 5.0
    prior: int = 200                # texts of weight that a group's language has in its sketch
    steps: tuple = (("word_length", 1, "words"), ("symbols", 1, "chars"), ("dup_lines", 1, "lines"), ("repeats", 6, "words"))
    lower: tuple = ("word_length",)


def _beside(array: Column, key) -> Column:
    """Elements with the same key as the one before or after; `array` must be a column, not an expression."""
    return F.filter(array, lambda p, i: F.coalesce(key(p) == key(F.get(array, i + 1)), F.lit(False))
                    | F.coalesce(key(p) == key(F.get(array, i - 1)), F.lit(False)))


def with_counts(docs: DataFrame, text: str = "text", out: str = "counts") -> DataFrame:
    """`docs` with a struct column `out` of the five counts and the number of lines with a word.

    Words inside 3-word windows found twice: sorting (hash, position) packed
    into one long puts equal windows side by side; 40 bits of the hash sort,
    the whole hash decides. Linear apart from the sort, so long repetitive
    texts cost no more than others. Every array that a lambda looks into is a
    column of its own, else it would be evaluated again for each element.

    Positions have 24 bits: a text of more words stops the job, it is never
    miscounted.
    """
    w, h, p, n, k = fresh(docs, *[f"{out}_{x}" for x in ("words", "windows", "packed", "lines", "likely")])
    low = POSITIONS
    high = F.lit(-low)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low - 1)).cast("int")

    lines = F.filter(F.split(text_of(text), "\n", -1), lambda x: x.rlike(HAS_WORD))
    windows = F.transform(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), x))
    counted = F.when(F.size(w) > POSITIONS, F.raise_error(F.lit(f"a text has more than {POSITIONS} words"))).otherwise(F.col(h))
    packed = F.sort_array(F.transform(counted, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    likely = _beside(F.col(p), lambda x: x.bitwiseAND(high))
    start = F.sort_array(F.transform(_beside(F.col(k), lambda x: F.get(F.col(h), place(x))), place))
    spaced = (docs.withColumn(w, words(text_of(text))).withColumn(n, lines)
              .withColumn(h, windows).withColumn(p, packed).withColumn(k, likely).withColumn(k, start))
    # Each window covers three words, fewer where the next one overlaps it.
    gaps = F.transform(k, lambda x, i: F.least(F.coalesce(F.get(F.col(k), i + 1) - x, F.lit(3)), F.lit(3)))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text_of(text), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g).alias("n_repeat_words"),
        F.size(n).cast("long").alias("n_lines"))
    return computed_once(spaced, **{out: counts}).drop(w, h, p, n, k)


def base_failed(counts: Column, config: RulesConfig) -> Column:
    return (counts["n_words"] < config.min_words) | (
        100 * counts["n_repeat_words"] > config.max_repeat_percent * counts["n_words"])


def measures(counts: Column) -> dict[str, Column]:
    """What the thresholds apply to; 0 where there is nothing to divide by."""
    def share(a: str, b: str) -> Column:
        return F.when(counts[b] > 0, counts[a] / counts[b]).otherwise(F.lit(0.0))

    return {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def sizes(counts: Column) -> dict[str, Column]:
    """What the measures are shares of."""
    return {"words": counts["n_words"], "chars": counts["word_chars"], "lines": counts["n_lines"]}


def sketch(frame: DataFrame, keys: list[str], values: dict[str, Column], accuracy: float) -> DataFrame:
    """Quantile sketches: rows (keys, measure, bucket, n). Bucket null holds the zeros."""
    ratio = (1 + accuracy) / (1 - accuracy)
    tall = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in values.items()]))
    rows = frame.select(*keys, tall.alias("x"))
    bucket = F.when(F.col("x.value") > 0, F.ceil(F.round(F.log(F.col("x.value")) / F.log(F.lit(ratio)), 9)))
    return (rows.select(*keys, F.col("x.measure").alias("measure"), bucket.cast("int").alias("bucket"))
            .groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts add up."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def shrunk(own: DataFrame, wide: DataFrame, keys: list[str], wide_keys: list[str], prior: float) -> DataFrame:
    """Sketches of `own` groups, each with the sketch of the wider group it lies in added at the weight of `prior` texts.

    Rows are (keys, measure, bucket, n), n a weight. The join meets sketches, a
    few thousand rows a group, not texts.
    """
    total = wide.groupBy(*wide_keys, "measure").agg(F.sum("n").alias("total"))
    renamed = {k: f"w_{k}" for k in [*wide_keys, "measure"]}

    def same(left: list[str]) -> Column:
        out = F.col("measure").eqNullSafe(F.col("w_measure"))
        for k in left:
            out &= F.col(k).eqNullSafe(F.col(f"w_{k}"))
        return out

    share = wide.join(total.withColumnsRenamed(renamed), same(wide_keys)).select(
        *[F.col(k).alias(f"w_{k}") for k in wide_keys], F.col("measure").alias("w_measure"), "bucket", (F.lit(prior) * F.col("n") / F.col("total")).alias("n"))
    groups = own.select(*keys, "measure").distinct()
    lent = groups.join(share, same(wide_keys)).select(*keys, "measure", "bucket", "n")
    return merge(own.withColumn("n", F.col("n").cast("double")).unionByName(lent), keys)


def quantiles(sketches: DataFrame, keys: list[str], accuracy: float, at: dict[str, float]) -> DataFrame:
    """(keys, measure, and a column per entry of `at`): the value up to which that share of the weight lies.

    A group's sketch has at most a few thousand buckets, so it fits an array.
    """
    ratio = (1 + accuracy) / (1 - accuracy)
    # One array per group and measure: (bucket, weight) in order, zeros first.
    per = sketches.groupBy(*keys, "measure").agg(
        F.sum("n").alias("total"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("bucket", F.lit(-2**31)).alias("b"), F.col("n").cast("double").alias("n")))).alias("rows"))

    def quantile(q: float) -> Column:
        rank = F.lit(q) * F.col("total") - F.lit(1e-6)
        found = F.aggregate("rows", F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("b")),
                            lambda s, r: F.struct((s["seen"] + r["n"]).alias("seen"),
                                                  F.coalesce(s["b"], F.when(s["seen"] + r["n"] >= rank, r["b"])).alias("b")))["b"]
        return F.when(found == -2**31, F.lit(0.0)).otherwise(2 * F.pow(F.lit(ratio), found) / (ratio + 1))

    return per.select(*keys, "measure", *[quantile(q).alias(name) for name, q in at.items()])


def fences(sketches: DataFrame, keys: list[str], config: RulesConfig) -> DataFrame:
    """One row per group with `low_<m>` and `high_<m>` of each measure."""
    q = quantiles(sketches, keys, config.accuracy, {"q1": 0.25, "q2": 0.5, "q3": 0.75})

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    bounds = []
    for m, event, size in config.steps:
        spread = config.reach * F.greatest(of(m, "q3") - of(m, "q1"), F.lit(float(event)) / of(size, "q2"))
        bounds += [(of(m, "q1") - spread).alias(f"low_{m}"), (of(m, "q3") + spread).alias(f"high_{m}")]
    return q.groupBy(*keys).agg(*bounds)


def learn(counted: DataFrame, config: RulesConfig = RulesConfig(), counts: str = "counts",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """Bounds for every (lang, source) that occurs, from its own texts, its language's and all.

    Texts that fail the base rules are not learned from.
    """
    c, keys = F.col(counts), ["k_lang", "k_source"]
    good = counted.where(~base_failed(c, config)).select(F.col(lang).alias("k_lang"), F.col(source).alias("k_source"), c.alias("c"))
    fine = stage(sketch(good, keys, measures(F.col("c")) | sizes(F.col("c")), config.accuracy), "quality-sketches")
    by_lang = shrunk(merge(fine, ["k_lang"]), merge(fine, []), ["k_lang"], [], config.prior)
    return stage(fences(shrunk(fine, by_lang, keys, ["k_lang"], config.prior), keys, config), "quality-bounds")


def verdict(counted: DataFrame, bounds: DataFrame, out: str, config: RulesConfig = RulesConfig(),
            counts: str = "counts", lang: str = "lang", source: str = "source") -> DataFrame:
    """`counted` with boolean `out`: base rules passed and every measure inside its bounds.

    A text whose group has no bounds (all its texts fail the base rules) is
    judged by the base rules alone.
    """
    renamed = dict(zip(bounds.columns, fresh(counted, *bounds.columns)))
    b = bounds.withColumnsRenamed(renamed)
    inside = F.lit(True)
    for name, value in measures(F.col(counts)).items():
        if f"high_{name}" not in renamed:
            continue
        inside &= F.coalesce(value <= F.col(renamed[f"high_{name}"]), F.lit(True))
        if name in config.lower:
            inside &= F.coalesce(value >= F.col(renamed[f"low_{name}"]), F.lit(True))
    joined = counted.join(b, F.col(lang).eqNullSafe(F.col(renamed["k_lang"])) & F.col(source).eqNullSafe(F.col(renamed["k_source"])), "left")
    return joined.withColumn(out, ~base_failed(F.col(counts), config) & inside).drop(*b.columns)


def keep_good(docs: DataFrame, config: RulesConfig = RulesConfig()) -> DataFrame:
    """The documents that pass, with their own columns only."""
    counts, kept = fresh(docs, "counts", "kept")
    bounds = learn(with_counts(docs.select("text", "lang", "source")), config)
    judged = verdict(with_counts(docs, out=counts), bounds, kept, config, counts)
    return judged.where(F.col(kept)).select(*docs.columns)
