"""Phrase collocation mining after Toivonen: a sample proposes phrases, full passes count them and their border exactly.

1. One document in `sample`, chosen by a hash of id and text, is mined for words
   and word pairs seen `lowered` times there: a lower bound than the sample's
   share of `least`, so that few frequent phrases are missed.
2. A full pass counts, exactly, every proposed phrase and the negative border:
   every phrase that isn't proposed though all its parts one word shorter are. As
   a pass meets border phrases where they stand in the texts, the rule is "count a
   phrase when its parts are proposed", and no pairs of words are listed.
3. Phrases of the border found frequent are failures of the sample. They join
   the proposal, and a further full pass counts the phrases whose parts are
   proposed now and weren't before. Passes go on until none fails: one for words
   and one more per length, at most.
4. Where fewer phrases failed than were proposed, that further pass is the last:
   it takes the phrases it counts for proposed ones and so counts what they stand
   in as well. Otherwise that would be too many, and lengths take a pass each.

Every phrase is counted in one pass alone, by all its occurrences, so counts are
exact whatever the sample was. Tasks sum up runs of `FLUSH` words before the
shuffle; its key is (language, phrase), so a hot word or language is summed on
the way.

The proposal goes to the tasks as a Bloom filter of `bits` bits, its size fixed
whatever the data; a phrase's bits lie in one word of it. A false positive counts one phrase more, exactly; it can't
change a result. Where the proposal outgrows the filter, passes count more.

Words: A-Z lowered, pieces cut at `[.,;:!?\\x0A-\\x0D]`, words are runs without
space or tab. Defined results: a null text is empty; a null language is `und`;
null and repeated ids and repeated rows count like any others; a language
without a candidate has no row; an empty table gives an empty result. Scores
are exact decimals of 38 digits: counts up to 10^15 fit, beyond it the job
fails and doesn't round.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from mediarec.operators.staging import stage

FLUSH = 500_000
_SCORE = 1_000_000
_BUCKETS = 64           # a language is cut down to its first rows per bucket before it is ranked as a whole
_FIELDS = "lang string, phrase string, size int, known boolean, n bigint"

# A-Z lowered, piece ends as line feeds, tabs as spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


@dataclass(frozen=True)
class MiningConfig:
    longest: int = 3        # words of a phrase
    least: int = 10         # occurrences of a candidate
    cover: int = 50         # percent of a phrase's occurrences inside a longer one that drop it
    top: int = 2000
    sample: int = 8
    lowered: int = 2
    bits: int = 1 << 27


class Filter:
    """A Bloom filter over 64-bit hashes, three bits each in one word: a look-up reads one place."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    def _bits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word of each hash and its bits there."""
        h = _mixed(hashes)
        bits = np.uint64(1) << (h >> np.uint64(58))
        bits |= np.uint64(1) << (h >> np.uint64(52) & np.uint64(63))
        bits |= np.uint64(1) << (h >> np.uint64(46) & np.uint64(63))
        return ((h & self.mask) >> np.uint64(6)).astype(np.int64), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slots, bits = self._bits(hashes)
        return (self.words[slots] & bits) == bits

    def set_bits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, words) that hold the bits of `hashes`."""
        slots, bits = self._bits(hashes)
        unique, at = np.unique(slots, return_inverse=True)
        words = np.zeros(len(unique), np.uint64)
        np.bitwise_or.at(words, at, bits)
        return unique, words


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers (the finalizer of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its beginning and its last word."""
    return _mixed(left * np.uint64(3) + right)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class _Run:
    """Words of one language as numbers from 2, 1 between pieces and 0 for nothing."""

    def __init__(self):
        self.ids, self.vocabulary = array("i"), _Ids({b"": 0, b"\n": 1})

    def add(self, text: bytes) -> int:
        before = len(self.ids)
        parts = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        self.ids.extend(map(self.vocabulary.__getitem__, parts))
        self.ids.append(1)
        return len(self.ids) - before

    def words(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and the numbers of all words into them, -1 between pieces."""
        ids = np.frombuffer(self.ids, np.int32).astype(np.int64)
        ids = ids[ids > 0] - 2
        return list(self.vocabulary)[2:], ids


def _grams(lang: str, words: list[bytes], ids: np.ndarray, longest: int, old: Filter | None, new: Filter | None,
           ahead: bool = False) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(word numbers of each distinct phrase, its length, known, occurrences) that this pass counts.

    A phrase is counted when its parts are in `new` and not all in `old`.
    Without `new` (in the sample) all are. `ahead`: what is counted passes for one of `new`.
    """
    size = len(words)
    if not size:
        return
    hashes = _word_hashes(lang, words)
    everywhere = np.ones(size, bool)
    in_new = new.has(hashes) if new else everywhere
    in_old = old.has(hashes) if old else ~everywhere
    if old is None:
        yield np.arange(size)[:, None], 1, in_new if new else everywhere, np.bincount(ids[ids >= 0], minlength=size)
    # Per position: the phrase of the length before that starts there, whether it stands in a piece, its hash and membership.
    valid = ids >= 0
    at = np.where(valid, ids, 0)
    code, hashed, new_here, old_here = at, hashes[at], in_new[at] & valid, in_old[at] & valid
    for length in range(2, longest + 1):
        if len(ids) < length:
            return
        parts_new = new_here[:-1] & new_here[1:]
        counted = parts_new & ~(old_here[:-1] & old_here[1:])
        n = len(parts_new)
        last = at[length - 1:length - 1 + n]
        hashed = _joined(hashed[:n], hashes[last])
        if length == longest:
            # Proposals are shorter: nothing asks whether the longest phrases are known.
            new_here = np.zeros(n, bool)
        elif new is None:
            new_here, old_here = parts_new, np.zeros(n, bool)
        else:
            new_here = parts_new.copy()
            new_here[parts_new] = new.has(hashed[parts_new])
            if ahead:
                new_here |= counted
            old_here = old_here[:-1] & old_here[1:]
            if old is not None:
                old_here[old_here] = old.has(hashed[old_here])
        places = np.flatnonzero(counted)
        if len(places):
            # Numbers of up to three words fit 64 bits: a run has at most FLUSH words and those of one text.
            key = np.stack([at[places + i] for i in range(length)], 1)
            flat = reduce(lambda a, i: a * size + key[:, i], range(1, length), key[:, 0])
            if size ** length < 2 ** 62:
                order = np.argsort(flat)
                flat = flat[order]
                first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            else:
                order = np.lexsort(key.T[::-1])
                first = np.flatnonzero(np.r_[True, (key[order[1:]] != key[order[:-1]]).any(1)])
            one = order[first]
            yield key[one], length, new_here[places[one]], np.diff(np.r_[first, len(key)])


def _flushed(runs: dict[str, _Run], longest: int, old: Filter | None, new: Filter | None, ahead: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for lang, run in runs.items():
        words, ids = run.words()
        written = pa.array(words, pa.binary()).cast(pa.string())
        for key, length, known, n in _grams(lang, words, ids, longest, old, new, ahead):
            phrase = pc.binary_join_element_wise(*[written.take(pa.array(key[:, i])) for i in range(length)], " ") if length > 1 else written.take(pa.array(key[:, 0]))
            for lo in range(0, len(n), 100_000):
                part = phrase.slice(lo, 100_000)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(lang), len(part)), part, pa.array(np.full(len(part), length, np.int32)),
                    pa.array(known[lo:lo + 100_000]), pa.array(n[lo:lo + 100_000].astype(np.int64))], names=names)
        if old is None:  # all words of the language, as the phrase of none
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([True]),
                                              pa.array([int((ids >= 0).sum())], pa.int64())], names=names)


def _counting(longest: int, old, new, flush: int, ahead: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if x is None else Filter(*x.value) for x in (old, new)]
        runs: dict[str, _Run] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                held += runs.setdefault(lang, _Run()).add(text.as_py())
                if held >= flush:
                    yield from _flushed(runs, longest, *filters, ahead)
                    runs, held = {}, 0
        yield from _flushed(runs, longest, *filters, ahead)
    return run


def _counted(docs: DataFrame, longest: int, least: int, old, new, flush: int, ahead: bool = False) -> DataFrame:
    """Phrases this pass counts that occur `least` times, and the words of each language; staged."""
    partial = docs.mapInArrow(_counting(longest, old, new, flush, ahead), _FIELDS)
    # Tasks have summed up their runs, so sums wait for the shuffle. `known` follows from the phrase: it is the same in all tasks.
    return stage(partial.repartition("lang", "phrase").groupBy("lang", "phrase", "size", "known").agg(F.sum("n").alias("n"))
                 .where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")


def _added(words: np.ndarray, bits: int, phrases: DataFrame) -> np.ndarray:
    """The filter's words with the bits of `phrases` (lang, phrase) set; what comes to the driver is bounded by the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Filter(bits)
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
                parts = _word_hashes(lang, phrase.split(b" "))
                found.append(reduce(lambda a, i: _joined(a, parts[i:i + 1]), range(1, len(parts)), parts[:1]))
            if found:
                slots, own = empty.set_bits(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(own.view(np.int64))], names=["slot", "bits"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = words.copy()
    words[got.column("slot").to_numpy()] |= got.column("bits").to_numpy().view(np.uint64)
    return words


def frequent_phrases(docs: DataFrame, config: MiningConfig = MiningConfig(), flush: int = FLUSH) -> tuple[DataFrame, int]:
    """(`lang`, `phrase`, `size`, `n`) of all phrases of up to `longest` words occurring `least` times, and the full passes made.

    `docs` has doc_id, text and lang. The phrase of size 0 counts all words of a language.
    """
    spark = docs.sparkSession
    sampled = F.pmod(F.xxhash64("doc_id", "text"), F.lit(config.sample)) == 0
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    sample = _counted(texts.where(sampled).select("lang", "text"), config.longest - 1, config.lowered, None, None, flush)
    proposed = sample.where("size > 0")
    size, words = proposed.count(), _added(Filter(config.bits).words, config.bits, proposed)
    old, passes, ahead, tables = None, 0, False, []
    while True:
        new = spark.sparkContext.broadcast((config.bits, words))
        counted = _counted(texts.select("lang", "text"), config.longest, config.least, old, new, flush, ahead)
        if old is not None:
            old.unpersist()
        tables.append(counted.drop("known"))
        passes += 1
        failed = counted.where(~F.col("known") & (F.col("size") < config.longest))
        failures = failed.count()
        if not failures:
            new.unpersist()
            return reduce(DataFrame.unionByName, tables), passes
        ahead, size = failures < size, size + failures
        words, old = _added(words, config.bits, failed), new


def _part(words, start: int, n) -> object:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, config: MiningConfig = MiningConfig(), flush: int = FLUSH) -> DataFrame:
    """The first `top` phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    frequent, _ = frequent_phrases(docs, config, flush)
    words = F.split("phrase", " ")
    counts = frequent.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    candidates = frequent.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))

    cuts = candidates.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(words, 1, F.col("k")).alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = [F.col(c).cast("decimal(19,0)").alias(c) for c in ("a", "l", "r")]
    cuts = cuts.select("lang", "phrase", "k", F.col("l").alias("_l"), F.col("r").alias("_r"), *exact).withColumn(
        "score", F.expr(f"(a * a * cast({_SCORE} as decimal(7,0))) div (l * r)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", F.col("_l").alias("l"), F.col("_r").alias("r"))).alias("cut"))

    # Every shorter phrase of two words or more inside a candidate, with the most that any holds of it.
    inside = candidates.where("size > 2").select("lang", "a", words.alias("w"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(
            F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.struct(i.alias("i"), s.alias("s")))))).alias("at"))
    covered = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at.i"), F.col("at.s")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * config.cover)).drop("most", "size")

    ranked = kept.join(scored, ["lang", "phrase"]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_BUCKETS))).orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= config.top)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= config.top)
    # One row per language.
    total = frequent.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(config: MiningConfig = MiningConfig()) -> str:
    """DuckDB SQL of `collocations`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(
        f"SELECT lang, {s} AS size, unnest(list_transform(range(1, len(w) - {s - 2}), lambda i: array_to_string(w[i:i + {s - 1}], ' '))) AS phrase FROM words"
        for s in range(1, config.longest + 1))
    return f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
        freq AS (SELECT lang, size, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {config.least}),
        cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size > 1),
        cuts AS (SELECT c.lang, phrase, k, a, w, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
          FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c),
        scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (CAST({_SCORE} AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
          FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = p JOIN freq y ON y.lang = c.lang AND y.phrase = q),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        covered AS (SELECT lang, phrase, max(a) AS most FROM (
          SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE size = 3) GROUP BY 1, 2)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM best JOIN total USING (lang) LEFT JOIN covered USING (lang, phrase)
        WHERE most IS NULL OR 100 * most < {config.cover} * a
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {config.top}"""
