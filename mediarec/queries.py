"""Registered queries: one per operator, each over its whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mediarec import fixtures as X
from mediarec.config import SPLITS, AlsConfig, CoreConfig, FusionConfig, SplitConfig, StaticConfig
from mediarec.functions.labels import label_index
from mediarec.functions.signal import frame_rows, frame_sequence, mean_square, power_normalize, scale_power, signal_power
from mediarec.functions.text import clean_text, item_text
from mediarec.functions.vectors import concat_modalities, cosine, l2_normalize, parse_floats
from mediarec.operators import (
    degrees, exports, factorization, features, filters, fusion, indexing, metadata, ranking, retrieval, splitting)
from mediarec.operators.staging import drop_table, fresh_path, stage
from mediarec.plans import evaluate as evaluate_plan, factorize as factorize_plan, prepare as prepare_plan
from mediarec.sources import readers, sinks
from mediarec.sources.listing import file_inventory

Query = Callable[[SparkSession, str], DataFrame]

CORE = CoreConfig(min_per_user=9, min_per_item=7)
SPLIT = SplitConfig(cap=200)
STATIC = StaticConfig()
MODALITIES = ["vision", "audio", "lyrics", "genres"]
# Published rank, rounds and penalty; blocks only spread the work, and here they fit few cores.
IMPLICIT, EXPLICIT = AlsConfig.implicit_feedback(blocks=8), AlsConfig.explicit_feedback(blocks=8)

_REGISTRY: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _flat(df: DataFrame) -> DataFrame:
    """Engine-neutral output: dates as text, integers as long, doubles to 6 digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _shown(df: DataFrame) -> DataFrame:
    """As `_flat`, with a visible mark for a missing user."""
    return _flat(df.withColumn("id_no", F.coalesce("id_no", F.lit("(none)"))))


def _elements(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """One row per vector element: (keys.., `dim`, `val`)."""
    return _flat(df.select(*keys, F.posexplode(vec).alias("dim", "val")))


def _clean(spark, sf):
    return filters.clean_log(X.log(spark, sf), STATIC)


def _known(spark, sf):
    return filters.keep_items(_clean(spark, sf), X.meta(spark, sf))


def _split(spark, sf):
    return splitting.assign_splits(_known(spark, sf), SPLIT)


# Cleaning -------------------------------------------------------------------

@_query
def project_log(spark, sf):
    return _shown(filters.project_log(X.log(spark, sf)))


@_query
def drop_fraud(spark, sf):
    return _shown(filters.drop_fraud(X.log(spark, sf)))


@_query
def drop_live(spark, sf):
    return _shown(filters.drop_live(X.log(spark, sf)))


@_query
def require_key(spark, sf):
    return _flat(filters.require_key(X.log(spark, sf), "id_no"))


@_query
def with_score(spark, sf):
    df = filters.with_score(X.log(spark, sf))
    return _shown(df.withColumn("score", F.coalesce("score", F.lit(-1.0))))


@_query
def watch_time_between(spark, sf):
    return _shown(filters.watch_time_between(X.log(spark, sf), STATIC.min_watch, STATIC.max_watch))


@_query
def min_score(spark, sf):
    return _shown(filters.min_score(filters.with_score(X.log(spark, sf)), STATIC.min_score))


@_query
def static_filter(spark, sf):
    return _flat(filters.static_filter(X.log(spark, sf), X.meta(spark, sf), STATIC))


@_query
def filter_funnel(spark, sf):
    return _flat(filters.filter_funnel(X.log(spark, sf), X.meta(spark, sf), STATIC))


@_query
def common_items(spark, sf):
    return filters.common_items(_clean(spark, sf), X.meta(spark, sf))


@_query
def keep_items(spark, sf):
    return _flat(_known(spark, sf))


@_query
def where_category(spark, sf):
    return filters.where_category(X.meta(spark, sf), "NEWS", "SPORT")


# Degrees and pruning ----------------------------------------------------------

@_query
def pair_counts(spark, sf):
    return _flat(degrees.pair_counts(_clean(spark, sf)))


@_query
def with_degree(spark, sf):
    return _flat(degrees.with_degree(_known(spark, sf)))


@_query
def core_filter_5(spark, sf):
    return _flat(degrees.core_filter(_known(spark, sf), CORE.min_per_user, CORE.min_per_item, 5))


@_query
def core_filter_fixpoint(spark, sf):
    return _flat(degrees.core_filter(_known(spark, sf), CORE.min_per_user, CORE.min_per_item, None))


# Summaries --------------------------------------------------------------------

@_query
def view_counts(spark, sf):
    return _flat(metadata.view_counts(_known(spark, sf), "media_id"))


@_query
def view_counts_user(spark, sf):
    return _flat(metadata.view_counts(_known(spark, sf), "id_no"))


@_query
def item_meta(spark, sf):
    return _flat(metadata.item_meta(_clean(spark, sf), X.meta(spark, sf)))


@_query
def user_meta(spark, sf):
    return _flat(metadata.user_meta(_known(spark, sf)))


@_query
def summary(spark, sf):
    return _flat(metadata.summary(_known(spark, sf)))


@_query
def category_summary(spark, sf):
    return _flat(metadata.category_summary(X.meta(spark, sf)))


@_query
def distinct_ids(spark, sf):
    return metadata.distinct_ids(X.log(spark, sf), "id_no")


# Balance and split --------------------------------------------------------------

@_query
def balance_by_category(spark, sf):
    return splitting.balance_by_category(X.meta(spark, sf), cap=100)


@_query
def item_first_seen(spark, sf):
    return _flat(splitting.item_first_seen(_known(spark, sf)))


def _days(spark, sf):
    return splitting.items_per_day(splitting.item_first_seen(_known(spark, sf)))


@_query
def items_per_day(spark, sf):
    return _flat(_days(spark, sf))


@_query
def cumulative_ratio(spark, sf):
    return _flat(splitting.cumulative_ratio(_days(spark, sf)))


@_query
def cumulative_ratio_literal(spark, sf):
    return _flat(splitting.cumulative_ratio(_days(spark, sf), total=50_000))


@_query
def temporal_split(spark, sf):
    return _flat(splitting.temporal_split(splitting.cumulative_ratio(_days(spark, sf))))


@_query
def warm_split(spark, sf):
    return _flat(splitting.warm_split(_days(spark, sf), SPLIT.seed))


@_query
def assign_splits(spark, sf):
    return _flat(_split(spark, sf))


@_query
def where_split_warm(spark, sf):
    return _flat(filters.where_split(_split(spark, sf), "test", "w"))


@_query
def where_split_cold(spark, sf):
    return _flat(filters.where_split(_split(spark, sf), "test", "c"))


@_query
def prepare_dataset(spark, sf):
    """Cleaned, pruned, balanced, complete in modalities, and split: row level."""
    p = prepare_plan.prepare(X.log(spark, sf), X.meta(spark, sf), CORE, SPLIT, STATIC, X.inventory(spark, sf))
    return _flat(p.log)


def _prepared(spark, sf):
    return prepare_plan.prepare(X.log(spark, sf), X.meta(spark, sf), CORE, SPLIT, STATIC, X.inventory(spark, sf))


@_query
def core_log(spark, sf):
    """The static job's result: cleaned, catalogued, pruned log rows."""
    return _flat(prepare_plan.core_log(X.log(spark, sf), X.meta(spark, sf), CORE, STATIC))


@_query
def prepare_item_table(spark, sf):
    """Balanced items with count, category, first date, split and whether their files are complete."""
    return _flat(_prepared(spark, sf).items)


@_query
def prepare_item_meta(spark, sf):
    """The prepared catalogue with views and mean watch time."""
    return _flat(_prepared(spark, sf).item_meta)


@_query
def prepare_slices(spark, sf):
    return _flat(_prepared(spark, sf).slices)


@_query
def prepare_manifest(spark, sf):
    return _prepared(spark, sf).manifest


@_query
def prepare_user_meta(spark, sf):
    return _flat(_prepared(spark, sf).users)


@_query
def split_summary(spark, sf):
    """Rows, items and users of each split of the prepared data set."""
    rows, _ = prepare_plan.balanced_log(X.log(spark, sf), X.meta(spark, sf), CORE, SPLIT, STATIC)
    return _flat(rows.groupBy("split", "wc_split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("media_id").alias("items"),
        F.countDistinct("id_no").alias("users")))


# Exports ------------------------------------------------------------------------

@_query
def export_slices(spark, sf):
    return _flat(exports.export_slices(_split(spark, sf), X.meta(spark, sf)))


@_query
def split_manifest(spark, sf):
    return exports.split_manifest(_split(spark, sf))


@_query
def user_histories(spark, sf):
    df = exports.user_histories(_known(spark, sf), max_items=8)
    return _flat(df.select("id_no", "part", F.array_join("items", ",").alias("items"),
                           F.array_join(F.col("views").cast("array<string>"), ",").alias("views")))


@_query
def require_modalities(spark, sf):
    return exports.require_modalities(X.meta(spark, sf), X.inventory(spark, sf), ["vision", "audio"])


@_query
def pending_items(spark, sf):
    files = X.inventory(spark, sf)
    catalog = X.meta(spark, sf).select(F.col("media_id").alias("id"))
    return features.pending_items(catalog, files.where(F.col("modality") == "vision"))


# Ids and factors ------------------------------------------------------------------

@_query
def build_index(spark, sf):
    return _flat(indexing.build_index(_clean(spark, sf), "id_no"))


@_query
def encode_ids(spark, sf):
    index = indexing.build_index(X.meta(spark, sf).select(F.substring("media_id", 2, 20).alias("id")), "id")
    return _flat(indexing.encode_ids(X.counts(spark, sf), index, "track_id", "left").withColumn(
        "track_id", F.coalesce("track_id", F.lit(-1))))


@_query
def label_of_category(spark, sf):
    return X.meta(spark, sf).select("media_id", label_index(F.col("channel_category")).cast("long").alias("label"))


@_query
def daily_scores(spark, sf):
    return _flat(factorization.daily_scores(_split(spark, sf), "train"))


@_query
def pair_scores(spark, sf):
    return _flat(factorization.daily_scores(_split(spark, sf), "train", per_day=False))


@_query
def index_interactions(spark, sf):
    scores = stage(factorization.daily_scores(_known(spark, sf)), "scores")
    return _flat(indexing.index_interactions(
        scores, indexing.build_index(scores, "id_no"), indexing.build_index(scores, "media_id")))


@_query
def als_implicit(spark, sf):
    out = factorize_plan.factorize(_split(spark, sf), IMPLICIT, "train")
    return _elements(out.users, "vec", "id")


@_query
def als_residual(spark, sf):
    """Whether every user's factor solves its normal equations, to the precision of the stored factors."""
    out = factorize_plan.factorize(_split(spark, sf), IMPLICIT, "train")
    found = factorize_plan.user_residuals(out, IMPLICIT)
    return _flat(found.select("id", "n", (F.col("residual") < 1e-3).alias("solved")))


@_query
def als_splits(spark, sf):
    """One model per split: the items and users each has factors of."""
    parts = []
    for split, out in factorize_plan.factorize_splits(_split(spark, sf), IMPLICIT).items():
        for side, table in (("user", out.users), ("item", out.items)):
            parts.append(table.select(F.lit(split).alias("split"), F.lit(side).alias("side"), "id", F.size("vec").cast("long").alias("n")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _track_counts(spark, sf):
    """Counts as read from a file, some malformed, and a dictionary of the catalogue's tracks."""
    index = indexing.build_index(X.meta(spark, sf).select(F.concat(F.lit("t"), F.substring("media_id", 2, 20)).alias("id")), "id")
    return readers.read_counts(spark, _counts_file(spark, sf)), index


@_query
def als_explicit(spark, sf):
    counts = stage(X.counts(spark, sf), "counts")
    model, _, _ = factorize_plan.factorize_counts(counts, indexing.build_index(counts, "track_id"), EXPLICIT, staged=True)
    return _elements(model.userFactors, "features", "id")


@_query
def als_counts(spark, sf):
    """What became of the rows of a counts file on the way to the explicit model."""
    _, _, seen = factorize_plan.factorize_counts(*_track_counts(spark, sf), EXPLICIT)
    return spark.createDataFrame([seen])


@_query
def als_explicit_residual(spark, sf):
    counts, index = _track_counts(spark, sf)
    model, ratings, _ = factorize_plan.factorize_counts(counts, index, EXPLICIT)
    found = factorization.normal_residual(model, ratings, EXPLICIT, "user", "user_id", "track_id", "count")
    return _flat(found.select("id", "n", (F.col("residual") < 1e-3).alias("solved")))


@_query
def als_saved(spark, sf):
    """A model written and loaded: sizes, and whether factors are the same, of every user and item."""
    counts = stage(X.counts(spark, sf), "counts")
    model, ratings, _ = factorize_plan.factorize_counts(counts, indexing.build_index(counts, "track_id"), EXPLICIT, staged=True)
    drop_table(ratings)
    path = fresh_path(spark, "als-model")
    sinks.save_als(model, path)
    back = sinks.load_als(path)
    parts = []
    # Whole vectors are compared by digests of all their numbers; they aren't shuffled for it.
    digest = F.unhex(F.sha2(F.col("features").cast("string"), 256))
    for side, ours, theirs in (("user", model.userFactors, back.userFactors), ("item", model.itemFactors, back.itemFactors)):
        both = ours.select("id", F.size("features").cast("long").alias("n"), digest.alias("first")).join(
            theirs.select("id", digest.alias("again")), "id", "full")
        parts.append(both.select(F.lit(side).alias("side"), "id", "n", (F.col("first") == F.col("again")).alias("same")))
    return _flat(parts[0].unionByName(parts[1]))


@_query
def factor_table(spark, sf):
    out = factorize_plan.factorize(_known(spark, sf), IMPLICIT)
    return out.items.select("id", F.size("vec").cast("long").alias("n"))


# Text and vectors -----------------------------------------------------------------

@_query
def item_texts(spark, sf):
    return X.texts(spark, sf).select("doc_id", item_text(F.col("title"), F.col("net_res_list")).alias("text"))


@_query
def clean_texts(spark, sf):
    return X.texts(spark, sf).select(
        "doc_id", clean_text(item_text(F.col("title"), F.col("net_res_list"))).alias("text"))


@_query
def normalized_vectors(spark, sf):
    return _elements(X.vectors(spark, sf).select("id", l2_normalize(F.col("vec")).alias("vec")), "vec", "id")


@_query
def cosine_neighbours(spark, sf):
    a = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = X.table(spark, sf, "embeddings").select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return _flat(a.join(b, "vec_id").select("vec_id", cosine(F.col("a"), F.col("b")).alias("cosine")))


def _assembled(spark, sf, ids=None):
    return features.assemble_modalities(X.features(spark, sf), X.planted_factors(spark, sf), ids, MODALITIES)


def _labelled(spark, sf, name):
    return X.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias(name))


@_query
def assemble_modalities(spark, sf):
    rows, _ = _assembled(spark, sf, _labelled(spark, sf, "id"))
    return _elements(rows.withColumn("vec", F.concat(*MODALITIES, "cf")), "vec", "item_id")


@_query
def assemble_modalities_counts(spark, sf):
    return _flat(_assembled(spark, sf, _labelled(spark, sf, "id"))[1])


@_query
def concat_modality_vectors(spark, sf):
    rows, _ = _assembled(spark, sf)
    vec = concat_modalities("gva", FusionConfig().columns)
    return _elements(rows.select("item_id", vec.alias("vec")), "vec", "item_id")


@_query
def lookup_vectors(spark, sf):
    return _elements(features.lookup_vectors(_labelled(spark, sf, "id"), X.vectors(spark, sf))[0], "vec", "id")


@_query
def lookup_vectors_counts(spark, sf):
    return _flat(features.lookup_vectors(_labelled(spark, sf, "id"), X.vectors(spark, sf))[1])


@_query
def select_targets(spark, sf):
    kept, _ = features.select_targets(X.features(spark, sf), _labelled(spark, sf, "item_id"))
    return _elements(kept, "vec", "item_id", "modality")


@_query
def select_targets_counts(spark, sf):
    return _flat(features.select_targets(X.features(spark, sf), _labelled(spark, sf, "item_id"))[1])


@_query
def pool_segments(spark, sf):
    return _elements(features.pool_segments(X.sequences(spark, sf), "item_id", "pos", "vec"), "vec",
                     "item_id", "segment")


@_query
def pool_mean(spark, sf):
    return _elements(features.pool_mean(X.sequences(spark, sf), "item_id", "vec"), "vec", "item_id")


@_query
def frame_signal(spark, sf):
    """Two channels of 32 samples averaged, cut into 4 frames of 10 (the last one padded)."""
    clips = X.vectors(spark, sf).select("id", F.slice("vec", 1, 32).alias("l"), F.slice("vec", 33, 32).alias("r"))
    return _elements(frame_sequence(clips, "id", ["l", "r"], 4, 10), "samples", "id", "frame")


@_query
def frame_signal_rows(spark, sf):
    """64 samples in rows, cut into 7 frames of 10 (the last one padded)."""
    rows = X.vectors(spark, sf).select("id", F.posexplode("vec").alias("pos", "x"))
    return _elements(frame_rows(rows, "id", "pos", "x", 7, 10), "samples", "id", "frame")


@_query
def clip_power(spark, sf):
    return _flat(signal_power(X.signal(spark, sf), "clip_id", "x"))


@_query
def clip_power_normalized(spark, sf):
    return _flat(power_normalize(X.signal(spark, sf), "clip_id", "x"))


@_query
def array_power(spark, sf):
    scaled = scale_power(F.col("vec"), 2.0)
    return _elements(X.vectors(spark, sf).select("id", mean_square(F.col("vec")).alias("power"), scaled.alias("vec")),
                     "vec", "id", "power")


# Retrieval and metrics --------------------------------------------------------------

@_query
def topk_similar(spark, sf):
    vec = X.vectors(spark, sf)
    return _flat(retrieval.topk_similar(
        vec.select(F.col("id").alias("id_no"), "vec"), vec.select(F.col("id").alias("media_id"), "vec"), 10))


def _truth_and_prediction(spark, sf):
    """Cleaned views as truth; the whole raw log, rated by watch time, as prediction."""
    raw = filters.require_key(X.log(spark, sf))
    pred = raw.groupBy("id_no", "media_id").agg(F.max("watch_time").cast("double").alias("rating"))
    return _known(spark, sf), pred


@_query
def per_user_metrics(spark, sf):
    return _flat(ranking.per_user_metrics(*_truth_and_prediction(spark, sf), 10))


@_query
def ranking_metrics(spark, sf):
    return _flat(ranking.ranking_metrics(*_truth_and_prediction(spark, sf), 10))


@_query
def ranking_metrics_copies(spark, sf):
    """Every log row a relevant record of its own."""
    return _flat(ranking.ranking_metrics(*_truth_and_prediction(spark, sf), 10, dedupe=False,
                                         map_denominator="min"))


def _slices(spark, sf):
    log = stage(_split(spark, sf).select("media_id", "id_no", "score", "split", "wc_split"), "split-log")
    slices = stage(exports.export_slices(log, X.meta(spark, sf)), "slices")
    users = X.id_vectors(metadata.distinct_ids(log, "id_no"), "id_no", 0)
    items = X.id_vectors(metadata.distinct_ids(log, "media_id"), "media_id", 1)
    return slices, users, items


@_query
def evaluate_slices(spark, sf):
    """The test slices, as the reference job evaluates them."""
    return _flat(ranking.evaluate_slices(*_slices(spark, sf), 10))


@_query
def evaluate_all_slices(spark, sf):
    return _flat(ranking.evaluate_slices(*_slices(spark, sf), 10, splits=None))


# Regression ---------------------------------------------------------------------------

def _train_valid(spark, sf):
    rows, _ = _assembled(spark, sf)
    rows = stage(rows, "assembled")
    held = F.element_at("genres", 9) + F.element_at("genres", 10) > 0
    return rows, rows.where(~held), rows.where(held)


@_query
def fit_fusion_ridge(spark, sf):
    _, train, valid = _train_valid(spark, sf)
    return _flat(fusion.fit_fusion(train, valid, FusionConfig(modality="vat", solver="ridge")).history(spark))


@_query
def score_fusion(spark, sf):
    rows, train, valid = _train_valid(spark, sf)
    model = fusion.fit_fusion(train, valid, FusionConfig(modality="vat", solver="ridge"))
    both = fusion.score_fusion(rows, model).join(rows.select("item_id", "cf"), "item_id")
    found = both.select("item_id", F.posexplode(F.arrays_zip("vec", "cf")).alias("dim", "pair"))
    return _flat(found.select("item_id", "dim", F.col("pair.cf").alias("planted"), (F.abs(F.col("pair.vec") - F.col("pair.cf")) < 1e-4).alias("recovered")))


@_query
def evaluate_content(spark, sf):
    """End to end: assemble content, fit the map on train and valid items, score all items, rank and measure the test slices."""
    def item(col):
        return F.concat(F.lit("m"), col)

    slices, users, _ = _slices(spark, sf)
    feats = X.features(spark, sf).withColumn("item_id", item("item_id"))
    factors = X.planted_factors(spark, sf).withColumn("id", item("id"))
    ids = {s: slices.where(F.col("slice") == f"{s}/total").select(F.col("media_id").alias("id")) for s in ("train", "valid")}
    cfg = FusionConfig(modality="vat", solver="ridge")
    model, _ = evaluate_plan.train_fusion(feats, factors, ids["train"], ids["valid"], cfg)
    rows, _ = features.assemble_modalities(feats, factors, None, MODALITIES[:3])
    return _flat(evaluate_plan.evaluate(slices, users, rows, model))


@_query
def ablation(spark, sf):
    _, train, valid = _train_valid(spark, sf)
    return _flat(fusion.ablation(train, valid, FusionConfig(solver="ridge")))


@_query
def ablation_exact(spark, sf):
    """Which modality subsets hold all that the planted map reads."""
    _, train, valid = _train_valid(spark, sf)
    found = fusion.ablation(train, valid, FusionConfig(solver="ridge"))
    return found.select("modality", ((F.col("train_loss") < 1e-6) & (F.col("valid_loss") < 1e-6)).alias("exact"))


# Sources and sinks: whole tables written in the stored format and read back ---------------

@_query
def source_log(spark, sf):
    path = fresh_path(spark, "log")
    sinks.write_stage(X.log(spark, sf).withColumn("watch_time", F.col("watch_time").cast("string")), path)
    return _shown(readers.read_log(spark, path))


def _counts_file(spark, sf):
    """Tab-separated counts, bz2; every seventh line number has a count that is no number."""
    path = fresh_path(spark, "counts")
    item = X.table(spark, sf, "lineitem")
    count = F.when(F.col("l_linenumber") == 7, "many").otherwise(F.col("l_quantity").cast("long").cast("string"))
    item.select(F.col("l_orderkey").alias("user_id"), F.concat(F.lit("t"), "l_partkey").alias("track_id"), count.alias("count")).write.csv(
        path, sep="\t", header=True, compression="bzip2")
    return path


@_query
def source_counts(spark, sf):
    df = readers.read_counts(spark, _counts_file(spark, sf))
    return _flat(df.withColumn("count", F.coalesce("count", F.lit(-1))))


@_query
def source_counts_malformed(spark, sf):
    return _flat(readers.count_malformed(spark, _counts_file(spark, sf)))


@_query
def source_wide_features(spark, sf):
    path = fresh_path(spark, "wide")
    vec = X.vectors(spark, sf)
    vec.select("id", *[F.element_at("vec", i + 1).alias(f"f{i}") for i in range(64)]).write.csv(
        path, sep="\t", header=True, compression="bzip2")
    return _elements(readers.read_wide_features(spark, path, "vision"), "vec", "item_id", "modality")


@_query
def source_catalog(spark, sf):
    path = fresh_path(spark, "catalog")
    part = X.table(spark, sf, "part")
    price = F.when(F.col("p_size") == 13, "unknown").otherwise(F.col("p_retailprice").cast("string"))
    part.select(F.concat(F.lit("m"), "p_partkey").alias("first"), price.alias("min"), F.col("p_name").alias("title")).write.csv(path, header=True)
    return _flat(readers.read_catalog(spark, path).withColumn("min", F.coalesce("min", F.lit(-1.0))))


_FILE_ROWS = 1_000  # rows of a JSON file that a fixture writes as one value


def _json_files(df: DataFrame, name: str, value) -> str:
    """Path of text files of about `_FILE_ROWS` rows of `df` each, made one JSON value by `value` (of the rows' `entry`)."""
    path, df = fresh_path(df.sparkSession, name), stage(df, f"{name}-entries")
    files = F.lit(max(1, -(-df.count() // _FILE_ROWS)))
    df.groupBy(F.pmod(F.xxhash64("entry"), files).alias("file")).agg(value.alias("value")).select("value").write.option(
        "maxRecordsPerFile", 1).text(path)
    return path


@_query
def source_id_map(spark, sf):
    """JSON objects used as dictionary, read in byte ranges."""
    part = X.table(spark, sf, "part").select(F.struct(F.concat(F.lit("m"), "p_partkey"), F.col("p_size").cast("int")).alias("entry"))
    return _flat(readers.read_id_map(spark, _json_files(part, "id-map", F.to_json(F.map_from_entries(F.collect_list("entry"))))))


@_query
def source_slice(spark, sf):
    """Every slice written, each read back by its name, the empty one too."""
    path = fresh_path(spark, "slices")
    slices = stage(exports.export_slices(_split(spark, sf), X.meta(spark, sf)), "slices")
    sinks.write_slices(slices, path)
    names = sorted({r["slice"] for r in slices.select("slice").distinct().collect()} | set(sinks.EMPTY_SLICES))  # a report dimension
    found = [readers.read_slice(spark, path, n).withColumn("slice", F.lit(n)) for n in names]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _flat(out)


@_query
def source_slice_array(spark, sf):
    """Slices as JSON arrays of records, read in byte ranges."""
    records = _split(spark, sf).select(F.struct("media_id", "id_no", "score").alias("entry"))
    return _flat(readers.read_slice(spark, _json_files(records, "slice-array", F.to_json(F.collect_list("entry")))))


@_query
def source_split_ids(spark, sf):
    """Manifests of id lists, read in byte ranges, every list."""
    keys = list(readers.MANIFEST_KEYS.values())
    key = F.when(F.col("p_size") > 40, "test_track").when(F.col("p_size") > 30, "valid_track").otherwise("train_track")
    part = X.table(spark, sf, "part").select(F.struct(F.concat(F.lit("m"), "p_partkey").alias("id"), key.alias("key")).alias("entry"))
    lists = F.struct(*[F.collect_list(F.when(F.col("entry.key") == k, F.col("entry.id"))).alias(k) for k in keys])
    path = _json_files(part, "split-ids", F.to_json(lists))
    parts = [readers.read_split_ids(spark, path, k).withColumn("split", F.lit(k)) for k in readers.MANIFEST_KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def sink_stage(spark, sf):
    path = fresh_path(spark, "plain")
    sinks.write_stage(X.table(spark, sf, "supplier"), path, compression="none")
    return spark.read.parquet(path)


@_query
def sink_manifest(spark, sf):
    """Every id set of every split, written and read back by name."""
    path = fresh_path(spark, "manifest")
    sinks.write_manifest(exports.split_manifest(_split(spark, sf)), path)
    out = None
    for split in SPLITS:
        for id_set in ("all_item", "cold_item", "warm_item", "all_user", "cold_user", "warm_user"):
            found = readers.read_manifest(spark, path, split, id_set).withColumns({"split": F.lit(split), "id_set": F.lit(id_set)})
            out = found if out is None else out.unionByName(found)
    return out


@_query
def sink_vectors(spark, sf):
    """Every modality, written and read back by name."""
    path = fresh_path(spark, "vectors")
    sinks.write_vectors(X.features(spark, sf), path)
    found = [readers.read_vectors(spark, path, m) for m in MODALITIES]
    return _elements(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]), "vec", "item_id", "modality")


@_query
def sink_factors(spark, sf):
    path = fresh_path(spark, "factors")
    sinks.write_factors(X.vectors(spark, sf).withColumn("vec", F.transform("vec", lambda x: x.cast("float"))), path)
    return _elements(readers.read_factors(spark, path), "vec", "id")


@_query
def sink_results(spark, sf):
    path = fresh_path(spark, "results")
    sinks.write_results(ranking.ranking_metrics(*_truth_and_prediction(spark, sf), 10), path)
    return _flat(spark.read.json(path).select("n_users", "precision", "recall", "ndcg", "map"))


@_query
def source_file_inventory(spark, sf):
    """Files written one per customer nation, counted by name."""
    path = fresh_path(spark, "files")
    X.table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").cast("string")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = file_inventory(spark, path, ".txt")
    return found.select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("long").alias("nation")).distinct()


@_query
def parsed_floats(spark, sf):
    """Numbers from text."""
    text = F.array(F.col("l_extendedprice").cast("int").cast("string"), F.col("l_discount").cast("string"))
    item = X.table(spark, sf, "lineitem")
    return _elements(item.select("l_orderkey", "l_linenumber", parse_floats(text).alias("v")), "v", "l_orderkey", "l_linenumber")
