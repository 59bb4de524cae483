"""The queries of this package: thin views of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediarec.llm import interpolation, line_templates, merkle, near_duplicates, packing, phrase_mining, quality_rules, rule_ensemble, secret_scan, slots, text_density, tree_bpe, turn_repair
from mediarec.llm.common import id_remainder, read
from mediarec.operators.staging import stage

SHARDS = 40


def _documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text", *more)


def op2_deleted_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Log-probabilities of every text under the interpolated model and under add-one word counts."""
    found = interpolation.scored_documents(_documents(spark, sf))
    return found.withColumn("held_out", id_remainder(F.col("doc_id"), 7) == 2)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how like they are."""
    return merkle.with_next(_documents(spark, sf))


def op3_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece's place in the packed sequences."""
    return packing.pack(_documents(spark, sf), tokenizer_path("word_bpe_49k.json"))


def op4_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text without the lines of recurring templates."""
    found = line_templates.marked(_documents(spark, sf))
    found = found.withColumn("left", line_templates.kept_lines(F.col("text"), F.col("gone")))
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.size("left").cast("long"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    return found.select("doc_id", lines.alias("n_lines"), (lines - kept).alias("n_dropped"), text.alias("text"))


def op5_text_density(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return text_density.extracted(read(spark, sf, "pages"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per document, the base verdict and the verdict with adaptive bounds."""
    config = quality_rules.RulesConfig()
    counted = stage(quality_rules.with_counts(_documents(spark, sf, "lang", "source")).drop("text"), "quality-counts")
    judged = quality_rules.verdict(counted, quality_rules.learn(counted, config), "kept", config)
    return judged.select("doc_id", *[f"counts.{c}" for c in quality_rules.COUNTS],
                         quality_rules.base_failed(F.col("counts"), config).alias("base_failed"), "kept")


def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's component under 5-word shingle similarity of 0.75 or more."""
    found = near_duplicates.linked(_documents(spark, sf))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document; learned from the labels outside remainder 0 of 5."""
    docs = _documents(spark, sf)
    rules = rule_ensemble.learn(docs, read(spark, sf, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    out = rule_ensemble.scored(docs, rules, "score")
    threshold = rule_ensemble.EnsembleConfig().threshold
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_virtual_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's shard and place under the map balanced by bytes."""
    placed, _ = slots.assign(_documents(spark, sf), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_tree_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return tree_bpe.digests(_documents(spark, sf), tokenizer_path("byte_bpe_50k.json"))


def op11_big_integer_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's faults, cheapest edits and the digest of its repaired rows."""
    return turn_repair.repair(read(spark, sf, "conversations"))


def op12_randomness_battery(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every text: fixed patterns and strings that test as random."""
    return secret_scan.spans(_documents(spark, sf))


def op13_toivonen_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The first collocations of every language."""
    return phrase_mining.collocations(_documents(spark, sf, "lang"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_big_integer_repair": turn_repair.oracle(), "op13_toivonen_phrases": phrase_mining.oracle()}
