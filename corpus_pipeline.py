"""The corpus pipeline: quality classifier, quality rules, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns
a DataFrame; all but the last return the columns of `documents`. Stages are
written as Parquet and read again, so each starts from a durable table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediarec.llm import line_templates, near_duplicates, packing, quality_rules, rule_ensemble
from mediarec.llm.common import id_remainder, read
from mediarec.llm.queries import tokenizer_path
from mediarec.operators.staging import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rule ensemble predicts to be of quality 1; learned from labels outside remainder 0 of 5."""
    return rule_ensemble.keep_good(docs, read(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bounds learned from the documents this stage gets."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return line_templates.drop_recurring(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in the training sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_filter), ("line dedup", line_dedup),
          ("near dedup", near_dedup), ("packing", pack)]

#: Learned models, sketches and tokenizers are beyond SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
