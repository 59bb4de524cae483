"""Content vectors to recommendation quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mediarec.config import FusionConfig
from mediarec.operators.features import assemble_modalities
from mediarec.operators.fusion import FusionModel, fit_fusion, score_fusion
from mediarec.operators.ranking import evaluate_slices
from mediarec.operators.staging import stage


def train_fusion(features: DataFrame, factors: DataFrame, train_ids: DataFrame,
                 valid_ids: DataFrame, cfg: FusionConfig) -> tuple[FusionModel, DataFrame]:
    """Assemble train and validation rows, fit the regression, and count what could not be assembled.

    The counts are (`part`, `asked`, `complete`, `dropped`).
    """
    wanted: Sequence[str] = [cfg.columns[m] for m in "vatg" if m in cfg.modality]
    train, lost = assemble_modalities(features, factors, train_ids, wanted)
    valid, lost_valid = assemble_modalities(features, factors, valid_ids, wanted)
    counts = lost.withColumn("part", F.lit("train")).unionByName(lost_valid.withColumn("part", F.lit("valid")))
    return fit_fusion(stage(train, "fusion-train"), stage(valid, "fusion-valid"), cfg), counts


def evaluate(slices: DataFrame, users: DataFrame, items: DataFrame, model: FusionModel | None = None,
             k: int = 10, splits: Sequence[str] | None = ("test",)) -> DataFrame:
    """Metrics of the slices of `splits`.

    `items` are (`id`, `vec`) collaborative vectors, or, with `model`,
    assembled content rows that it scores first.
    """
    if model is not None:
        items = score_fusion(items, model).withColumnRenamed("item_id", "id")
    return evaluate_slices(slices, users, items, k, splits)
