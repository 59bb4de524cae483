"""Category labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from mediarec.config import CATEGORIES


def label_index(col: Column, labels: Iterable[str] = CATEGORIES) -> Column:
    """1-based position of the label; 0 for an unknown or missing one."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), col), F.lit(0))
