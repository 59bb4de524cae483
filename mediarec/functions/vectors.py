"""Column functions on float arrays. Sums run in double."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

_EPS = 1e-12


def parse_floats(fields: Column) -> Column:
    """Array of strings to array of floats."""
    return F.transform(fields, lambda x: x.cast("float"))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # The norm is repeated as an array so that it is computed once per vector.
    scale = F.array_repeat(F.greatest(norm(v), F.lit(_EPS)), F.size(v))
    return F.zip_with(v, scale, lambda x, n: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either is zero."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(_EPS)) * F.greatest(norm(b), F.lit(_EPS)))


def concat_modalities(modality: str, columns: dict[str, str]) -> Column:
    """Modality vectors put end to end in the fixed order v, a, t, g."""
    wanted: Iterable[str] = [m for m in "vatg" if m in modality]
    return F.concat(*[columns[m] for m in wanted])
