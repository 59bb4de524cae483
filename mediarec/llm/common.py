"""Column helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What ends a word (space, tab to carriage return).
WORD_GAP = "[\\x20\\x09-\\x0D]+"
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_of(column: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters that are neither space nor \\t..\\r."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names built from `names` that `frame` does not have (in any case)."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def computed_once(frame: DataFrame, **columns: Column) -> DataFrame:
    """`frame` with more columns that no later filter or projection can pull apart and evaluate again.

    A one-element `inline` is a step the optimizer does not push conditions
    through, so costly columns used in many conditions are computed once a row.
    """
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
