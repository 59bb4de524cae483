import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names the operators use for their own columns.
    *[T.StructField(c, T.StringType()) for c in ("counts", "Score", "gone", "kept", "line_key", "stat_words", "n_words", "k_lang")]])

PROSE = "".join(f"The {a} {b} walks along the old {c} and tells a story about {d}.\n" for a, b, c, d in zip(
    "young tired happy quiet brave".split(), "man woman child dog king".split(), "road river wall street bridge".split(),
    "winter summer gold bread stars".split()))
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *(["x"] * 8))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, odd white space, clashing names."""
    rows = [row(1, PROSE), row(2, None), row(3, ""), row(4, " \t\n\x0b \n"), row(5, PROSE, None, None), row(5, PROSE, None, None),
            row(6, LONG), row(None, PROSE + "A line of its own."), row(7, "one"), row(8, "one"), row(9, "naïve  ça  va　?  \r\n tab\tend "),
            row(10, PROSE.replace("winter", "autumn")), row(11, "<|endoftext|> it's 'tis 42 ́x"), row(12, "a b c d"), row(13, "A B C D", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
