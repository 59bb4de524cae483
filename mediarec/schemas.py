"""Declared schemas and the checks made at operator boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

LOG = T.StructType([
    T.StructField("log_time", T.TimestampType()),
    T.StructField("watch_time", T.LongType()),
    T.StructField("id_no", T.StringType()),
    T.StructField("id_country", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("fraud_level", T.IntegerType()),
    T.StructField("media_id", T.StringType()),
    T.StructField("live", T.BooleanType()),
    T.StructField("duration", T.LongType()),
    T.StructField("ds", T.DateType()),
])
LOG_COLUMNS = LOG.fieldNames()

ENTITIES = T.ArrayType(T.StructType([T.StructField("surface", T.StringType())]))

META = T.StructType([
    T.StructField("media_id", T.StringType()),
    T.StructField("channel_category", T.StringType()),
    T.StructField("channel_nm", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("net_res_list", ENTITIES),
])

COUNTS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("track_id", T.StringType()),
    T.StructField("count", T.LongType()),
])

SLICE_RECORD = T.StructType([
    T.StructField("media_id", T.StringType()),
    T.StructField("id_no", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

FEATURES = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("modality", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])

FACTORS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job starts when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns, casting where the stored type differs.

    A value that does not fit becomes null instead of failing the job. Columns
    already of the right type stay bare so that filters on them still reach
    the Parquet reader.
    """
    require_columns(df, *schema.fieldNames())
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        F.col(f.name) if have[f.name] == f.dataType
        else F.col(f.name).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
