"""Inputs of the registered queries, taken from the test tables.

Every view covers its whole tables; see `FIXTURES.md` for the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Part type to channel category.
CATEGORY_OF_TYPE = {
    "ECONOMY": "ARTIS", "LARGE": "DRAMA", "MEDIUM": "ENTER",
    "PROMO": "NEWS", "SMALL": "SPORT", "STANDARD": "ETC",
}
# Modality: first dimension (1-based) and length inside an embedding.
MODALITY_DIMS = {"vision": (1, 32), "audio": (33, 16), "lyrics": (49, 16)}
GENRES = 10
FACTOR_DIM = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _item(col: str):
    return F.concat(F.lit("m"), F.col(col).cast("string"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Viewing log: one row per line item."""
    customer = table(spark, sf, "customer")
    part = table(spark, sf, "part")
    orders = table(spark, sf, "orders")
    rows = (
        table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    user = F.when(F.col("c_acctbal") < -900, F.lit(None)).when(F.col("c_acctbal") > 9900, F.lit("")).otherwise(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    return rows.select(
        F.col("o_orderdate").alias("log_time"),
        (F.col("l_quantity") * F.col("l_quantity") * 4000).cast("long").alias("watch_time"),
        user.alias("id_no"),
        F.col("c_nationkey").cast("string").alias("id_country"),
        (F.col("c_nationkey") + 15).alias("age"),
        F.col("c_mktsegment").alias("gender"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), 1).otherwise(0).alias("fraud_level"),
        _item("l_partkey").alias("media_id"),
        (F.col("l_linenumber") == 7).alias("live"),
        F.when(F.col("p_size") == 13, 0).otherwise(F.col("p_size") * 200000).cast("long").alias("duration"),
        F.col("o_orderdate").cast("date").alias("ds"))


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue: parts of every brand but one, so that some log items are unknown."""
    kinds = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_TYPE.items() for x in kv])
    return table(spark, sf, "part").where(F.col("p_brand") != "Brand#7").select(
        _item("p_partkey").alias("media_id"), kinds[F.col("p_type")].alias("channel_category"),
        F.col("p_brand").alias("channel_nm"), F.col("p_name").alias("title"))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """(`id`, `modality`) of the stored media files."""
    part = table(spark, sf, "part")

    def files(where, modality):
        return part.where(where).select(_item("p_partkey").alias("id"), F.lit(modality).alias("modality"))
    return files(F.col("p_size") != 21, "vision").unionByName(files(F.col("p_brand") != "Brand#11", "audio"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(`id`, `vec`, `label`) of all embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "label")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Tall modality vectors of every embedding; genres is the label one-hot."""
    emb = table(spark, sf, "embeddings")
    parts = [F.struct(F.lit(m).alias("modality"), F.slice("embedding", start, n).alias("vec"))
             for m, (start, n) in MODALITY_DIMS.items()]
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(GENRES - 1)),
                          lambda i: (i == F.col("label")).cast("float"))
    parts.append(F.struct(F.lit("genres").alias("modality"), one_hot.alias("vec")))
    return emb.select(F.col("vec_id").cast("string").alias("item_id"), F.inline(F.array(*parts)))


def planted_factors(spark: SparkSession, sf: str) -> DataFrame:
    """(`id`, `vec`): a fixed linear map of each embedding, as regression target."""
    def mapped(j: int):
        terms = F.transform(F.col("embedding"), lambda x, i: x.cast("double") * F.sin((i + 1) * j))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).cast("float")
    outs = [mapped(j) for j in range(1, FACTOR_DIM + 1)]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.array(*outs).alias("vec"))


def id_vectors(ids: DataFrame, col: str, phase: int) -> DataFrame:
    """(`id`, `vec`): a vector computed from the number in each id."""
    number = F.substring(F.col(col), 2, 20).cast("double")
    vec = F.array(*[F.sin(number * j + phase) for j in range(1, FACTOR_DIM + 1)])
    return ids.select(F.col(col).alias("id"), vec.alias("vec"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(`item_id`, `pos`, `vec`): embeddings read as sequences of 25."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 25).alias("item_id"), (F.col("vec_id") % 25).alias("pos"),
        F.col("embedding").alias("vec"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as titles; language and source as entities."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("title"),
        F.array(F.struct(F.col("lang").alias("surface")),
                F.struct(F.col("source").alias("surface"))).alias("net_res_list"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """(`clip_id`, `event_id`, `x`): event values as samples of one clip per user."""
    return table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), "event_id", F.col("value").alias("x"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """(`user_id`, `track_id`, `count`) over the whole log."""
    orders = table(spark, sf, "orders")
    return (
        table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").cast("string").alias("track_id"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
