"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with more fact rows than this is split over several tasks. N fact rows
# hold at most N / HOT_ROWS such keys, which bounds the table of hot keys:
# a trillion rows give at most 250,000 of them, a few megabytes.
HOT_ROWS = 4_000_000


def hot_key_join(fact: DataFrame, keyed: DataFrame, key: str, rows: str,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `fact` with `keyed`, which has one row per key.

    `keyed[rows]` must be (an upper bound of) the number of fact rows of the
    key; its maximum is looked up first, so `keyed` should be a staged table.
    Without a hot key this is a plain join. Keys above `hot_rows` are cut into ceil(rows / hot_rows) salted parts:
    their single keyed row is repeated once per part and the fact rows are
    dealt out over the parts. All other keys join as usual.

    The salt mixes the row with the id of the map partition holding it, so
    exact copies of a row spread out too, and a re-run task deals the same way.
    """
    largest = keyed.agg(F.max(rows)).first()[0]
    if largest is None or largest <= hot_rows:
        return fact.join(keyed, key)
    parts = F.ceil(F.col(rows) / F.lit(hot_rows)).cast("int")
    # Size bound: at most (fact rows / hot_rows) keys, see HOT_ROWS.
    hot = F.broadcast(keyed.where(F.col(rows) > hot_rows).select(key, parts.alias("_parts")))
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in fact.columns])
    dealt = (
        fact.join(hot, key, "left")
        .withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0))
                    .otherwise(F.pmod(spread, F.col("_parts")).cast("int")))
        .drop("_parts")
    )
    repeated = keyed.withColumn(
        "_part",
        F.explode(F.when(F.col(rows) > hot_rows, F.sequence(F.lit(0), parts - 1))
                  .otherwise(F.array(F.lit(0)))),
    )
    return dealt.join(repeated, [key, "_part"], "inner").drop("_part")
