"""Sharding over fixed virtual slots.

A record's key hashes into one of `n_slots` slots, for good. A small table
(version, slot, shard) says which shard holds a slot. Version 0 deals the
slots out evenly; a rebalancing measures the bytes of every slot and writes the
next version, which moves as few slots as it needs. Records follow their slot,
so an edit of the map never rehashes a record.

Keys are ids, which are unique, so a third of all rows sharing a source or a
text still spreads evenly. Only n_slots sums reach the driver.

Defined results: a null text has no bytes, a null id hashes like any value
(slot of the hash of null), repeated rows each get a place of their own; an
empty table gives an empty result and an even map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from mediarec.llm.common import fresh, text_of
from mediarec.operators.staging import stage

N_SLOTS = 8192
RECORD_BYTES = 16


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(n_slots)).cast("int")


def even_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Version 0: contiguous ranges of slots."""
    return [s * n_shards // n_slots for s in range(n_slots)]


def rebalanced(slot_map: list[int], weight: list[int], n_shards: int) -> list[int]:
    """The next map: shards above the mean hand slots to the lightest ones.

    Two steps, both bounded by the number of slots. Heaviest shards first give
    away slots that bring both sides nearer to the mean; then pairs of slots
    are swapped between the heaviest and the lightest shard while that narrows
    the gap.
    """
    shard = list(slot_map)
    held: list[list[int]] = [[] for _ in range(n_shards)]
    load = [0] * n_shards
    for s, k in enumerate(shard):
        held[k].append(s)
        load[k] += weight[s]
    mean = sum(load) / n_shards
    light = [(load[k], k) for k in range(n_shards)]
    heapq.heapify(light)
    for k in sorted(range(n_shards), key=lambda k: -load[k]):
        for s in sorted(held[k], key=lambda s: (-weight[s], s)):
            if load[k] <= mean:
                break
            if not weight[s] or load[k] - weight[s] < mean - weight[s] / 2:
                continue
            while light and light[0][0] != load[light[0][1]]:
                heapq.heappop(light)
            low, to = light[0]
            if low + weight[s] >= load[k]:
                continue
            held[k].remove(s)
            held[to].append(s)
            load[k] -= weight[s]
            load[to] += weight[s]
            shard[s] = to
            heapq.heapreplace(light, (load[to], to))
            heapq.heappush(light, (load[k], k))
    for _ in range(4 * n_shards):
        hi, lo = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        # Move the slot difference nearest to half the gap; None stands for giving without taking.
        others = sorted((weight[s], s) for s in held[lo])
        best, pick, j = 0, None, 0
        for w, s in sorted((weight[s], s) for s in held[hi]):
            while j < len(others) and others[j][0] < w - gap / 2:
                j += 1
            for v, o in ([(0, None)] + others[max(0, j - 1):j + 1]):
                gain = min(w - v, gap - (w - v))
                if gain > best:
                    best, pick = gain, (s, o)
        if pick is None:
            break
        s, o = pick
        held[hi].remove(s)
        held[lo].append(s)
        shard[s] = lo
        if o is not None:
            held[lo].remove(o)
            held[hi].append(o)
            shard[o] = hi
        moved = weight[s] - (weight[o] if o is not None else 0)
        load[hi] -= moved
        load[lo] += moved
    return shard


def map_table(spark: SparkSession, slot_map: list[int], version: int) -> DataFrame:
    """Rows (version, slot, shard)."""
    listed = F.split(F.lit(",".join(map(str, slot_map))), ",")
    return spark.range(len(slot_map)).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("slot"),
        F.get(listed, F.col("id").cast("int")).cast("int").alias("shard"))


def slot_bytes(sized: DataFrame, slot: str, size: str, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes per slot: n_slots numbers at most, summed by the map tasks first."""
    out = [0] * n_slots
    for s, b in sized.groupBy(slot).agg(F.sum(size)).collect():
        out[s] = int(b)
    return out


def assign(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(placed, map): `placed` has the key, size, text_crc32, virtual_slot, shard and slot, its place in the shard.

    The texts never move: one scan turns them into narrow staged rows.
    """
    spark = docs.sparkSession
    t = text_of(text)
    rows = stage(docs.select(
        F.col(key), (F.octet_length(t) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), slot_of(F.col(key), n_slots).alias("virtual_slot")), "slot-rows")
    first = even_map(n_shards, n_slots)
    second = rebalanced(first, slot_bytes(rows, "virtual_slot", "size", n_slots), n_shards)
    versions = stage(map_table(spark, first, 0).unionByName(map_table(spark, second, 1)), "slot-map")
    current = versions.where(F.col("version") == 1).select(F.col("slot").alias("virtual_slot"), "shard")
    # Places: a slot starts where the slots before it in its shard end. n_slots rows.
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")).join(current, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    # Size bound of the broadcast: one row per virtual slot.
    placed = ranked.join(F.broadcast(starts), "virtual_slot").select(
        key, "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
    return placed, versions
