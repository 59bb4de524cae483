import random
import zlib

import pytest
from pyspark.sql import functions as F

from mediarec.llm import queries, slots
from mediarec.llm.common import read


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in read(spark, sf, "documents").collect()}
    rows = queries.op9_virtual_slots(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    load, places = [0] * 40, [[] for _ in range(40)]
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "bytes", None)
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(load) - min(load) <= max(map(len, docs.values())) + 16


@pytest.mark.parametrize("seed", range(4))
def test_rebalancing(seed):
    rng = random.Random(seed)
    weight = [rng.choice((0, 1, 5, 100, 3000)) * rng.randint(1, 9) for _ in range(600)]
    before = slots.even_map(7, 600)
    after = slots.rebalanced(before, weight, 7)
    loads = [sum(w for w, k in zip(weight, after) if k == s) for s in range(7)]
    assert set(after) <= set(range(7)) and max(loads) - min(loads) <= max(weight) / 50
    assert slots.rebalanced(before, [0] * 600, 7) == before  # nothing to move
    # A second rebalancing with the same weights moves next to nothing.
    assert sum(a != b for a, b in zip(after, slots.rebalanced(after, weight, 7))) <= 4


def test_map_versions(spark, awkward, nothing):
    placed, versions = slots.assign(awkward, 3, 64)
    assert versions.groupBy("version").count().orderBy("version").collect()[0][1] == 64 and versions.count() == 128
    now = {r.slot: r.shard for r in versions.where("version = 1").collect()}
    rows = placed.collect()
    assert len(rows) == awkward.count() and all(now[r.virtual_slot] == r.shard for r in rows)
    for s in range(3):
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert sorted(r["size"] for r in rows if r.doc_id in (2, 3)) == [16, 16]
    empty, even = slots.assign(nothing, 3, 64)
    assert empty.count() == 0 and [r.shard for r in even.where("version = 1").orderBy("slot").collect()] == slots.even_map(3, 64)


def test_slot_depends_on_the_key_alone(spark):
    a, b = (spark.range(100).repartition(n).select("id", slots.slot_of(F.col("id")).alias("s")).collect() for n in (1, 7))
    assert sorted(a) == sorted(b)
