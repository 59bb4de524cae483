"""Document fingerprints: a Merkle tree over sections, paragraphs and their blocks.

A line is a paragraph; a paragraph is cut after its sentences, and a sentence
longer than `LONGEST` characters at places its own words decide. A section ends
after a paragraph whose digest says so. All cuts depend on nearby content only,
so an edit changes the blocks it touches and the branches above them.

Every inner node is the digest of its children; the root stands for the text.
A fingerprint is the tree written out as `root|section;section`, a section being
`paragraph,paragraph` and a paragraph `block.block`; a block is ten hex digits of
its digest, a colon and its weight (characters plus one). Roots test equality,
`differing` walks down unequal branches to the edited places, and `likeness` is
the share of weight that two trees have in common (2 * common / total).

Defined results: null and empty texts have the tree of one empty paragraph;
repeated ids follow one another in the order of their texts' hash; a null id
comes before all others; a table of one row is its own next document; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from mediarec.llm.common import text_of

LONGEST = 80
SECTION = 8          # one paragraph in so many ends a section
RANGE_ROWS = 50_000  # documents of a range; four billion documents have 80,000 ranges
_SENTENCE = re.compile(r"(?<=[.!?]) ")


def _digest(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


def _blocks(paragraph: str) -> Iterator[str]:
    for sentence in _SENTENCE.split(paragraph):
        if len(sentence) <= LONGEST:
            yield sentence
            continue
        run: list[str] = []
        for word in sentence.split(" "):
            run.append(word)
            if zlib.crc32(word.encode("utf-8", "surrogatepass")) % 8 == 0:
                yield " ".join(run)
                run = []
        if run:
            yield " ".join(run)


def fingerprint(text: str | None) -> str:
    """The written-out tree of `text`."""
    written, section, tops, nodes = [], [], [], []
    for paragraph in (text or "").split("\n"):
        blocks = list(_blocks(paragraph))
        digests = [_digest(b"block", b.encode("utf-8", "surrogatepass")) for b in blocks]
        node = _digest(b"paragraph", b"".join(digests))
        nodes.append(node)
        section.append(".".join([f"{d.hex()[:10]}:{len(b) + 1}" for d, b in zip(digests, blocks)]))
        if node[0] % SECTION == 0:
            tops.append(_digest(b"section", b"".join(nodes)))
            written.append(",".join(section))
            section, nodes = [], []
    if section:
        tops.append(_digest(b"section", b"".join(nodes)))
        written.append(",".join(section))
    return f"{_digest(b'root', b''.join(tops)).hex()}|{';'.join(written)}"


def root(print_: str) -> str:
    return print_.partition("|")[0]


_LEAF = re.compile(r"[,;.]")


def likeness(a: str, b: str) -> float:
    """Share of weight two fingerprints have in common, 0 to 1; 1 exactly if the roots are equal."""
    if root(a) == root(b):
        return 1.0
    one, two = (Counter(_LEAF.split(x.partition("|")[2])) for x in (a, b))
    weight = {x: int(x.rpartition(":")[2]) for x in one.keys() | two.keys()}
    total = sum(weight[x] * n for side in (one, two) for x, n in side.items())
    common = sum(weight[x] * min(n, two[x]) for x, n in one.items() if x in two)
    return min(2 * common / total, 1 - 1e-9)


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places in `b` whose branch `a` doesn't have; equal branches are not entered."""
    if root(a) == root(b):
        return []
    mine = a.partition("|")[2].split(";")
    whole = Counter(mine)
    paragraphs = Counter(p for s in mine for p in s.split(","))
    places = []
    for i, section in enumerate(b.partition("|")[2].split(";")):
        if whole[section]:
            continue
        places += [(i, j) for j, p in enumerate(section.split(",")) if not paragraphs[p]]
    return places


def edited(text: str, following: str) -> str:
    """`text` with its last floor(n/2) characters replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _row(text: str, own: str, following: str, next_: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    places = ",".join(f"{section}:{paragraph}" for section, paragraph in differing(own, other))
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, next_), places)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, guest, key): each row meets the one after it in its bucket; guests only follow."""
    last = None  # (bucket, doc_id, text, fingerprint) waiting for its successor
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            piece = batch.slice(part, 512)
            ids, rows = [], []
            for bucket, guest, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                if guest and (last is None or last[0] != bucket):
                    continue  # a second guest of the bucket
                own = fingerprint(text)
                if last is not None:
                    ids.append(last[1])
                    rows.append(_row(last[2], last[3], text, own))
                last = None if guest else (bucket, doc_id, text, own)
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_places"])


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of all `docs` (doc_id, text) and of their edited texts, compared with those of the next document by id.

    Ids are cut into ranges of about equal size, of at most about `RANGE_ROWS`
    documents; the ranges' first ids (one number per range) come to the driver. The first document of
    a range also visits the range before it, so every document meets its
    successor, and whole texts are shuffled once. `edited_places` lists the
    `section:paragraph` places at which the edited text's tree has other branches.
    """
    spark = docs.sparkSession
    buckets = buckets or max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))
    cut = docs.select(key.alias("key")).repartitionByRange(buckets, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first"))
    starts = np.array(sorted(r["first"] for r in cut.collect()), np.int64)
    n = len(starts)

    @pandas_udf(IntegerType())
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(starts, keys.to_numpy(), "right") - 1).astype("int32"))

    @pandas_udf(IntegerType())
    def guest_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, keys.to_numpy())
        first = (at < n) & (starts[np.minimum(at, n - 1)] == keys.to_numpy())
        return pd.Series(np.where(first, (at - 1) % max(n, 1), -1).astype("int32"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", text_of().alias("text"), key.alias("key"))
    if n:
        own = F.struct(bucket_of("key").alias("bucket"), F.lit(False).alias("guest"))
        visit = F.struct(guest_of("key").alias("bucket"), F.lit(True).alias("guest"))
        visits = F.explode(F.filter(F.array(own, visit), lambda v: v["bucket"] >= 0)).alias("v")
    else:
        visits = F.explode(F.array(F.struct(F.lit(0).alias("bucket"), F.lit(False).alias("guest")))).alias("v")
    rows = placed.select("doc_id", "text", "key", visits).select("doc_id", "text", "key", "v.*")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", F.xxhash64("text"))
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(
        _pairs, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_places string")
