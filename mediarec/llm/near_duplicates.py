"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A text is the set of its distinct 5-word shingles (fewer words: the whole
sequence is one). Its sketch has `size` coordinates filled in rounds: round i
throws every shingle into one of the coordinates by a hash of its own, and a
coordinate keeps the smallest (round, hash) it saw; from round `size` on, round
i serves coordinate i - size alone. Hence no coordinate stays empty, the rounds
stop as soon as all are filled (one or two for most texts), and the share of
equal coordinates estimates the Jaccard similarity with concentration bounds.

The first coordinates are cut into bands; texts that agree on a band are candidates. With
32 bands of 4 a pair of similarity 0.75 is missed with probability 5e-6.

Groups of any size are handled without listing their pairs:

1. Equal sets are one node, whatever their number.
2. In every bucket all members are compared with one pivot only, the member
   met most often over all bands. Exact verification on full sets gives edges.
3. Edges are contracted to components. A bucket whose members are in one
   component is finished, copies and near copies of one text mostly are.
4. For other buckets, members outside the bucket's largest component are
   compared with all its members, in square blocks of bounded size, on their
   sketches, each pair in the first band it shares; only pairs of different
   components whose estimate is within reach of the threshold come out, and
   are verified on full sets.

Step 4 is complete, so no link is lost that banding finds. Links and labels
stay in tables; the driver sees counts only.

Defined results: null, blank and wordless texts have an empty set and are
linked with nothing; a null id is never linked nor dropped; rows that repeat an
id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from mediarec.operators.staging import stage

SHINGLE = 5
_STEP = 0x9E3779B97F4A7C15
_ODD = np.uint64(_STEP)


@dataclass(frozen=True)
class SketchConfig:
    size: int = 512          # coordinates, a power of two
    bands: int = 32          # bands cut from the first coordinates
    rows: int = 4            # coordinates per band
    percent: int = 75        # linked from this Jaccard similarity on
    margin: float = 0.08     # estimates this far below it still get verified: four standard deviations
    block: int = 512         # members per side of a block


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; bytes lower and split only touch ASCII."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in parts], np.uint64)
    n = min(SHINGLE, len(h))
    key = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        key = mixed(key * _ODD + h[k:len(h) - n + 1 + k])
    return np.unique(key)


def _thrown(items: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate bits, rank) of all items in rounds first..last-1; a lower round always ranks lower."""
    rounds = np.arange(first, last, dtype=np.uint64)[:, None]
    x = mixed(items[None, :] + (rounds + np.uint64(1)) * _ODD)
    return x, (rounds << np.uint64(48)) | (x >> np.uint64(16))


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: `size` values of (round, hash).

    Rounds are thrown several at a time, as many as will likely fill all
    coordinates; the rank holds the round, so taking the smallest is the same
    as throwing them one by one.
    """
    empty = np.uint64(np.iinfo(np.uint64).max)
    out = np.full(size, empty)
    done, step = 0, max(1, int(1.2 * size * np.log(size)) // len(items))
    while done < size and (out == empty).any():
        last = min(size, done + step)
        x, rank = _thrown(items, done, last)
        np.minimum.at(out, (x & np.uint64(size - 1)).ravel().astype(np.intp), rank.ravel())
        done, step = last, max(1, step // 4)
    for k in np.flatnonzero(out == empty):
        out[k] = _thrown(items, size + int(k), size + int(k) + 1)[1].min()
    return out


def _sketches(batches: Iterator[pa.RecordBatch], config: SketchConfig) -> Iterator[pa.RecordBatch]:
    bands = config.bands
    tags = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
    for batch in batches:
        n, node, band, sig, marks = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            items = shingles(text)
            n.append(len(items))
            if not len(items):
                node.append(None)
                band.append(None)
                sig.append(None)
                marks.append(None)
                continue
            s = sketch(items, config.size)
            key = tags.copy()
            for column in s[:bands * config.rows].reshape(bands, config.rows).T:
                key = mixed(key * _ODD + column)
            node.append(xxhash.xxh3_128_digest(items.tobytes()))
            band.append(key.view(np.int64))
            marks.append(key.astype("<u4").tobytes())
            sig.append((mixed(s) & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(band, pa.list_(pa.int64())),
             pa.array(sig, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "n_shingles", "node", "bands", "sig", "marks"])


def with_sketches(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """(doc_id, n_shingles, node, bands, sig, marks): one narrow row per document, texts stay where they are.

    `sig` has 8 bits of every coordinate, `marks` 32 bits of every band.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _sketches(batches, config),
        f"doc_id {kind}, n_shingles bigint, node binary, bands array<bigint>, sig binary, marks binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            sets = [shingles(t) for t in batch.column("text").slice(start, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "items"])


@pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal coordinates, corrected for the 8 bits kept of each."""
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, config: SketchConfig) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; `nodes` has node, first (its doc_id), n, sig.

    Equi-joins with nothing above them that needs the rows of a key together,
    so a pivot shared by very many pairs is split at run time.
    """
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("first").alias(f"f_{x}")) for x in "ab")
    enough = 100 * F.least("n_a", "n_b") >= config.percent * F.greatest("n_a", "n_b")
    near = stage(pairs.join(one, "a").join(two, "b").where(enough)
                 .where(_agreement("sig_a", "sig_b") >= config.percent / 100 - config.margin)
                 .select("a", "b", "n_a", "n_b", "f_a", "f_b"), "near-candidates")
    ids = near.select(F.col("f_a").alias("doc_id")).unionAll(near.select("f_b")).distinct()
    items = (docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
             .mapInArrow(_sets, "node binary, items array<bigint>").dropDuplicates(["node"]))
    items = stage(items, "near-sets")
    left, right = (items.select(F.col("node").alias(x), F.col("items").alias(f"i_{x}")) for x in "ab")
    common = F.size(F.array_intersect("i_a", "i_b"))
    joined = near.join(right, "b").join(left, "a").withColumn("common", common)
    return stage(joined.where(100 * F.col("common") >= config.percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
                 .select("a", "b"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b): label is shared by exactly the nodes of a component.

    Every round points each node to its smallest neighbour and replaces the
    ends of all links by what they point to. Node ids are hashes, so the
    pointers are random and the number of links falls geometrically even along
    chains. All steps are aggregates that combine before the shuffle, or joins.
    """
    labels, rest = None, links.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    while True:
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(rest.select(F.col("b"), F.col("a")))
        parent = stage(both.groupBy("node").agg(F.min("other").alias("other"))
                       .select("node", F.least("node", "other").alias("up")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            up = parent.select(F.col("node").alias("label"), "up")
            labels = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = stage(labels, "labels")
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"u{x}")) for x in "ab")
        moved = rest.join(a, "a").join(b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        rest = stage(moved.where(F.col("a") != F.col("b")).distinct(), "links")
        if rest.isEmpty():
            return labels


def _block_pairs(config: SketchConfig):
    least = config.percent / 100 - config.margin

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out, all_ = rows[rows["outside"]], rows[~rows["outside"]]
        if not len(out) or not len(all_):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        x = np.frombuffer(b"".join(out["sig"]), np.uint8).reshape(len(out), -1)
        y = np.frombuffer(b"".join(all_["sig"]), np.uint8).reshape(len(all_), -1)
        ly, ny = all_["label"].to_numpy(), all_["n"].to_numpy()
        node_y = all_["node"].to_numpy()
        found_a, found_b = [], []
        marks = np.frombuffer(b"".join(all_["marks"]), "<u4").reshape(len(all_), -1)
        band = int(rows["band"].iloc[0])
        early = 4 * len(x[0]) // 16
        for k, (node, label, n, own) in enumerate(zip(out["node"], out["label"], out["n"], out["marks"])):
            ok = np.flatnonzero((ly != label) & (100 * np.minimum(ny, n) >= config.percent * np.maximum(ny, n)))
            # A pair is looked at in the first band it shares only.
            ok = ok[~(marks[ok, :band] == np.frombuffer(own, "<u4")[:band]).any(axis=1)]
            # A quarter of the coordinates first, with twice the margin.
            ok = ok[(y[ok, :early] == x[k, :early]).mean(axis=1) >= least - config.margin]
            share = ((y[ok] == x[k]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            for other in node_y[ok[share >= least]]:
                found_a.append(min(node, other))
                found_b.append(max(node, other))
        return pd.DataFrame({"a": found_a, "b": found_b}, dtype=object)

    return compare


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, config: SketchConfig) -> DataFrame:
    """Pairs of different components that share a bucket and have close sketches (step 4)."""
    tagged = stage(members.join(labels, "node", "left")
                   .select("bucket", "band", "node", F.coalesce("label", "node").alias("label")), "tagged")
    per = tagged.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    # A bucket of two was settled by its pivot.
    mixed_ = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
    mixed_ = mixed_.where((F.col("kinds") > 1) & (F.col("m") > 2)).select(
        "bucket", F.col("top.label").alias("main"), "m", (F.col("m") - F.col("top.c")).alias("outsiders"))
    rows = tagged.join(stage(mixed_, "mixed"), "bucket").join(nodes.select("node", "n", "sig", "marks"), "node")
    # Blocks are dealt by hash, so that they hold about `block` members each.
    na, nb = (F.greatest(F.lit(1), F.ceil(F.col(c) / config.block)).cast("int") for c in ("outsiders", "m"))
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))

    def as_member():
        return F.transform(F.sequence(F.lit(0), na - 1), lambda i: F.struct(
            F.lit(False).alias("outside"), i.alias("i"), F.pmod(own, nb).cast("int").alias("j")))

    def as_outsider():
        return F.transform(F.sequence(F.lit(0), nb - 1), lambda j: F.struct(
            F.lit(True).alias("outside"), F.pmod(own, na).cast("int").alias("i"), j.alias("j")))

    sides = F.when(F.col("label") == F.col("main"), as_member()).otherwise(F.concat(as_member(), as_outsider()))
    dealt = rows.select("bucket", "band", "node", "label", "n", "sig", "marks", F.explode(sides).alias("s")).select(
        "bucket", "band", "s.*", "node", "label", "n", "sig", "marks")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(_block_pairs(config), "a binary, b binary").distinct()


def linked(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row, from `docs` (doc_id, text)."""
    own = stage(with_sketches(docs, config), "sketches")
    able = own.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(able.groupBy("node").agg(F.min("doc_id").alias("first")), "classes")
    firsts = able.join(classes, ["node"]).where(F.col("doc_id") == F.col("first")).dropDuplicates(["node"])
    nodes = stage(firsts.select("node", "first", F.col("n_shingles").alias("n"), "sig", "marks", "bands"), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    members = stage(banded.join(sizes, "bucket"), "members")
    met = members.groupBy("node").agg(F.sum("m").alias("met"))
    placed = members.select("bucket", "node").join(met, "node")
    pivots = placed.groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot"))
    pairs = (members.select("bucket", "node").join(pivots, "bucket").where(F.col("node") != F.col("pivot"))
             .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    nodes = nodes.drop("bands")
    links = verified(pairs, nodes, docs, config)
    more = verified(_across(members.select("bucket", "band", "node"), components(links), nodes, config), nodes, docs, config)
    labels = components(links.unionAll(more))
    # A class without links is its own component; one smallest id per component.
    marked = classes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    smallest = marked.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = marked.join(smallest, "label").select("node", "component_id")
    return own.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """`docs` without the documents that are linked, directly or not, to one with a smaller id."""
    gone = linked(docs.select("doc_id", "text"), config).where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)
