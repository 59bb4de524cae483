"""Deleted interpolation: a bigram language model mixed by context frequency.

P(w | h) = a * c(h,w) / c(h)  +  b * c(w) / N  +  d / (V + 1)

with weights (a, b, d) for each bucket of c(h), a power of two. n-grams are of
order two. The weights are
learned by expectation-maximisation on held-out counts: a twentieth of the
training documents is deleted from the counts, its tokens are explained with
the counts of the others until the weights stand still, and the weights that
explain them best are used with the counts of all training documents. Contexts
that don't occur (bucket 0) have no pairs, so there a is 0 and b + d = 1: the
probabilities of all words, the end and the unknown word add up to one after any context.

How the corpus is counted:

1. Documents are read in blocks of about `block` tokens. A block is one staged
   row: its distinct words as 64-bit hashes, its tokens as numbers into them.
2. Every block sums up its own words and word pairs and deals the sums out by
   hash. A shard adds up the sums of all blocks: each key comes once per block,
   so frequent words weigh no more than rare ones, and shards are even.
3. The shard answers each block with the totals of the keys it sent, in the
   same order, as counts alone. So a block gets what its own tokens need, and no
   task ever holds the model. Rows between blocks and shards are never more
   than the distinct pairs of all blocks, what a plain shuffle would move.
4. Blocks of deleted documents give the held-out counts for the weights, which
   come to the driver as three sums per bucket; then all blocks are scored.

Tokens are runs of non-space characters with A-Z lowered, and an end mark per
document, which is also the context of its first token.

Defined results: a null, empty or blank text is the end mark alone; a null id
belongs to the training documents; repeated rows count again; without training
documents N and V are 0 and every token has probability 1; an empty table gives
an empty result.
"""

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from mediarec.llm.common import id_remainder
from mediarec.operators.staging import stage

BUCKETS = 64
_END = b"\n"          # no word holds a line feed
TRAIN, DELETED, OTHER = 0, 1, 2
_PAIR_BYTES = 6       # 48 bits of a pair's hash, besides those that choose the shard


def _put(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; small numbers take little."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not wide[:, used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(wide[:, :used].T.tobytes())


def _get(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :data[0]] = planes.T
    return wide.view("<u8").reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _block(kind, docs: list, roles: list, texts: list) -> pa.RecordBatch:
    """One row for the documents collected."""
    words: list[bytes] = []
    sizes = []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        own.append(_END)
        words += own
        sizes.append(len(own))
    # As objects one by one: numpy would pad the words to one length.
    held = np.empty(len(words), object)
    held[:] = words
    tokens, distinct = pd.factorize(held)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    # Frequent words get small numbers, which compress well.
    order = np.argsort(-np.bincount(tokens, minlength=len(distinct)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.array([int(roles[0] == DELETED)], pa.int32()), pa.array([len(words)], pa.int64()),
         pa.array([docs], pa.list_(kind)), pa.array([roles], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())),
         pa.array([hashes[order].astype("<u8").tobytes()], pa.binary()), pa.array([_put(number[tokens])], pa.binary())],
        names=["block", "deleted", "n", "docs", "roles", "sizes", "words", "tokens"])


def _blocks(size: int):
    def run(batches):
        waiting = {True: ([], [], []), False: ([], [], [])}
        held = {True: 0, False: 0}
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, role, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "role", "text"))):
                side = role == DELETED
                for column, value in zip(waiting[side], (doc, role, text)):
                    column.append(value)
                held[side] += len(text or "")
                if held[side] >= 6 * size:  # about six characters a token
                    yield _block(kind, *waiting[side])
                    waiting[side], held[side] = ([], [], []), 0
        for columns in waiting.values():
            if columns[0]:
                yield _block(kind, *columns)
    return run


def _pairs(tokens: np.ndarray, v: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, token) codes of a block, sorted, and the code number of every token."""
    before = np.empty_like(tokens)
    before[0] = end
    before[1:] = tokens[:-1]
    return np.unique(before * np.uint64(v) + tokens, return_inverse=True)


def _keys(words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    v = np.uint64(len(words))
    return _mixed(words[(codes // v).astype(np.intp)] * np.uint64(0x9E3779B97F4A7C15) + words[(codes % v).astype(np.intp)])


def _end_of(sizes: np.ndarray, tokens: np.ndarray) -> int:
    return int(tokens[sizes[0] - 1])  # the last token of a document


def _shard_order(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by shard, and where shards start in it."""
    shard = (keys >> np.uint64(40)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def _sums(shards: int):
    """For every block, rows (shard, block, order, keys, fit, deleted) with its own counts."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row].as_py() for c in ("block", "roles", "sizes", "words", "tokens")}
                words, tokens = np.frombuffer(get["words"], "<u8"), _get(get["tokens"])
                sizes = np.array(get["sizes"])
                role = np.repeat(np.array(get["roles"]), sizes)
                codes, at = _pairs(tokens, len(words), _end_of(sizes, tokens))
                out = {c: [] for c in ("shard", "block", "order", "keys", "fit", "deleted")}
                for order_, keys, where, width in ((1, words, tokens.astype(np.intp), 8), (2, _keys(words, codes), at, _PAIR_BYTES)):
                    fit = np.bincount(where[role == TRAIN], minlength=len(keys))
                    deleted = np.bincount(where[role == DELETED], minlength=len(keys))
                    order, start = _shard_order(keys, shards)
                    for s in range(shards):
                        mine = order[start[s]:start[s + 1]]
                        if not len(mine):
                            continue
                        out["shard"].append(s)
                        out["block"].append(get["block"])
                        out["order"].append(order_)
                        out["keys"].append(np.ascontiguousarray(keys[mine], "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
                        out["fit"].append(_put(fit[mine]))
                        out["deleted"].append(_put(deleted[mine]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["shard"], pa.int32()), pa.array(out["block"], pa.string()), pa.array(out["order"], pa.int32()),
                     *[pa.array(out[c], pa.binary()) for c in ("keys", "fit", "deleted")]], names=list(out))
    return run


def _totals(table):
    """A shard's totals, sent back to the blocks; rows without a block hold sums and numbers of known words."""
    out = {c: [] for c in ("shard", "block", "order", "fit", "total")}
    shard = table.column("shard")[0].as_py()
    for order_, width in ((1, 8), (2, _PAIR_BYTES)):
        rows = [r for r in range(table.num_rows) if table.column("order")[r].as_py() == order_]
        if not rows:
            continue
        parts, fit, deleted = [], [], []
        for r in rows:
            data = np.frombuffer(table.column("keys")[r].as_py(), np.uint8).reshape(-1, width)
            wide = np.zeros((len(data), 8), np.uint8)
            wide[:, :width] = data
            parts.append(wide.view("<u8").reshape(-1))
            fit.append(_get(table.column("fit")[r].as_py()))
            deleted.append(_get(table.column("deleted")[r].as_py()))
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        # Weighted counts are exact up to 2**53.
        f = np.bincount(at, np.concatenate(fit), len(keys)).astype(np.uint64)
        t = f + np.bincount(at, np.concatenate(deleted), len(keys)).astype(np.uint64)
        if order_ == 1:
            for name, x in (("sum", (f.sum(), t.sum())), ("known", ((f > 0).sum(), (t > 0).sum()))):
                out["shard"].append(-1 if name == "sum" else -2)
                out["block"].append(None)
                out["order"].append(0)
                out["fit"].append(_put(np.array([x[0]], np.uint64)))
                out["total"].append(_put(np.array([x[1]], np.uint64)))
        start = 0
        for r, part in zip(rows, parts):
            mine = at[start:start + len(part)]
            start += len(part)
            out["shard"].append(shard)
            out["block"].append(table.column("block")[r].as_py())
            out["order"].append(order_)
            out["fit"].append(_put(f[mine]))
            out["total"].append(_put(t[mine]))
    return pa.table({"shard": pa.array(out["shard"], pa.int32()), "block": pa.array(out["block"], pa.string()),
                     "order": pa.array(out["order"], pa.int32()), "fit": pa.array(out["fit"], pa.binary()),
                     "total": pa.array(out["total"], pa.binary())})


def _answer(block, answers, shards: int, which: str):
    """(tokens, sizes, count of each token, of its context, of the pair) of one block."""
    tokens, sizes = _get(block.column("tokens")[0].as_py()), np.array(block.column("sizes")[0].as_py())
    words = np.frombuffer(block.column("words")[0].as_py(), "<u8")
    end = _end_of(sizes, tokens)
    codes, at = _pairs(tokens, len(words), end)
    rows = {(o, s): r for r, (o, s) in enumerate(zip(answers.column("order").to_pylist(), answers.column("shard").to_pylist()))}
    found = []
    for order_, keys in ((1, words), (2, _keys(words, codes))):
        order, start = _shard_order(keys, shards)
        count = np.zeros(len(keys))
        for s in range(shards):
            mine = order[start[s]:start[s + 1]]
            if len(mine):
                count[mine] = _get(answers.column(which)[rows[order_, s]].as_py())
        found.append(count)
    t = tokens.astype(np.intp)
    own = found[0][t]
    context = np.empty_like(own)
    context[0], context[1:] = found[0][end], own[:-1]
    return sizes, own, context, found[1][at]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def _step(weights: np.ndarray, floor: float):
    """One expectation step over held-out tokens: per bucket, the share of each component."""
    def run(batches):
        total = np.zeros((BUCKETS, 3))
        for batch in batches:
            for b, p2, p1 in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pair", "word"))):
                b = np.frombuffer(b, np.uint8)
                mix = weights[b] * np.stack([np.frombuffer(p2, "<f4"), np.frombuffer(p1, "<f4"), np.full(len(b), floor)], 1)
                mix /= mix.sum(1, keepdims=True)
                for k in range(3):
                    total[:, k] += np.bincount(b, mix[:, k], BUCKETS)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, k]) for k in range(3)]], names=["bucket", "a", "b", "d"])
    return run


def _normal(weights: np.ndarray, words: bool) -> np.ndarray:
    """Each bucket's weights over the parts it has: no pairs after an unseen context, no words without training."""
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0
    if not words:
        weights[:, :2] = 0
    return weights / weights.sum(1, keepdims=True)


def learn_weights(heldout: DataFrame, floor: float, words: bool, rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, uniform) per bucket by expectation-maximisation; three sums per bucket reach the driver.

    Ends when no weight moves by a thousandth, which takes some twenty rounds; `words` says whether there is a word count at all.
    """
    weights = _normal(np.ones((BUCKETS, 3)), words)
    for _ in range(rounds):
        got = heldout.mapInArrow(_step(weights, floor), "bucket int, a double, b double, d double").groupBy("bucket").agg(F.sum("a"), F.sum("b"), F.sum("d")).collect()
        sums = np.zeros((BUCKETS, 3))
        for r in got:
            sums[r[0]] = r[1:]
        whole = sums.sum(0) / sums.sum() if sums.sum() else np.full(3, 1 / 3)
        # A bucket seen little leans on the shares over all buckets, by three tokens' worth.
        new = _normal((sums + 3 * whole) / (sums.sum(1, keepdims=True) + 3), words)
        done = np.abs(new - weights).max() < 1e-3
        weights = new
        if done:
            break
    return weights


def scores(docs: DataFrame, training: Column, deleted: Column, block: int = 2_000_000, shard_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all `docs` (doc_id, text).

    `training` says which documents the model learns from, `deleted` which of
    them are held out of the counts that the mixture weights are learned with.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    role = F.when(~training, OTHER).when(deleted, DELETED).otherwise(TRAIN)
    blocks = stage(docs.select("doc_id", role.alias("role"), "text").mapInArrow(
        _blocks(block), f"block string, deleted int, n bigint, docs array<{kind}>, roles array<int>, sizes array<int>, words binary, tokens binary"), "lm-blocks")
    shards = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // shard_tokens))
    totals = stage(blocks.select("block", "roles", "sizes", "words", "tokens").mapInArrow(
        _sums(shards), "shard int, block string, order int, keys binary, fit binary, deleted binary")
        .groupBy("shard").applyInArrow(_totals, "shard int, block string, order int, fit binary, total binary"), "lm-totals")
    known = {-1: [0, 0], -2: [0, 0]}
    for r in totals.where(F.col("block").isNull()).select("shard", "fit", "total").collect():  # two rows per shard
        known[r[0]][0] += int(_get(r[1])[0])
        known[r[0]][1] += int(_get(r[2])[0])
    (fit_n, n), (fit_v, v) = known[-1], known[-2]
    answers = totals.where(F.col("block").isNotNull())

    def held_out(left, right):
        sizes, own, context, pair = _answer(left, right, shards, "fit")
        p2 = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
        return pa.table({"bucket": [_bucket(context).astype(np.uint8).tobytes()], "pair": [p2.astype("<f4").tobytes()],
                         "word": [(own / max(fit_n, 1)).astype("<f4").tobytes()]})

    narrow = blocks.select("block", "deleted", "docs", "sizes", "words", "tokens")
    some = narrow.where("deleted = 1")
    heldout = stage(some.groupBy("block").cogroup(answers.join(F.broadcast(some.select("block")), "block").groupBy("block")).applyInArrow(
        held_out, "bucket binary, pair binary, word binary"), "lm-heldout")
    weights = learn_weights(heldout, 1 / (fit_v + 1), n > 0)

    def scored(left, right):
        sizes, own, context, pair = _answer(left, right, shards, "total")
        p2 = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
        w = weights[_bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * own / max(n, 1) + w[:, 2] / (v + 1)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = [np.add.reduceat(x, at) for x in ((own > 0).astype(np.int64), np.log10((own + 1) / (n + v + 1)), np.log10(p))]
        ids = left.column("docs").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(sums[0], pa.int64()),
                         "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return narrow.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def scored_documents(docs: DataFrame) -> DataFrame:
    """Scores of `docs`, learned from those whose id is not in remainder 2 of 7."""
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    training = id_remainder(F.col("doc_id"), 7) != 2
    return scores(docs, training, F.floor(crc / 7) % 20 == 0)
