"""Best-two-fit packing of token sequences.

Every document is tokenized and closed with an end id; only documents longer
than a sequence are cut. What matters for packing is a piece's length alone,
and there are at most `size` lengths, so the plan is made from the counts per
length: a bin is filled greedily with the longest pieces that fit, then its
smallest piece is replaced by two unpacked pieces that fit the expanded gap
more tightly, as long as that helps; the filled bin is then repeated as often
as the counts allow. The plan has a few thousand rows whatever the corpus size
(each bin uses up a length).

Pieces find their place by their rank among pieces of their length. Ranks come
from salted groups, so a length that a third of all pieces have is split over
many tasks; the plan is looked up by binary search. Texts are never shuffled.

Defined results: a null or blank text is the end id alone; repeated rows are
packed like different ones; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from mediarec.llm.word_cache import LetterCache, portions, word_cache
from mediarec.operators.staging import stage

SIZE = 2048
SALT_ROWS = 10_000


# A full stop or comma after anything but an ASCII or Latin-1 letter, a digit or a space: it may belong to a longer run.
_RUN = re.compile(rb"(?<![a-z0-9 ])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,][ \n]")


def _words(text: str | None) -> list[bytes]:
    """Words that encode one by one like the whole text, for a tokenizer that drops white space and lowers capitals.

    No token, normalization or pattern of such a tokenizer reaches over white
    space. Lowering ASCII and parting a single mark from its word change
    nothing either, and leave fewer different words; texts where they might
    (added tokens in capitals, runs of marks) are only split.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if b"<|" not in data:
        data = data.lower()
        if not _RUN.search(data):
            data = data.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")
    return data.split()


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    cache = word_cache(path, kind=LetterCache)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids = batch.column("doc_id")
        at = 0
        for run in portions([t or "" for t in batch.column("text").to_pylist()]):
            split = [_words(t) for t in run]
            cache.learn(set().union(*split))
            row, piece, start, length, crc = [], [], [], [], []
            for k, words in enumerate(split):
                data = cache.join(words) + end
                n = len(data) // 4
                for p, s in enumerate(range(0, n, size)):
                    part = data[4 * s:4 * (s + size)]
                    row.append(at + k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at += len(run)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the sequences' parts; `tokenizer` is the path of a tokenizers file."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _pieces(batches, tokenizer, size, end_id),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _largest(left: list[int], most: int) -> int:
    """The longest length up to `most` that is left, 0 if there is none."""
    while most and not left[most]:
        most -= 1
    return most


def _two(left: list[int], room: int, above: int) -> tuple[int, int] | None:
    """Two lengths left with the largest sum that is over `above` and at most `room`."""
    best, pick = above, None
    small, large = 1, min(room - 1, len(left) - 1)
    while small <= large:
        if not left[small] or (small == large and left[small] < 2):
            small += 1
        elif not left[large]:
            large -= 1
        elif small + large > room:
            large -= 1
        else:
            if small + large > best:
                best, pick = small + large, (large, small)
            small += 1
    return pick


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: how many}, copies), from the number of pieces of each length."""
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] = n
    out = []
    top = _largest(left, size)
    while top:
        held = {top: 1}
        left[top] -= 1
        gap = size - top
        while gap and (fit := _largest(left, gap)):
            k = min(left[fit], gap // fit)
            held[fit] = held.get(fit, 0) + k
            left[fit] -= k
            gap -= k * fit
        while gap and sum(held.values()) > 1:
            smallest = min(held)
            two = _two(left, gap + smallest, smallest)
            if not two:
                break
            held[smallest] -= 1
            left[smallest] += 1
            if not held[smallest]:
                del held[smallest]
            for x in two:
                held[x] = held.get(x, 0) + 1
                left[x] -= 1
            gap += smallest - sum(two)
        more = min(left[x] // k for x, k in held.items())
        for x, k in held.items():
            left[x] -= more * k
        out.append((held, more + 1))
        top = _largest(left, top)
    return out


def _table(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Plan rows (length, first rank, how many per bin, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for held, copies in bins:
        offset = 0
        for length in sorted(held, reverse=True):
            k = held[length]
            rows.append((length, used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * copies
            offset += k * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _places(batches: Iterator[pa.RecordBatch], table: np.ndarray, columns: list[str]) -> Iterator[pa.RecordBatch]:
    # The rows of a length lie together, ordered by rank.
    first = {int(x): int(np.searchsorted(table[:, 0], x)) for x in np.unique(table[:, 0])}
    last = {x: int(np.searchsorted(table[:, 0], x, "right")) for x in first}
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            mine = length == x
            at[mine] = first[int(x)] + np.searchsorted(table[first[int(x)]:last[int(x)], 1], rank[mine], "right") - 1
        _, start, k, sequence, offset = table[at].T
        done = rank - start
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in columns], pa.array(sequence + done // k), pa.array(offset + done % k * length)],
            names=[*columns, "sequence_id", "offset"])


def ranked(parts: DataFrame) -> DataFrame:
    """`parts` with `rank`, their place among the pieces of their length, from 0 without gaps."""
    n = parts.count()
    salts = max(1, -(-n // SALT_ROWS))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    own = salted.withColumn("own", F.row_number().over(inside) - 1)
    return own.join(starts, ["length", "salt"]).withColumn("rank", (F.col("before") + F.col("own")).cast("long")).drop("salt", "own", "before")


def packed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """`parts` (a staged table) with sequence_id and offset."""
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}  # at most `size` rows
    table = _table(plan(counts, size))
    columns = parts.columns
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in columns)
    return ranked(parts).select(*columns, "rank").mapInArrow(
        lambda batches: _places(batches, table, columns), f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Pieces of all `docs` with their places."""
    return packed(stage(pieces(docs, tokenizer, size, end_id), "pieces"), size)
