"""One side of a factorization from the other: least squares per id, in blocks of ids.

The ids of a side are dealt into blocks. A block's ratings are packed once, by
rising id, in a folder of their own. A block is one task: it scans its folder and
the vectors of the other side, holds those it has a rating of, and solves all its
equations. So a step shuffles nothing, and its tables are all that it has on disk.
Vectors lie some hundreds to a row, so that a scan hands over whole stretches of
memory; with them lie the blocks' sums of y y', which the next step adds up in its
tasks: a step is one job. An id with n ratings up to the rank is solved in its
n x n dual form, the others in their rank x rank form; both are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediarec.config import AlsConfig
from mediarec.operators.staging import CLEANED, settings, stage

_BLOCK_BYTES = 640 << 20  # vectors that a task may hold
_CELLS = 1 << 21          # numbers in a batch of equations
_CELL_BYTES = 128 << 10   # vectors in a cell; the Parquet writer looks at its memory every hundred rows
_PART = 1 << 15           # ratings in a cell
_ROWS = 10_000
_LEAST = 200_000          # ratings that make a block of their own worthwhile
_MIX = 2654435761
# Blocks, of one partition each, stay tasks of their own in a union.
# Packed rows are some hundred kilobytes wide, of numbers that hardly compress.
_STEPS = CLEANED | {"spark.sql.unionOutputPartitioning": "false", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_WIDE = _STEPS | {
    "spark.sql.parquet.columnarReaderBatchSize": "128", "spark.sql.parquet.compression.codec": "uncompressed", "parquet.enable.dictionary": "false"}
# Numbers as little-endian bytes: lists would be written and read element by element.
_PACKED = "block int, src binary, y binary, dst binary, r binary, parts int, gram binary"
_FACTORS = "ids binary, features binary, blocks int, gram binary"
_SCHEMAS = {ddl: pa.schema([(n, {"int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in ddl.split(", "))]) for ddl in (_PACKED, _FACTORS)}


def step_settings(spark: SparkSession, wide: bool = False):
    """Settings of the jobs of a factorization's steps; `wide` of those that read packed rows."""
    return settings(spark, _WIDE if wide else _STEPS)


def block_of(col, blocks: int):
    """Block of an id, as a Spark column; `_block` is the same for numpy."""
    return F.pmod(F.shiftright(F.col(col).cast("long") * F.lit(_MIX), 16), F.lit(blocks)).cast("int")


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.astype(np.int64) * _MIX >> 16) % blocks).astype(np.int32)


def block_count(spark: SparkSession, own: int, far: int, ratings: int, rank: int) -> int:
    """Blocks for `own` ids, so that a block's vectors of both sides stay within `_BLOCK_BYTES` where ratings are spread evenly."""
    cores = spark.sparkContext.defaultParallelism
    room = _BLOCK_BYTES // (4 * rank)
    blocks = cores = max(1, min(cores, ratings // _LEAST))
    while own / blocks + far * -math.expm1(ratings / max(1, far) * math.log1p(-1 / blocks) if blocks > 1 else -math.inf) > room:
        blocks += cores
    return blocks


def pack_links(ratings: DataFrame, own: str, far: str, blocks: int) -> DataFrame:
    """Ratings (`own`, `far`, `r`) by block of `own` and in it by rising `own`, some thousands a row; staged, a folder per block.

    They are packed before they are dealt out, so that the shuffle has as many rows as cells.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dst", "src", "r")])
            n += batch.num_rows
            if n >= _PART * blocks:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    def dealt(held: list) -> Iterator[pa.RecordBatch]:
        dst, src, r = (np.concatenate(c) for c in zip(*held))
        at = _block(dst, blocks)
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            for some in np.array_split(rows, -(-len(rows) // _PART)):
                yield _row(_PACKED, block=int(at[rows[0]]), src=src[some], dst=dst[some], r=r[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, b in enumerate(batch.column("block").to_pylist()):
                held.setdefault(b, []).append([_numbers(batch, c, i, kind).copy() for c, kind in (("dst", np.int32), ("src", np.int32), ("r", np.float32))])
        while held:
            b, cells = held.popitem()
            dst, src, r = (np.concatenate(c) for c in zip(*cells))
            cells.clear()
            order = np.argsort(dst, kind="stable")
            parts = -(-len(order) // _PART)
            for some in np.array_split(order, parts):
                yield _row(_PACKED, block=b, src=src[some], dst=dst[some], r=r[some], parts=parts)

    rows = ratings.select(F.col(own).alias("dst"), F.col(far).alias("src"), F.col("r"))
    return stage(rows.mapInArrow(deal, _PACKED).repartitionById(blocks, F.col("block")).mapInArrow(run, _PACKED), "links", "block")


def _row(ddl: str, **cells) -> pa.RecordBatch:
    """One row: arrays as their bytes, what isn't given as null."""
    schema = _SCHEMAS[ddl]
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes() if isinstance(v := cells.get(f.name), np.ndarray) else v], f.type) for f in schema],
                                      schema=schema)


def _vector_rows(ids: np.ndarray, x: np.ndarray, blocks: int, gram: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Vectors, a row for each some hundred of them; `gram` goes with the last."""
    step = max(1, _CELL_BYTES // (4 * x.shape[1]))
    for lo in range(0, len(ids), step):
        yield _row(_FACTORS, ids=ids[lo:lo + step], features=x[lo:lo + step], blocks=blocks, gram=gram if lo + step >= len(ids) else None)


def _numbers(batch: pa.RecordBatch, name: str, i: int, kind: type) -> np.ndarray | None:
    cell = batch.column(name)[i].as_buffer()
    return None if cell is None else np.frombuffer(cell, kind)


def as_lists(factors: DataFrame) -> DataFrame:
    """(`id`, `features`) of a step's result, with lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = _numbers(batch, "ids", i, np.int32), _numbers(batch, "features", i, np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (len(x) // len(ids))), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "features"])

    return factors.select("ids", "features").mapInArrow(run, "id int, features array<float>")


def pack_vectors(factors: DataFrame, blocks: int, grams: bool = False) -> DataFrame:
    """Vectors (`id`, `features`) for `blocks` blocks of the other side, with the sums of y y' if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for batch in batches:
            if batch.num_rows:
                if last is not None:
                    yield from _vector_rows(*last, blocks)
                ids = batch.column("id").to_numpy()
                y = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1)
                if grams:
                    total = total + _gram(y)
                last = ids, y
        if last is not None:
            yield from _vector_rows(*last, blocks, total if grams else None)

    return factors.select(F.col("id").cast("int").alias("id"), "features").mapInArrow(run, _FACTORS)


def with_blocks(factors: DataFrame, ratings: DataFrame, key: str, far: str, blocks: int, grams: bool = False) -> DataFrame:
    """Vectors (`id`, `features`) of the ids that have a rating, for the blocks of the other side."""
    return pack_vectors(factors.join(ratings.select(F.col(key).alias("id")).distinct(), "id", "left_semi"), blocks, grams)


def _gram(y: np.ndarray) -> np.ndarray:
    """Sum of y y': rank x rank, whatever the number of rows."""
    total = np.zeros((y.shape[1], y.shape[1]))
    for lo in range(0, len(y), _ROWS):
        part = y[lo:lo + _ROWS].astype(np.float64)
        total += part.T @ part
    return total


def _sent(factors: DataFrame, block: int | None = None) -> DataFrame:
    """Vectors for each block they go to, or for one block: a row of them once a block, whatever the ratings."""
    to = "explode(sequence(0, blocks - 1))" if block is None else str(block)
    return factors.selectExpr(f"{to} AS block", "ids AS src", "features AS y", "CAST(NULL AS binary) AS dst", "CAST(NULL AS binary) AS r",
                              "CAST(NULL AS int) AS parts", "gram")


def _owned(factors: DataFrame, blocks: int, block: int) -> DataFrame:
    """Vectors (`id`, `features`), as lists, of a block's own ids, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _row(_PACKED, block=block, y=batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float32),
                           dst=batch.column("id").to_numpy())

    return factors.where(block_of("id", blocks) == block).select(F.col("id").cast("int").alias("id"), "features").mapInArrow(run, _PACKED)


def _places(ids: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The different `ids`, rising, and what finds the place of an id among them, -1 for others."""
    low, high = int(ids.min()), int(ids.max())
    if high - low < 8 * len(ids) + _ROWS:
        table = np.full(high - low + 1, -1, np.int32)
        table[ids - low] = 0
        known = np.flatnonzero(table + 1)
        table[known] = np.arange(len(known), dtype=np.int32)

        def find(some: np.ndarray) -> np.ndarray:
            inside = (some >= low) & (some <= high)
            return table[some - low] if inside.all() else np.where(inside, table[np.where(inside, some, low) - low], -1)
        return (known + low).astype(np.int32), find
    known = np.unique(ids)

    def search(some: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, some), len(known) - 1)
        return np.where(known[at] == some, at, -1)
    return known, search


class _Block:
    """A block's ratings, by rising own id, the vectors of the other side that they need, and its own vectors if sent."""

    def __init__(self, rank: int):
        self.rank, self.gram, self.y = rank, 0, None
        self._parts, self._early, self._own = [], [], []

    def read(self, batches: Iterator[pa.RecordBatch]) -> bool:
        """Whether the block has any ratings."""
        for batch in batches:
            for i in range(batch.num_rows):
                src, dst = _numbers(batch, "src", i, np.int32), _numbers(batch, "dst", i, np.int32)
                gram = _numbers(batch, "gram", i, np.float64)
                if gram is not None:
                    self.gram = self.gram + gram.reshape(self.rank, self.rank)
                if (y := _numbers(batch, "y", i, np.float32)) is None:
                    self._parts.append((dst.copy(), src.copy(), _numbers(batch, "r", i, np.float32).copy()))
                    if len(self._parts) == batch.column("parts")[i].as_py():
                        self._link()
                elif src is None:
                    self._own.append((dst.copy(), y.reshape(-1, self.rank).copy()))
                elif self.y is not None:
                    self._hold(src, y.reshape(-1, self.rank))
                else:  # a scan may bring vectors before the last ratings
                    self._early.append((src.copy(), y.reshape(-1, self.rank).copy()))
        return self.y is not None

    def _link(self) -> None:
        dst, src, self.r = (np.concatenate(c) for c in zip(*sorted(self._parts, key=lambda part: (part[0][0], part[0][-1]))))
        self._parts.clear()
        self.first = np.flatnonzero(np.diff(dst, prepend=dst[0] - np.int64(1)))
        self.ids, self.count = dst[self.first], np.diff(self.first, append=len(dst))
        known, self._find = _places(src)
        self.at = self._find(src)
        self.y = np.zeros((len(known), self.rank), np.float32)
        while self._early:
            self._hold(*self._early.pop())

    def _hold(self, ids: np.ndarray, y: np.ndarray) -> None:
        at = self._find(ids)
        need = at >= 0
        if need.all():
            self.y[at] = y
        else:
            self.y[at[need]] = y[need]

    def turn(self, by: np.ndarray) -> None:
        """Turn the vectors held, in place."""
        for lo in range(0, len(self.y), _ROWS):
            self.y[lo:lo + _ROWS] = self.y[lo:lo + _ROWS].astype(np.float64) @ by

    def own(self) -> np.ndarray:
        """Own vectors in the order of the ids."""
        ids, x = (np.concatenate(c) for c in zip(*self._own))
        order = np.argsort(ids)
        return x[order[np.searchsorted(ids, self.ids, sorter=order)]]


def _by_block(links: DataFrame, blocks: int, factors: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The links of every block with the vectors that it needs, and its own ones if given; a partition per block.

    A block's task scans its folder of links and the vectors, `factors` staged with their blocks and `own` as a model has
    them: nothing is shuffled.
    """
    found, links = [], links.select(*_SCHEMAS[_PACKED].names)
    for b in range(blocks):
        rows = links.where(f"block = {b}").union(_sent(factors, b))
        if own is not None:
            rows = rows.union(_owned(own.coalesce(1), blocks, b))
        found.append(rows.coalesce(1))
    while len(found) > 1:  # in pairs: a union looks through all that it holds
        found = [reduce(DataFrame.union, found[i:i + 2]) for i in range(0, len(found), 2)]
    return found[0]


def solve_side(links: DataFrame, blocks: int, factors: DataFrame, far_blocks: int, cfg: AlsConfig) -> DataFrame:
    """The vectors of the links' own side, packed for `far_blocks` blocks, from those of the other side; staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Block(cfg.rank)
        if not held.read(batches):
            return
        turn = None
        if cfg.implicit:
            eigen, turn = np.linalg.eigh(held.gram)
            held.turn(turn)
        solver = _implicit(cfg, np.maximum(eigen, 0)) if cfg.implicit else _explicit(cfg)
        x = np.empty((len(held.ids), cfg.rank), np.float32)
        for rows, found in _solved(held.first, held.count, held.at, held.r, held.y, cfg.rank, solver):
            x[rows] = found if turn is None else found @ turn.T
        yield from _vector_rows(held.ids, x, far_blocks, _gram(x) if cfg.implicit else None)

    with step_settings(links.sparkSession, wide=True):
        return stage(_by_block(links, blocks, factors).mapInArrow(run, _FACTORS), "factors")


def _solved(first: np.ndarray, count: np.ndarray, at: np.ndarray, r: np.ndarray, y: np.ndarray, rank: int,
            solver: tuple[Callable, Callable, Callable]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of ids, their vectors): ids of as many ratings together in the dual form, the others by sums over their ratings."""
    dual, sums, plain = solver
    order = np.argsort(count, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(count[order])) + 1):
        n = int(count[same[0]])
        if n > rank:
            break
        step = max(1, _CELLS // (n * rank))
        for lo in range(0, len(same), step):
            rows = first[same[lo:lo + step], None] + np.arange(n)
            yield same[lo:lo + step], dual(y.take(at[rows], 0).astype(np.float64), r[rows].astype(np.float64))
    many = np.flatnonzero(count > rank)
    step = max(1, _CELLS // rank ** 2)
    for lo in range(0, len(many), step):
        parts = []
        for g in many[lo:lo + step]:
            total = 0
            for start in range(first[g], first[g] + count[g], _CELLS // rank + 1):
                rows = slice(start, min(start + _CELLS // rank + 1, first[g] + count[g]))
                total = sums(y.take(at[rows], 0).astype(np.float64), r[rows].astype(np.float64)) + total
            parts.append(total)
        yield many[lo:lo + step], plain(np.array(parts))


def _by(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(left, right[..., None])[..., 0]


def _explicit(cfg: AlsConfig) -> tuple[Callable, Callable, Callable]:
    """sum (y'x - r) y + reg n x = 0, or x = Y' (Y Y' + reg n)^-1 r."""
    def dual(y: np.ndarray, r: np.ndarray) -> np.ndarray:
        n = y.shape[1]
        w = _by(y @ y.swapaxes(1, 2) + cfg.reg * n * np.eye(n), r)
        return (w[:, None] @ y)[:, 0]

    def sums(y: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.vstack([y.T @ y + cfg.reg * len(y) * np.eye(cfg.rank), r @ y])

    def plain(total: np.ndarray) -> np.ndarray:
        return _by(total[:, :-1], total[:, -1])

    return dual, sums, plain


def _implicit(cfg: AlsConfig, eigen: np.ndarray) -> tuple[Callable, Callable, Callable]:
    """G x + sum (c y'x - (1 + c) p) y + reg n x = 0, turned so that G is diagonal.

    With D = G + reg n, C of the c and v of the (1 + c) p, the solution
    (D + Y'CY)^-1 Y'v is D^-1 Y' (1 + C Y D^-1 Y')^-1 v, computed with Y D^-1/2. Without a positive rating it is 0.
    """
    def dual(y: np.ndarray, r: np.ndarray) -> np.ndarray:
        c, liked = np.abs(r), r > 0
        n = liked.sum(1, keepdims=True)
        root = np.sqrt(1 / np.where(n > 0, eigen + cfg.reg * n, 1.0))
        y *= root[:, None]
        w = _by(np.eye(r.shape[1]) + c[..., None] * (y @ y.swapaxes(1, 2)), (1 + c) * liked)
        return (w[:, None] @ y)[:, 0] * root

    def sums(y: np.ndarray, r: np.ndarray) -> np.ndarray:
        c, liked = np.abs(r), r > 0
        return np.vstack([(c[:, None] * y).T @ y + cfg.reg * liked.sum() * np.eye(cfg.rank), ((1 + c) * liked) @ y])

    def plain(total: np.ndarray) -> np.ndarray:
        left, right = total[:, :-1] + np.diag(eigen), total[:, -1]
        left[~right.any(1)] = np.eye(cfg.rank)
        return _by(left, right)

    return dual, sums, plain


def residuals(links: DataFrame, blocks: int, factors: DataFrame, own: DataFrame, cfg: AlsConfig) -> DataFrame:
    """(`id`, `n`, `residual`) of the links' own side: |Ax - b| / |b| of each id's equations, |Ax - b| where b is 0; staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Block(cfg.rank)
        if not held.read(batches):
            return
        ids, first, count, at, r, y, mine = held.ids, held.first, held.count, held.at, held.r.astype(np.float64), held.y, held.own()
        whole = held.gram if cfg.implicit else np.zeros((cfg.rank, cfg.rank))
        c, liked = (np.abs(r), r > 0) if cfg.implicit else (np.ones(len(r)), np.ones(len(r), bool))
        right, n = ((1 + c) * liked if cfg.implicit else r), np.add.reduceat(liked.astype(np.float64), first)
        share = np.empty(len(ids))
        for lo, hi in _spans(first, count, _CELLS // cfg.rank):
            x = mine[lo:hi].astype(np.float64)
            left, b = np.zeros_like(x), np.zeros_like(x)
            end = first[hi - 1] + count[hi - 1]
            for start in range(first[lo], end, _CELLS // cfg.rank + 1):
                rows = slice(start, min(start + _CELLS // cfg.rank + 1, end))
                who = np.searchsorted(first[lo:hi], np.arange(rows.start, rows.stop), side="right") - 1
                far = y.take(at[rows], 0).astype(np.float64)
                edge = np.flatnonzero(np.diff(who, prepend=-1))
                left[who[edge]] += np.add.reduceat((c[rows] * (far * x[who]).sum(1))[:, None] * far, edge)
                b[who[edge]] += np.add.reduceat(right[rows, None] * far, edge)
            off = np.linalg.norm(x @ whole + left + cfg.reg * n[lo:hi, None] * x - b, axis=1)
            size = np.linalg.norm(b, axis=1)
            share[lo:hi] = np.divide(off, size, out=off.copy(), where=size > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(count, pa.int64()), pa.array(share)], names=["id", "n", "residual"])

    with step_settings(links.sparkSession, wide=True):
        return stage(_by_block(links, blocks, factors, own).mapInArrow(run, "id int, n long, residual double"), "residuals")


def _spans(first: np.ndarray, count: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of ids of about `rows` ratings together."""
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first + count, first[lo] + rows, side="right")))
        yield lo, hi
        lo = hi
