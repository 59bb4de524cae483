"""Regression of content vectors onto collaborative vectors.

Training rows stay on the executors. An epoch deals all rows to global
minibatches by a hash of seed, epoch and item; a step is one job over the rows
of one minibatch: every task hands back its gradient in chunks that Spark
adds up by a grouped aggregate, and the driver makes the Adam step. Linear maps
of wide inputs are found by conjugate gradients, one such sum an iteration. The
driver only ever holds the weights, whose size the model sets.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediarec.config import FusionConfig
from mediarec.operators import fusion_net as net
from mediarec.operators.staging import drop_path, fresh_path, stage
from mediarec.schemas import require_columns

_CHUNK = 4096
_TASK_ROWS = 256  # rows of a minibatch that make a task of their own worth its gradient's size
# Inputs up to this width are solved by their Gram matrix (8 MB), wider ones by conjugate gradients.
GRAM_WIDTH = 1024
_MIN_GRAM_ROWS = 4  # rows per Gram column that make a separate partial sum worth its size
_CELL = 1 << 20     # bytes of input rows in one cell of the tables that conjugate gradients read


@dataclass
class FusionModel:
    """Fitted weights with the losses per epoch."""

    cfg: FusionConfig
    dims: dict[str, int]
    params: net.Params
    losses: list[tuple[int, float, float]]

    def weights_table(self, spark: SparkSession) -> DataFrame:
        """(`name`, `shape`, `chunk`, `vec`): weights cut into chunks."""
        rows = [(n, list(p.shape), i, c.tolist())
                for n, p in self.params.items() for i, c in _chunks(p)]
        return spark.createDataFrame(rows, "name string, shape array<int>, chunk int, vec array<double>")

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.losses, "epoch int, train_loss double, valid_loss double")


def load_weights(table: DataFrame) -> net.Params:
    """Weights from a `weights_table`; their size is set by the network, not by the data."""
    parts: dict[str, list] = {}
    shapes = {}
    for r in table.orderBy("name", "chunk").collect():
        parts.setdefault(r["name"], []).append(np.array(r["vec"]))
        shapes[r["name"]] = tuple(r["shape"])
    return {n: np.concatenate(c).reshape(shapes[n]) for n, c in parts.items()}


def _chunks(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    flat = p.ravel()
    for i in range(0, len(flat), _CHUNK):
        yield i // _CHUNK, flat[i:i + _CHUNK]


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()).astype(np.float64)


def _inputs(pdf: pd.DataFrame, cfg: FusionConfig) -> dict[str, np.ndarray]:
    return {m: _matrix(pdf[cfg.columns[m]]) for m in net.letters(cfg)}


def _dims(df: DataFrame, cfg: FusionConfig) -> tuple[dict[str, int], int]:
    sizes = [F.max(F.size(cfg.columns[m])).alias(m) for m in net.letters(cfg)]
    row = df.agg(*sizes, F.max(F.size("cf")).alias("cf")).first()
    if row["cf"] is None:
        raise ValueError("no training rows")
    return {m: row[m] for m in net.letters(cfg)}, row["cf"]


def _summed(df: DataFrame, totals: Callable[[Iterator[pd.DataFrame]], np.ndarray | None], arrow: bool = False) -> np.ndarray:
    """Sum over all tasks of the vector that `totals` makes of a task's rows; empty without rows.

    Vectors have the size of the model, not of the data. They travel in chunks that
    Spark adds up, as Arrow lists: a NaN stays one on the way.
    """
    def run(batches):
        flat = totals(b.to_pandas() if not arrow else b for b in batches)
        if flat is not None:
            for i in range(0, len(flat), _CHUNK * 64):
                part = flat[i:i + _CHUNK * 64]
                ends = np.append(np.arange(0, len(part), _CHUNK), len(part)).astype(np.int32)
                vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vec), dtype=np.int32) + i // _CHUNK), vec], names=["chunk", "vec"])

    got = df.mapInArrow(run, "chunk int, vec array<double>").groupBy("chunk").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("vec")))).alias("vec")).collect()
    return np.concatenate([r["vec"] for r in sorted(got, key=lambda r: r["chunk"])]) if got else np.zeros(0)


def _minibatches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Batches of exactly `size` rows in the order they come, the last one shorter."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        full = len(held) // size * size
        if full:
            for lo in range(0, full, size):
                yield held.iloc[lo:lo + size]
            held = held.iloc[full:]
    if held is not None and len(held):
        yield held


class _RowNoise:
    """Random numbers that depend on the row, not on the task it lands in; one generator per row."""

    def __init__(self, seed: int, epoch: int, keys: Iterable[int]):
        self.rows = [np.random.default_rng([seed, epoch, int(k) % 2**64]) for k in keys]

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        return np.vstack([r.random(shape[1]) for r in self.rows])


def _step_task(cfg: FusionConfig, params, epoch: int):
    """Loss, rows and gradient summed over a task's rows of one minibatch, as one vector."""
    def run(batches: Iterator[pd.DataFrame]) -> np.ndarray | None:
        total = None
        for part in _minibatches(batches, _TASK_ROWS):
            rng = _RowNoise(cfg.seed, epoch, part["key"]) if cfg.dropout else None
            loss, grads = net.loss_and_grad(params.value, _inputs(part, cfg), _matrix(part["cf"]), cfg, rng)
            flat = np.concatenate([[loss, 1.0], *[grads[n].ravel() for n in params.value]]) * len(part)
            total = flat if total is None else total + flat
        return total
    return run


def _unflat(flat: np.ndarray, like: net.Params) -> net.Params:
    out, at = {}, 0
    for n, a in like.items():
        out[n] = flat[at:at + a.size].reshape(a.shape)
        at += a.size
    return out


def _valid_loss(valid: DataFrame, cfg: FusionConfig, params) -> float:
    """Mean squared error over all validation rows."""
    def run(batches):
        total = np.zeros(2)
        for pdf in batches:
            if len(pdf):
                err = net.predict(params.value, _inputs(pdf, cfg), cfg) - _matrix(pdf["cf"])
                total += [(err ** 2).sum(), err.size]
        return total
    sq, n = [*_summed(valid, run), 0.0, 0.0][:2]
    if not n:
        raise ValueError("no validation rows")
    return _finite(float(sq / n), "validation")


def _finite(loss: float, kind: str) -> float:
    """`loss`, unless it is NaN or infinite."""
    if not math.isfinite(loss):
        raise ValueError(f"the {kind} loss is {loss}")
    return loss


def _fit_mlp(train: DataFrame, valid: DataFrame, cfg: FusionConfig) -> FusionModel:
    spark = train.sparkSession
    sc = spark.sparkContext
    cols = ["item_id", *[cfg.columns[m] for m in net.letters(cfg)], "cf"]
    dims, out_dim = _dims(train, cfg)
    rows = train.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    held = valid.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    dealt = None
    try:
        steps = math.ceil(rows.count() / cfg.batch)
        p = net.init_params(dims, out_dim, cfg)
        m = {n: np.zeros_like(a) for n, a in p.items()}
        v = {n: np.zeros_like(a) for n, a in p.items()}
        best, best_loss, worse, losses, done = p, math.inf, 0, [], 0
        for epoch in range(cfg.epochs):
            if dealt is None or steps > 1:
                if dealt is not None:
                    drop_path(spark, dealt)
                dealt = _deal(rows, cfg, epoch, steps)
            table = spark.read.parquet(dealt)
            total, seen = 0.0, 0.0
            for step in range(steps):
                shared = sc.broadcast(p)
                batch = table.where(F.col("step") == step).drop("step")
                flat = _summed(batch, _step_task(cfg, shared, epoch))
                shared.unpersist()
                if not len(flat):  # the hash dealt no row to this step
                    continue
                done += 1
                p = {n: a.copy() for n, a in p.items()}
                net.adam_step(p, m, v, _unflat(flat[2:] / flat[1], p), done, net.learning_rate(epoch + step / steps, cfg))
                total += flat[0]
                seen += flat[1]
            shared = sc.broadcast(p)
            loss = _valid_loss(held, cfg, shared)
            shared.unpersist()
            losses.append((epoch, _finite(float(total / seen), "training"), float(loss)))
            if loss < best_loss:
                best, best_loss = p, loss
            worse = worse + 1 if loss - best_loss > cfg.min_delta else 0
            if worse >= cfg.patience:
                break
        return FusionModel(cfg, dims, best, losses)
    finally:
        rows.unpersist()
        held.unpersist()
        if dealt is not None:
            drop_path(spark, dealt)


def _deal(rows: DataFrame, cfg: FusionConfig, epoch: int, steps: int) -> str:
    """Path of `rows` written in one folder per global minibatch, in files of at most `_TASK_ROWS` rows.

    Where a row goes follows from seed, epoch and `item_id` alone.
    """
    pieces = math.ceil(min(cfg.batch, rows.count()) / _TASK_ROWS)
    step = F.pmod(F.xxhash64("item_id", F.lit(cfg.seed), F.lit(epoch)), F.lit(steps)).cast("int")
    path = fresh_path(rows.sparkSession, "fusion-epoch")
    (rows.withColumns({"key": F.xxhash64("item_id"), "step": step})
     .repartition("step", F.pmod(F.xxhash64("item_id", F.lit("piece")), F.lit(pieces)))
     .write.option("maxRecordsPerFile", _TASK_ROWS).partitionBy("step").parquet(path))
    return path


def _design(pdf: pd.DataFrame, cfg: FusionConfig) -> np.ndarray:
    x = np.hstack([_matrix(pdf[cfg.columns[m]]) for m in net.letters(cfg)])
    return np.hstack([x, np.ones((len(x), 1))])


def _gram(df: DataFrame, cfg: FusionConfig, width: int) -> np.ndarray:
    """[X 1 Y]' [X 1 Y] by a distributed sum, for inputs of at most `GRAM_WIDTH` columns."""
    shards = min(df.sparkSession.sparkContext.defaultParallelism, max(1, df.count() // (_MIN_GRAM_ROWS * width)))

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                z = np.hstack([_design(pdf, cfg), _matrix(pdf["cf"])])
                total = z.T @ z if total is None else total + z.T @ z
        return None if total is None else total.ravel()

    flat = _summed(df.repartition(shards, "item_id"), run)
    return flat.reshape(width, width) if len(flat) else np.zeros((width, width))


def _solve(gram: np.ndarray, x: np.ndarray, n_out: int, ridge: float) -> np.ndarray:
    """Ridge weights for the design columns `x` (the last one is the constant)."""
    a = gram[np.ix_(x, x)].copy()
    a[np.diag_indices(len(x) - 1)] += ridge
    return np.linalg.solve(a, gram[np.ix_(x, np.arange(len(gram) - n_out, len(gram)))])


def _ridge_loss(gram: np.ndarray, x: np.ndarray, n_out: int, w: np.ndarray) -> float:
    """Mean squared error of weights `w` on the rows behind `gram`."""
    y = np.arange(len(gram) - n_out, len(gram))
    rows = gram[x[-1], x[-1]]
    sq = (np.trace(gram[np.ix_(y, y)]) - 2 * (w * gram[np.ix_(x, y)]).sum()
          + (w * (gram[np.ix_(x, x)] @ w)).sum())
    if not rows:
        raise ValueError("no rows to measure the loss on")
    return _finite(max(float(sq), 0.0) / float(rows * n_out), "ridge")


def _ridge_grams(train: DataFrame, valid: DataFrame, cfg: FusionConfig):
    dims, n_out = _dims(train, cfg)
    width = sum(dims.values()) + 1 + n_out
    return dims, n_out, _gram(train, cfg, width), _gram(valid, cfg, width)


def _input_cells(df: DataFrame, cfg: FusionConfig) -> DataFrame:
    """(`n`, `x`, `y`): rows of the design and of the target as matrices of about a megabyte; staged."""
    cols = [cfg.columns[m] for m in net.letters(cfg)]

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            rows = max(1, _CELL // (8 * (1 + sum(len(pdf[c].iloc[0]) for c in cols)))) if len(pdf) else 1
            for lo in range(0, len(pdf), rows):
                part = pdf.iloc[lo:lo + rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([_design(part, cfg).tobytes()]), pa.array([_matrix(part["cf"]).tobytes()])],
                    names=["n", "x", "y"])
    return stage(df.select(*cols, "cf").mapInArrow(run, "n int, x binary, y binary"), "input-cells")


def _over_cells(cells: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of `add(x, y)`, flat vectors of length `size`, over all cells."""
    def run(batches):
        total = None
        for batch in batches:
            for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y"))):
                flat = add(np.frombuffer(x).reshape(n, -1), np.frombuffer(y).reshape(n, -1)).ravel()
                total = flat if total is None else total + flat
        return total
    flat = _summed(cells, run, arrow=True)
    return flat if len(flat) else np.zeros(size)


def _conjugate_gradients(cells: DataFrame, width: int, n_out: int, cfg: FusionConfig) -> np.ndarray:
    """Ridge weights (width x n_out) by preconditioned conjugate gradients on the normal equations.

    All outputs advance at once: an iteration is one distributed sum X'(XP) of
    the size of the weights. Nothing of the square of the width exists anywhere.
    """
    sc = cells.sparkSession.sparkContext
    start = _over_cells(cells, width * (n_out + 1), lambda x, y: np.concatenate([(x.T @ y).ravel(), (x * x).sum(0)]))
    if not np.isfinite(start).all():
        raise ValueError("the inputs or targets are not finite")
    penalty = np.full((width, 1), cfg.ridge)
    penalty[-1] = 0  # the constant is free
    scale = start[width * n_out:].reshape(width, 1) + penalty
    scale[scale == 0] = 1.0
    w = np.zeros((width, n_out))
    r = start[:width * n_out].reshape(width, n_out).copy()
    first = np.maximum(np.linalg.norm(r, axis=0), 1e-300)
    z = r / scale
    p, rz = z.copy(), (r * z).sum(0)
    for _ in range(cfg.cg_rounds):
        if (np.linalg.norm(r, axis=0) <= cfg.cg_tolerance * first).all():
            return w
        shared = sc.broadcast(p)
        q = _over_cells(cells, width * n_out, lambda x, y: x.T @ (x @ shared.value)).reshape(width, n_out) + penalty * p
        shared.unpersist()
        step = np.divide(rz, (p * q).sum(0), out=np.zeros(n_out), where=(p * q).sum(0) > 0)
        w, r = w + step * p, r - step * q
        z = r / scale
        before, rz = rz, (r * z).sum(0)
        p = z + np.divide(rz, before, out=np.zeros(n_out), where=before > 0) * p
    left = float((np.linalg.norm(r, axis=0) / first).max())
    warnings.warn(f"conjugate gradients stopped after {cfg.cg_rounds} rounds with a relative residual of {left:.1e}", stacklevel=2)
    return w


def _linear_loss(cells: DataFrame, w: np.ndarray, n_out: int) -> float:
    """Mean squared error of the linear map `w` over all cells."""
    shared = cells.sparkSession.sparkContext.broadcast(w)
    sq, n = _over_cells(cells, 2, lambda x, y: np.array([((x @ shared.value - y) ** 2).sum(), len(x)]))
    shared.unpersist()
    if not n:
        raise ValueError("no rows to measure the loss on")
    return _finite(float(sq) / float(n * n_out), "ridge")


def _fit_ridge(train: DataFrame, valid: DataFrame, cfg: FusionConfig) -> FusionModel:
    dims, n_out = _dims(train, cfg)
    x = np.arange(sum(dims.values()) + 1)
    if len(x) + n_out > GRAM_WIDTH:
        cells, held = _input_cells(train, cfg), _input_cells(valid, cfg)
        w = _conjugate_gradients(cells, len(x), n_out, cfg)
        return FusionModel(cfg, dims, {"ridge.w": w}, [(0, _linear_loss(cells, w, n_out), _linear_loss(held, w, n_out))])
    _, _, gram, held = _ridge_grams(train, valid, cfg)
    w = _solve(gram, x, n_out, cfg.ridge)
    return FusionModel(cfg, dims, {"ridge.w": w},
                       [(0, _ridge_loss(gram, x, n_out, w), _ridge_loss(held, x, n_out, w))])


def fit_fusion(train: DataFrame, valid: DataFrame, cfg: FusionConfig) -> FusionModel:
    """Fit content columns to `cf`; rows are (`item_id`, one column per modality, `cf`).

    solver "mlp": minibatch Adam with warm-up, cosine decay, dropout, best
    weights by validation loss and early stopping, in synchronous steps: the
    gradient of a global minibatch is summed over all tasks that hold its rows,
    so it is plain sequential training at any number of tasks. Minibatches hold
    `cfg.batch` rows on average. The result depends neither on the cluster nor on
    how the input is partitioned.
    solver "ridge": up to `GRAM_WIDTH` columns from the Gram matrix, a distributed
    sum; wider inputs by conjugate gradients until the residual has fallen by
    `cfg.cg_tolerance`, at most `cfg.cg_rounds` rounds (then it warns).
    An empty validation set or a loss that is not finite is a ValueError.
    """
    require_columns(train, "item_id", "cf", *[cfg.columns[m] for m in net.letters(cfg)])
    solvers = {"mlp": _fit_mlp, "ridge": _fit_ridge}
    if cfg.solver not in solvers:
        raise ValueError(f"unknown solver: {cfg.solver}")
    return solvers[cfg.solver](train, valid, cfg)


def score_fusion(df: DataFrame, model: FusionModel) -> DataFrame:
    """(`item_id`, `vec`): fitted collaborative vectors of items, dropout off."""
    cfg = model.cfg
    weights = df.sparkSession.sparkContext.broadcast(model.params)  # size set by the network
    type_ = df.schema["item_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            if cfg.solver == "ridge":
                out = _design(pdf, cfg) @ weights.value["ridge.w"]
            else:
                out = net.predict(weights.value, _inputs(pdf, cfg), cfg)
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy(), "vec": list(out.astype(np.float32))})

    cols = [cfg.columns[m] for m in net.letters(cfg)]
    return df.select("item_id", *cols).mapInPandas(run, f"item_id {type_}, vec array<float>")


ABLATIONS = ("v", "a", "t", "va", "vt", "at", "vat")  # fixed values: modality subsets compared


def ablation(train: DataFrame, valid: DataFrame, cfg: FusionConfig,
             modalities: Sequence[str] = ABLATIONS, seeds: Iterable[int] = range(5),
             evaluate: Callable[[FusionModel], DataFrame] | None = None) -> DataFrame:
    """One row per modality subset and seed: (`modality`, `seed`, `train_loss`, `valid_loss`).

    With `evaluate`, the metric rows it returns for a fitted model are added
    to each run. Inputs are staged once. The ridge solver has no randomness, so
    it runs once per subset and its rows have no `seed`; without `evaluate` inputs
    of at most `GRAM_WIDTH` columns need a single pass for all subsets: each is a block
    of the Gram sum.
    """
    spark = train.sparkSession
    train, valid = stage(train, "ablation-train"), stage(valid, "ablation-valid")
    ridge = cfg.solver == "ridge"
    seeds = [cfg.seed] if ridge else list(seeds)
    full = "".join(m for m in "vatg" if any(m in s for s in modalities))
    kinds = "modality string, seed int, train_loss double, valid_loss double"
    rows, tables = [], []
    sizes, n_out = _dims(train, replace(cfg, modality=full)) if ridge and evaluate is None else ({}, 0)
    if ridge and evaluate is None and sum(sizes.values()) + 1 + n_out <= GRAM_WIDTH:
        dims, n_out, gram, held = _ridge_grams(train, valid, replace(cfg, modality=full))
        starts = dict(zip(dims, np.cumsum([0, *dims.values()])))
        for name in modalities:
            x = np.concatenate([np.arange(starts[m], starts[m] + dims[m]) for m in dims if m in name]
                               + [[sum(dims.values())]]).astype(int)
            w = _solve(gram, x, n_out, cfg.ridge)
            rows.append((name, cfg.seed, _ridge_loss(gram, x, n_out, w), _ridge_loss(held, x, n_out, w)))
        return spark.createDataFrame(rows, kinds).drop("seed")
    for name in modalities:
        for s in seeds:
            model = fit_fusion(train, valid, replace(cfg, modality=name, seed=s))
            best = min(model.losses, key=lambda r: r[2])
            rows.append((name, s, best[1], best[2]))
            if evaluate is not None:
                tables.append(evaluate(model).withColumns({"modality": F.lit(name), "seed": F.lit(s)}))
    runs = spark.createDataFrame(rows, kinds)
    if not tables:
        return runs.drop("seed") if ridge else runs
    metrics = tables[0]
    for t in tables[1:]:
        metrics = metrics.unionByName(t)
    out = runs.join(metrics, ["modality", "seed"])
    return out.drop("seed") if ridge else out
