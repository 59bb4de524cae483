"""Numpy forward and backward pass of the fusion network, used inside tasks."""

from __future__ import annotations

import math

import numpy as np

from mediarec.config import FusionConfig

Params = dict[str, np.ndarray]
_EPS = 1e-12
# Adam's usual constants.
_B1, _B2, _ADAM_EPS = 0.9, 0.999, 1e-8


def letters(cfg: FusionConfig) -> list[str]:
    return [m for m in "vatg" if m in cfg.modality]


def init_params(dims: dict[str, int], out_dim: int, cfg: FusionConfig) -> Params:
    """Two linear layers per modality and two for the fusion, uniform in ±1/sqrt(fan-in)."""
    rng = np.random.default_rng(cfg.seed)
    shapes = {}
    for m in letters(cfg):
        shapes[f"{m}1"], shapes[f"{m}2"] = (dims[m], cfg.hidden), (cfg.hidden, cfg.hidden)
    shapes["f1"], shapes["f2"] = (cfg.hidden * len(letters(cfg)), cfg.hidden), (cfg.hidden, out_dim)
    params = {}
    for name, (fan_in, fan_out) in shapes.items():
        bound = 1 / math.sqrt(fan_in)
        params[f"{name}.w"] = rng.uniform(-bound, bound, (fan_in, fan_out))
        params[f"{name}.b"] = rng.uniform(-bound, bound, fan_out)
    return params


def learning_rate(epoch: float, cfg: FusionConfig) -> float:
    """Linear warm-up, then half a cosine down to `min_lr`."""
    if epoch < cfg.warmup_epochs:
        return cfg.lr * epoch / cfg.warmup_epochs
    share = (epoch - cfg.warmup_epochs) / max(cfg.epochs - cfg.warmup_epochs, 1e-9)
    return cfg.min_lr + (cfg.lr - cfg.min_lr) * 0.5 * (1 + math.cos(math.pi * share))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), _EPS)
    return x / n, n


def _block(p: Params, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ p[f"{name}1.w"] + p[f"{name}1.b"], 0)
    return h, h @ p[f"{name}2.w"] + p[f"{name}2.b"]


def _block_grad(p: Params, g: Params, name: str, x: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    g[f"{name}2.w"], g[f"{name}2.b"] = h.T @ d, d.sum(0)
    d = (d @ p[f"{name}2.w"].T) * (h > 0)
    g[f"{name}1.w"], g[f"{name}1.b"] = x.T @ d, d.sum(0)
    return d @ p[f"{name}1.w"].T


def predict(p: Params, inputs: dict[str, np.ndarray], cfg: FusionConfig) -> np.ndarray:
    z = [_block(p, m, _unit(inputs[m])[0])[1] for m in letters(cfg)]
    return _block(p, "f", _unit(np.hstack(z))[0])[1]


def loss_and_grad(p: Params, inputs: dict[str, np.ndarray], y: np.ndarray, cfg: FusionConfig,
                  rng: np.random.Generator | None = None) -> tuple[float, Params]:
    """Mean squared error over all elements and its gradient; `rng` switches dropout on."""
    def drop(x):
        if rng is None or cfg.dropout == 0:
            return x, 1.0
        mask = (rng.random(x.shape) >= cfg.dropout) / (1 - cfg.dropout)
        return x * mask, mask

    grads: Params = {}
    seen = {}
    for m in letters(cfg):
        x, _ = drop(_unit(inputs[m])[0])
        seen[m] = (x, *_block(p, m, x))
    u, length = _unit(np.hstack([seen[m][2] for m in letters(cfg)]))
    x, mask = drop(u)
    h, out = _block(p, "f", x)
    err = out - y
    d = _block_grad(p, grads, "f", x, h, 2 * err / err.size) * mask
    d = (d - u * (d * u).sum(1, keepdims=True)) / length
    for i, m in enumerate(letters(cfg)):
        x, h, _ = seen[m]
        _block_grad(p, grads, m, x, h, d[:, i * cfg.hidden:(i + 1) * cfg.hidden])
    return float((err ** 2).mean()), grads


def adam_step(p: Params, m: Params, v: Params, grads: Params, step: int, lr: float) -> None:
    """One Adam update in place; `step` counts from 1."""
    for name, g in grads.items():
        m[name] += (1 - _B1) * (g - m[name])
        v[name] += (1 - _B2) * (g * g - v[name])
        p[name] -= lr * (m[name] / (1 - _B1 ** step)) / (np.sqrt(v[name] / (1 - _B2 ** step)) + _ADAM_EPS)
