"""Job settings. Fixed values below are the published settings of the jobs rebuilt here."""

from __future__ import annotations

from dataclasses import dataclass, field

# Category list and the log cleaning bounds (milliseconds, ratio).
CATEGORIES = ("ARTIS", "DRAMA", "ENTER", "NEWS", "SPORT")
MIN_WATCH_MS = 30_000
MAX_WATCH_MS = 7_200_000
MIN_SCORE = 0.3
SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class StaticConfig:
    min_watch: int = MIN_WATCH_MS
    max_watch: int = MAX_WATCH_MS
    min_score: float = MIN_SCORE


@dataclass(frozen=True)
class CoreConfig:
    """Bounds on rows per user and per item; both must be chosen by the caller."""

    min_per_user: int
    min_per_item: int
    rounds: int | None = 5


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.9
    valid: float = 0.95
    total: int | None = None
    seed: int = 42
    categories: tuple[str, ...] = CATEGORIES
    cap: int = 10_000  # fixed value: published size of a category


@dataclass(frozen=True)
class AlsConfig:
    rank: int = 128
    max_iter: int = 15
    reg: float = 0.1
    blocks: int = 10
    implicit: bool = True
    seed: int = 42
    checkpoint_interval: int = 5

    @staticmethod
    def implicit_feedback(**kw) -> "AlsConfig":
        return AlsConfig(**{"reg": 0.1, "blocks": 128, "implicit": True, **kw})

    @staticmethod
    def explicit_feedback(**kw) -> "AlsConfig":
        return AlsConfig(**{"reg": 0.05, "implicit": False, **kw})


@dataclass(frozen=True)
class FusionConfig:
    """Content-to-collaborative regression. Letters: v vision, a audio, t lyrics, g genres."""

    modality: str = "vatg"
    hidden: int = 768
    dropout: float = 0.1
    lr: float = 5e-5
    min_lr: float = 1e-9
    batch: int = 1024
    epochs: int = 200
    warmup_epochs: int = 10
    patience: int = 30
    min_delta: float = 1e-9
    seed: int = 0
    solver: str = "mlp"
    ridge: float = 1e-6
    cg_rounds: int = 1000
    cg_tolerance: float = 1e-10
    columns: dict[str, str] = field(default_factory=lambda: {
        "v": "vision", "a": "audio", "t": "lyrics", "g": "genres"})
