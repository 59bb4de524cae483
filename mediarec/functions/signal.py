"""Raw signals: framing and power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediarec.operators.skew import HOT_ROWS, hot_key_join
from mediarec.operators.staging import stage

FRAME = 160_000  # fixed value: ten seconds at 16 kHz


def _bind(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def channel_mean(*channels: Column) -> Column:
    """Average of equally long channels."""
    total = F.transform(channels[0], lambda x: x.cast("double"))
    for c in channels[1:]:
        total = F.zip_with(total, c, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(channels))


def frame_sequence(df: DataFrame, id_col: str, channels: list[str], n_frames: int | Column,
                   frame_len: int = FRAME) -> DataFrame:
    """(`id`, `frame`, `samples`): the averaged signal cut into `n_frames` equal frames.

    A long signal is cut off, a short one is filled up with zeros.
    """
    n = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    length = F.lit(frame_len)

    def fill(part: Column) -> Column:
        return F.concat(part, F.array_repeat(F.lit(0.0), length - F.size(part)))

    def cut(signal: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1),
                           lambda i: _bind(F.slice(signal, i * length + 1, length), fill))

    frames = _bind(channel_mean(*[F.col(c) for c in channels]), cut)
    return df.select(F.col(id_col), F.posexplode(frames).alias("frame", "samples"))


def frame_rows(df: DataFrame, id_col: str, pos: str, sample: str, n_frames: int,
               frame_len: int = FRAME) -> DataFrame:
    """As `frame_sequence` for signals stored one sample per row, zero-based `pos`.

    A frame gathers at most `frame_len` rows, so clips of any length work.
    Every sample stands at its own position, positions without a sample are
    zero, and a position given twice is an error.
    """
    kept = df.where((F.col(pos) >= 0) & (F.col(pos) < n_frames * frame_len)).select(
        id_col, F.floor(F.col(pos) / frame_len).cast("int").alias("frame"),
        (F.col(pos) % frame_len).cast("int").alias("_at"), F.col(sample).cast("double").alias("_x"))
    every = df.select(id_col).distinct().withColumn(
        "frame", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    filled = kept.groupBy(id_col, "frame").agg(F.sort_array(F.collect_list(F.struct("_at", "_x"))).alias("_s"))

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), n)

    def until_next(e: Column, i: Column) -> Column:
        gap = F.coalesce(F.get("_s", i + 1)["_at"], F.lit(frame_len)) - e["_at"] - 1
        twice = F.when(gap < 0, F.raise_error(F.lit("a position of the signal is given twice")).cast("int")).otherwise(gap)
        return F.concat(F.array(e["_x"]), zeros(twice))

    placed = F.concat(zeros(F.get("_s", F.lit(0))["_at"]), F.flatten(F.transform("_s", until_next)))
    return every.join(filled, [id_col, "frame"], "left").select(
        id_col, "frame", F.coalesce(placed, zeros(F.lit(frame_len))).alias("samples"))


def mean_square(x: Column) -> Column:
    """Mean of the squared samples of an array."""
    return _bind(
        F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")),
        lambda s: F.try_divide(s, F.size(x)))


def scale_power(x: Column, target: Column | float = 1.0) -> Column:
    """Rescale an array to the given mean square; null where it has no power."""
    target = F.lit(target) if isinstance(target, (int, float)) else target
    gain = F.sqrt(F.try_divide(target.cast("double"), mean_square(x)))
    return F.zip_with(x, F.array_repeat(gain, F.size(x)), lambda v, g: v.cast("double") * g)


def signal_power(df: DataFrame, id_col: str, x: str) -> DataFrame:
    """(`id`, `power`, `n`) of signals stored one sample per row."""
    v = F.col(x).cast("double")
    return df.groupBy(id_col).agg(F.avg(v * v).alias("power"), F.count(F.lit(1)).alias("n"))


def power_normalize(df: DataFrame, id_col: str, x: str, target: float = 1.0,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rescale each clip to the target power; samples are one per row.

    Power is aggregated and joined back, so a long clip is spread over tasks.
    """
    gain = F.sqrt(F.try_divide(F.lit(float(target)), F.col("power")))
    power = stage(signal_power(df, id_col, x), "power")
    return hot_key_join(df, power, id_col, "n", hot_rows).withColumn(
        x, F.col(x).cast("double") * gain).drop("power", "n")
