"""Gating a signal into frames, binning and unbinning, interpolation and smoothing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.ordering import positions
from tensorloom.sources.storage import checkpointed

#: Fixed value: the reach of the closed phase bins.
PHASE_REACH = 3.141592


def _mean(df: DataFrame, value: str) -> Column:
    """The signal's mean, as a scalar subquery."""
    return df.agg(F.avg(value)).scalar()


def _frame(at: Column, frames: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(frames - 1), F.floor(at))).cast("int")


def gate_by_value(df: DataFrame, value: str, frames: int, name: str = "frame") -> DataFrame:
    """Frames of equal length from 5 % of twice the mean up to twice the mean; what lies below is in frame 0, the rest goes.

    Null values are in no frame and go.
    """
    upper = 2 * _mean(df, value)
    start = 0.05 * upper
    return df.where(F.col(value) < upper).withColumn(name, _frame((F.col(value) - start) / ((upper - start) / frames), frames))


def gate_open_end(df: DataFrame, value: str, frames: int, name: str = "frame") -> DataFrame:
    """Frames of 2 mean / frames: the first is one and a half long, the last has no end. Null values go."""
    length = 2 * _mean(df, value) / frames
    return df.where(F.col(value).isNotNull()).withColumn(name, _frame(F.col(value) / length - 0.5, frames))


def gate_closed_bins(df: DataFrame, phase: str, frames: int, name: str = "frame") -> DataFrame:
    """Bins closed at both ends between -3.141592 and 3.141592: a sample on an inner edge is in two frames."""
    length = 2 * PHASE_REACH / frames
    at = (F.col(phase) + PHASE_REACH) / length
    low = F.greatest(F.lit(0), F.ceil(at) - 1).cast("int")
    high = F.least(F.lit(frames - 1), F.floor(at)).cast("int")
    return df.where(F.abs(phase) <= PHASE_REACH).withColumn(name, F.explode(F.sequence(low, high)))


def low_passed(signal: np.ndarray, low: float, causal: bool = False) -> np.ndarray:
    """A second-order Butterworth low-pass with its corner at `low` cycles a sample: forward and backward, or (causal) forward only."""
    n = len(signal)
    if causal:
        k = math.tan(math.pi * low)
        top, scale = k * k, 1 + k * math.sqrt(2) + k * k
        z = np.exp(-2j * np.pi * np.fft.fftfreq(2 * n))  # twice the length, so that the response does not wrap around
        response = top * (1 + z) ** 2 / (scale + 2 * (top - 1) * z + (1 - k * math.sqrt(2) + top) * z * z)
        return np.fft.ifft(np.fft.fft(signal, 2 * n) * response).real[:n]
    return np.fft.ifft(np.fft.fft(signal) / (1 + (np.fft.fftfreq(n) / low) ** 4)).real


def analytic_phase(signal: np.ndarray, low: float, causal: bool = False) -> np.ndarray:
    """The phase of the analytic signal of what the low-pass takes away: slow drift goes, the oscillation stays."""
    n = len(signal)
    if n < 2:
        return np.zeros(n)
    centred = signal - signal.mean()
    turn = np.zeros(n)
    turn[0] = 1
    turn[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        turn[n // 2] = 1
    return np.angle(np.fft.ifft(np.fft.fft(centred - low_passed(centred, low, causal)) * turn))


def respiratory_phase(df: DataFrame, series: str, time: str, value: str, low: float = 0.01, tie: str | None = None, causal: bool = False, chunk: int = 1 << 16, margin: int = 1 << 13) -> DataFrame:
    """`df` with `phase`: each series, in time order (ties by `tie`), less its low-passed self, turned into its analytic phase.

    A series is filtered in chunks of `chunk` samples, each with `margin` more on both sides, so that no task holds a long
    series; one that fits into a chunk is filtered as a whole. The margin's ends are felt as 1 / distance: away from its
    ends a longer series' phase differs from that of the whole by less than 0.01 for an oscillation of 10 cycles or more in the margin.
    """
    schema = df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    placed = positions(df, (series,), *([time, tie] if tie else [time]), name="_at")
    parts = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - margin) / chunk)), F.floor((F.col("_at") + margin) / chunk))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        out = pdf.assign(phase=analytic_phase(pdf[value].to_numpy(float), low, causal))
        return out[out["_at"] // chunk == out["_chunk"]].drop(columns=["_at", "_chunk"])

    return placed.withColumn("_chunk", F.explode(parts)).groupBy(series, "_chunk").applyInPandas(run, f"{schema}, phase double")


def bin_positions(df: DataFrame, bins: str, order: str, name: str = "position") -> DataFrame:
    """Each row's place in its bin, in arrival order."""
    return positions(df, (bins,), order, name=name)


def unbin(binned: DataFrame, positions: DataFrame, bins: str, name: str = "position") -> DataFrame:
    """The inverse: rows of (bin, position) back at the keys that were binned there."""
    return positions.join(binned, [bins, name])


def _with_next(df: DataFrame, order: str, value: str, series: tuple[str, ...]) -> DataFrame:
    """`df` with the value of the next row of its series (`_next`), by a join on the place. Series must not be null."""
    placed = checkpointed(positions(df, series, order, name="_at"))
    after = placed.select(*series, (F.col("_at") - 1).alias("_at"), F.col(value).alias("_next"))
    return placed.join(after, [*series, "_at"], "left").drop("_at")


def interpolate_frames(df: DataFrame, order: str, value: str, between: int, *series: str) -> DataFrame:
    """Each frame and `between` frames on the line to the next one; the last frame stands alone."""
    steps = F.explode(F.sequence(F.lit(0), F.when(F.col("_next").isNull(), F.lit(0)).otherwise(F.lit(between))))
    out = _with_next(df, order, value, series).withColumn("step", steps)
    part = F.col("step") / (between + 1.0)
    return out.withColumn(value, F.when(F.col("_next").isNull(), F.col(value)).otherwise(F.col(value) * (1 - part) + F.col("_next") * part)).drop("_next")


def interpolate_linear(df: DataFrame, position: str, value: str, step: float, *series: str) -> DataFrame:
    """Values on 0, step, 2 step, ... below the last position, on the lines between the samples at 0, 1, 2, ..."""
    after = df.select(*series, (F.col(position) - 1).alias(position), F.col(value).alias("_next"))
    lines = df.join(after, [*series, position]).where("_next is not null")
    first = F.ceil(F.col(position) / step).cast("long")
    last = F.ceil((F.col(position) + 1) / step).cast("long") - 1
    out = lines.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    part = F.col("k") * step - F.col(position)
    return out.select(*series, "k", (F.col(value) * (1 - part) + F.col("_next") * part).alias(value))


def smooth_neighbours(df: DataFrame, axes: tuple[str, ...], value: str, factor: float, *series: str) -> DataFrame:
    """Mean of the neighbours over 3 cells an axis, divided by `factor`, plus (factor - 1) / factor of the centre.

    Outside the grid is zero. Every cell is sent to the cells around it and summed there, with partial sums first.
    """
    n = 3 ** len(axes)
    sent = df
    for a in axes:
        sent = sent.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).withColumn(a, F.col(a) + F.col("_d")).withColumn(f"_at_{a}", F.col("_d")).drop("_d")
    centre = F.lit(True)
    for a in axes:
        centre = centre & (F.col(f"_at_{a}") == 0)
    weight = F.lit(1.0 / (n * factor)) + F.when(centre, F.lit((factor - 1) / factor)).otherwise(F.lit(0.0))
    summed = sent.groupBy(*series, *axes).agg(F.sum(F.col(value) * weight).alias(value), F.max(centre.cast("int")).alias("_inside"))
    return summed.where("_inside = 1").drop("_inside")
