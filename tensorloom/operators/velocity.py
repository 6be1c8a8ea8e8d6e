"""Velocity encoding: phases of five encodes, their linear decoding, and the complex difference."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cis, cplx

#: The five encodes' directions, the first being the reference.
DIRECTIONS = ((0, 0, 0), (-1, -1, -1), (1, 1, -1), (1, -1, 1), (-1, 1, 1))


def factor(venc: float) -> float:
    return math.pi / (venc * math.sqrt(3.0))


def encode(df: DataFrame, venc: float, *keys: str) -> DataFrame:
    """(keys, enc, re, im) of voxels (keys, mag, vx, vy, vz): mag e^(i k E v)."""
    k = factor(venc)
    phases = [(ex * F.col("vx") + ey * F.col("vy") + ez * F.col("vz")) * k for ex, ey, ez in DIRECTIONS]
    rows = df.select(*keys, "mag", F.posexplode(F.array(*phases)).alias("enc", "_p"))
    z = cis(F.col("_p")).scale(F.col("mag"))
    return rows.select(*keys, "enc", z.re.alias("re"), z.im.alias("im"))


def _wide(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, _re<e>, _im<e>, _n, mag): the encodes side by side, their number and mean magnitude, in one grouped pass."""
    pick = lambda e, c: F.max(F.when(F.col("enc") == e, F.col(c)))
    return df.groupBy(*keys).agg(*[pick(e, c).alias(f"_{c}{e}") for e in range(5) for c in ("re", "im")], F.count("*").alias("_n"), F.avg(cplx().abs()).alias("mag"))


def _linear(venc: float) -> dict[str, Column]:
    first = cplx(re="_re0", im="_im0").conj()
    phase = [(first * cplx(re=f"_re{e}", im=f"_im{e}")).angle() for e in range(1, 5)]
    k = factor(venc)
    return {n: sum((phase[e - 1] * DIRECTIONS[e][axis] for e in range(1, 5)), F.lit(0.0)) / (4 * k) for axis, n in enumerate(("vx", "vy", "vz"))}


def decode_linear(df: DataFrame, venc: float, *keys: str) -> DataFrame:
    """(keys, mag, vx, vy, vz) from the five encodes: phases against the first, times E^T / (4 k^2) (E's columns are orthogonal).

    mag is the mean magnitude. A missing encode leaves null velocities.
    """
    return _wide(df, keys).select(*keys, "mag", *[v.alias(n) for n, v in _linear(venc).items()])


def decode_nonlinear(df: DataFrame, venc: float, key: str) -> DataFrame:
    """(key, mag, vx, vy, vz, objective): the five complex encodes, fitted as mag e^(i k E v), from the linear decoding.

    The first encode's phase is taken off all encodes. A voxel without all five encodes has nulls; one with more rows than
    that has no meaning and goes.
    """
    from tensorloom.operators.fitting import fit

    encodes = [cplx(re=f"_re{e}", im=f"_im{e}") for e in range(5)]
    size = encodes[0].abs()
    turned = [z * encodes[0].conj() for z in encodes]
    whole = (F.col("_n") == 5) & (size > 0) & F.lit(True)
    for z in encodes:
        whole = whole & z.re.isNotNull() & z.im.isNotNull()
    data = F.when(whole, F.array(*[z.re / size for z in turned], *[z.im / size for z in turned]))
    rows = _wide(df, (key,)).where("_n <= 5").select(key, data.alias("_d"), F.col("mag").alias("_mag"), *[v.alias(f"_{n}") for n, v in _linear(venc).items()])
    names = ["mag", "vx", "vy", "vz"]
    low = {"mag": 0.0} | dict.fromkeys(names[1:], -2 * venc)
    high = {"mag": 1e9} | dict.fromkeys(names[1:], 2 * venc)
    return fit(rows, _signal(factor(venc)), names, "_d", [], {n: f"_{n}" for n in names}, low, high, key)


def _signal(k: float):
    """The real parts of the five encodes, then their imaginary parts (a quarter turn behind)."""
    ex, ey, ez = (np.asarray([[d[axis] for d in DIRECTIONS * 2]], float) * k for axis in range(3))
    off = np.asarray([[0.0] * 5 + [math.pi / 2] * 5])

    def model(mag, vx, vy, vz):
        from tensorloom.functions.dual import cos

        return mag * cos(vx * ex + vy * ey + vz * ez - off)

    return model


def complex_difference(magnitude: Column, velocity: tuple[Column, ...], venc: float) -> Column:
    """m sin(pi min(|v|, venc / 2) / venc)."""
    speed = F.sqrt(sum((v * v for v in velocity), F.lit(0.0)))
    return magnitude * F.sin(math.pi * F.least(speed, F.lit(venc / 2)) / venc)
