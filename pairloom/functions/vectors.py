"""Vectors and signals kept as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_POWER, EPS_MAGNITUDE = 1e-12, 1e-10
SNR_GRID_DB = tuple(float(x) for x in range(-20, 61))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The cosine of two vectors; null if either is missing or has no length. Give norms that were
    computed once a clip."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale > 0, dot(a, b) / scale)


def _dots(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row by row the dot product of two list arrays, null where either is null or their lengths differ."""
    def parts(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = x.offsets.to_numpy()
        size = np.where(x.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
        return x.values.to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), size

    (av, ao, an), (bv, bo, bn) = parts(a), parts(b)
    out, known = np.zeros(len(a)), (an >= 0) & (an == bn)
    for n in np.unique(an[known]):
        rows = np.flatnonzero(known & (an == n))
        for some in np.array_split(rows, max(1, len(rows) * int(n) // 4_000_000)):
            at = np.arange(n)
            out[some] = np.einsum("ij,ij->i", av[ao[some, None] + at].astype(np.float64), bv[bo[some, None] + at].astype(np.float64))
    return pa.array(out, mask=~known)


def dot_batches(a: Column, b: Column) -> Column:
    """dot() of whole Arrow batches at once, for many pairs of long vectors."""

    def dots(x: pa.Array, y: pa.Array) -> pa.Array:
        return _dots(x, y)

    return F.arrow_udf(dots, "double")(a, b)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, _sum(_double(v)) / F.size(v))


def energy_db(v: Column) -> Column:
    """10 log10 of the mean square; null for an empty signal."""
    return F.when(F.size(v) > 0, 10 * F.log10(_sum(F.transform(_double(v), lambda x: x * x)) / F.size(v) + EPS_POWER))


def centre_and_scale(v: Column, headroom: float = 1.01) -> Column:
    """The signal without its mean, divided by headroom times its peak (left as it is if flat)."""
    return F.transform(F.array(F.struct(_double(v).alias("v"), mean(v).alias("m"))), lambda s: _scaled(F.transform(s["v"], lambda x: x - s["m"]), headroom))[0]


def _scaled(v: Column, headroom: float) -> Column:
    return F.transform(F.array(F.struct(v.alias("v"), F.array_max(F.transform(v, F.abs)).alias("p"))), lambda s: F.when(s["p"] > 0, F.transform(s["v"], lambda x: x / (headroom * s["p"]))).otherwise(s["v"]))[0]


def mono(channels: Column) -> Column:
    """The mean over channels of an array of frames, each an array with a sample a channel."""
    return F.transform(channels, mean)


def tile(v: Column, n: int) -> Column:
    """A signal shorter than n repeated up to n samples; others, and empty ones, as they are."""
    reps = F.ceil(F.lit(float(n)) / F.greatest(F.size(v), F.lit(1))).cast("int")
    return F.when((F.size(v) > 0) & (F.size(v) < n), F.slice(F.flatten(F.array_repeat(v, reps)), 1, n)).otherwise(v)


def pad(v: Column, n: Column) -> Column:
    """Zeros up to n samples."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(v), F.lit(0)).cast("int")).cast("array<double>"))


def relative_length(v: Column, longest: Column) -> Column:
    return F.size(v) / longest


def wada_g(v: Column) -> Column:
    """log of the mean magnitude less the mean log magnitude; null for an empty signal."""
    size = F.transform(_double(v), lambda x: F.abs(x) + EPS_MAGNITUDE)
    return F.when(F.size(v) > 0, F.log(_sum(size) / F.size(v)) - _sum(F.transform(size, lambda x: F.log(x))) / F.size(v))


def calibration(shape: float = 0.4, samples: int = 400_000, seed: int = 42) -> list[float]:
    """G for each SNR of SNR_GRID_DB: signed Gamma speech in Gaussian noise, the same draws at every
    SNR, made non-decreasing. A constant table, built once on the driver."""
    draw = np.random.default_rng(seed)
    speech = draw.standard_gamma(shape, samples) * np.where(draw.random(samples) < 0.5, -1, 1)
    noise = draw.standard_normal(samples)
    speech, noise = speech / np.sqrt((speech**2).mean()), noise / np.sqrt((noise**2).mean())
    curve = []
    for db in SNR_GRID_DB:
        y = np.abs(speech + noise * 10 ** (-db / 20)) + EPS_MAGNITUDE
        curve.append(np.log(y.mean()) - np.log(y).mean())
    return np.maximum.accumulate(curve).tolist()


def snr_from_g(g: Column, curve: list[float]) -> Column:
    """The SNR in dB that a G stands for: clamped to the curve and interpolated between its points."""
    table = F.array(*[F.lit(x) for x in curve])
    held = F.greatest(F.lit(curve[0]), F.least(F.lit(curve[-1]), g))
    at = F.greatest(F.lit(1), F.least(F.lit(len(curve) - 1), F.size(F.filter(table, lambda x: x <= held))))
    low, high = F.element_at(table, at), F.element_at(table, at + 1)
    step = SNR_GRID_DB[1] - SNR_GRID_DB[0]
    return F.when(g.isNotNull(), F.lit(SNR_GRID_DB[0]) + step * (at - 1 + F.coalesce(F.try_divide(held - low, high - low), F.lit(0.0))))
