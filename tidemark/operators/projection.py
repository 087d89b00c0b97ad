"""Exceedance projections: trend curves, smoothed distributions, year-block bootstrap, and look-ups in the cube.

Peaks are counted into (year, bin) cells first, and the grid has only bins near an occupied one, so what a task holds follows the
number of distinct cells, neither the number of peaks nor their range. Replicates are dealt over tasks in chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, DRAWS, SEED, TIDES = 0.002, 400, 20261016, 705.0


def quadratic_deltas(rows: DataFrame, by: str, x: Column, y: Column, years: Column, base: int) -> DataFrame:
    """(by, year, delta): least-squares parabola of each series by its sums, zero at ``base`` and never below zero."""
    u = x - base
    sums = [F.sum(F.pow(u, F.lit(i))).alias(f"s{i}") for i in range(5)] + [F.sum(y * F.pow(u, F.lit(i))).alias(f"t{i}") for i in range(3)]
    s = rows.groupBy(by).agg(*sums)
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    whole = det((s4, s3, s2), (s3, s2, s1), (s2, s1, s0))
    square, slope = det((t2, s3, s2), (t1, s2, s1), (t0, s1, s0)) / whole, det((s4, t2, s2), (s3, t1, s1), (s2, t0, s0)) / whole
    at = F.explode(years).alias("year")
    fits = s.where(F.abs(whole) > 0).select(by, square.alias("a"), slope.alias("b"), at)
    n = F.col("year") - base
    return fits.select(by, "year", F.round(F.greatest(F.lit(0.0), F.col("a") * n * n + F.col("b") * n), 4).alias("delta"))


def bandwidth(value: str) -> Column:
    """An aggregate: the bandwidth of a Gaussian for the values, 0.02 at least, 0.05 where they don't spread."""
    s = F.stddev_samp(value)
    return F.when(s > 0, F.greatest(F.lit(0.02), 1.06 * s * F.pow(F.count(value), F.lit(-0.2)))).otherwise(0.05)


def kernel(bandwidth: float, step: float = STEP) -> np.ndarray:
    """A Gaussian on the grid, cut at six bandwidths, of sum one."""
    reach = int(np.ceil(6 * bandwidth / step))
    out = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / bandwidth) ** 2)
    return out / out.sum()


def stretches(bins: np.ndarray, reach: int) -> list[np.ndarray]:
    """Bins that the kernel spreads over, stretch by stretch: those within ``reach`` of an occupied one, so the grid follows the
    number of occupied bins and not their range. Between two stretches the cumulative share is flat."""
    cuts = np.flatnonzero(np.diff(bins) > 2 * reach + 1) + 1
    return [np.arange(part[0] - reach, part[-1] + reach + 1) for part in np.split(bins, cuts)]


def spread(histogram: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The histogram (zero within the kernel's reach of its ends) convolved with the kernel, never below zero."""
    size = 1 << (len(histogram) + len(weights)).bit_length()
    reach = len(weights) // 2
    out = np.fft.irfft(np.fft.rfft(histogram, size) * np.fft.rfft(weights, size), size)
    return np.maximum(out[reach : reach + len(histogram)], 0)


def exceedance(peaks: DataFrame, thresholds: DataFrame, draws: int = DRAWS, seed: int = SEED, chunks: int = 16, held: int = 50_000) -> DataFrame:
    """(threshold, estimate, lower, upper): the share of peaks above, with the 95 % interval over resampled years.

    ``peaks`` has year and peak, ``thresholds`` has threshold. Null peaks are left out; below two peaks or two years there
    is no row. One row (the bandwidth and the counts) comes to the driver. A task holds about ``held`` thresholds.
    """
    peaks = peaks.where(F.col("year").isNotNull() & (F.abs("peak") < float("inf"))).select("year", "peak")
    wanted = thresholds.select(F.col("threshold").cast("double")).where(F.abs("threshold") < float("inf")).distinct()
    one = peaks.agg(F.count(F.lit(1)).alias("n"), bandwidth("peak").alias("width"), F.count_distinct("year").alias("years")).first()
    if one.n < 2 or one.years < 2:
        return wanted.select("threshold", *(F.lit(0.0).alias(c) for c in ("estimate", "lower", "upper"))).limit(0)
    counts = peaks.groupBy("year", F.floor(F.col("peak") / STEP + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    ids = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    lots = wanted.count() // held + 1
    lot = F.pmod(F.xxhash64("threshold"), F.lit(lots)).alias("lot")
    years, weights_ = int(one.years), kernel(one.width)

    def replicate(cells: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(points["threshold"].to_numpy())
        bins, column = np.unique(cells["bin"].to_numpy(), return_inverse=True)
        parts = stretches(bins, len(weights_) // 2)
        grid = np.concatenate(parts)
        edges, place = np.cumsum([0, *map(len, parts)]), np.searchsorted(grid, bins)
        _, row = np.unique(cells["year"], return_inverse=True)
        n = cells["n"].to_numpy(float)
        chunk, out = int(cells["chunk"].iloc[0]), []
        weights = np.random.default_rng(seed).multinomial(years, np.ones(years) / years, draws)
        turns = [(k, weights[k]) for k in range(chunk, draws, chunks)] + ([(-1, np.ones(years))] if chunk == 0 else [])
        for k, w in turns:
            held = np.zeros(len(grid))
            held[place] = np.bincount(column, w[row] * n, len(bins))
            total = np.cumsum(np.concatenate([spread(held[lo:hi], weights_) for lo, hi in zip(edges[:-1], edges[1:])]))
            share = 1 - np.interp(at, grid * STEP, total / total[-1] if total[-1] > 0 else total, left=0, right=1)
            out.append(pd.DataFrame({"draw": k, "threshold": at, "share": share}))
        return pd.concat(out) if out else pd.DataFrame({"draw": [], "threshold": [], "share": []})

    every = counts.select("year", "bin", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot")).select("year", "bin", "n", "lot", ids)
    pairs = every.groupBy("lot", "chunk").cogroup(wanted.select("threshold", lot, ids).groupBy("lot", "chunk"))
    drawn = pairs.applyInPandas(replicate, "draw int, threshold double, share double")
    share = F.when(F.col("draw") >= 0, F.col("share"))
    return drawn.groupBy("threshold").agg(F.max(F.when(F.col("draw") < 0, F.col("share"))).alias("estimate"), F.percentile(share, F.lit(0.025)).alias("lower"), F.percentile(share, F.lit(0.975)).alias("upper"))


MOST_ELEVATIONS = 10_000


def cube(peaks: DataFrame, elevations: list[float], deltas: DataFrame, by: str, depth: float = 0.1, tides: float = TIDES, **kind) -> DataFrame:
    """(by, elevation, year, estimate, lower, upper) floods a year. ``elevations`` is the grid of the cube, a parameter of at
    most ``MOST_ELEVATIONS`` values; each delta takes all of it where it stands, and the shares are joined by threshold."""
    if len(elevations) > MOST_ELEVATIONS:
        raise ValueError("too many elevations for a grid")
    asked = deltas.select(by, "year", "delta", F.explode(F.array(*(F.lit(float(e)) for e in sorted(set(elevations))))).alias("elevation")) if elevations else deltas.select(by, "year", "delta", F.lit(0.0).alias("elevation")).limit(0)
    asked = asked.withColumn("threshold", F.round(F.col("elevation") + depth - F.col("delta"), 4))
    found = exceedance(peaks, asked, **kind)
    counts = [F.round(F.greatest(F.lit(0.0), F.least(F.lit(tides), F.col(c) * tides)), 2).alias(c) for c in ("estimate", "lower", "upper")]
    return asked.join(found, "threshold").select(by, "elevation", "year", *counts)


def nearest_index(elevation: Column, preferred: Column, grid: list[float]) -> Column:
    """``preferred`` where it is an index of ``grid``, else that of the nearest value, the first on ties, 0 without one."""
    far = F.transform(F.array(*(F.lit(float(g)) for g in grid)), lambda g, i: F.struct(F.abs(g - elevation).alias("far"), i.alias("i")))
    return F.when(preferred.between(0, len(grid) - 1), preferred.cast("int")).when(elevation.isNull() | F.isnan(elevation), 0).otherwise(F.array_min(far)["i"])


def share_rows(stages: DataFrame, grid: DataFrame, depth: float = 0.1) -> DataFrame:
    """``stages`` (with stage) with the index of the elevation that floods at it; null where the grid has none."""
    key = F.round(F.col("elevation") + depth, 5)
    return stages.withColumn("_key", F.round("stage", 5)).join(grid.select(key.alias("_key"), "index"), "_key", "left").drop("_key")
