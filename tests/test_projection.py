"""The bootstrap against a plain numpy version."""

import numpy as np
import pandas as pd

from tidemark.operators import projection as P


def test_exceedance(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"year": rng.integers(2000, 2006, 300), "peak": np.round(rng.normal(3, 1, 300), 3)})
    at = np.array([1.0, 2.5, 3.0, 5.5])
    got = P.exceedance(spark.createDataFrame(pdf), spark.createDataFrame([(float(a),) for a in at] * 2, "threshold double"), draws=40, chunks=3).orderBy("threshold").toPandas()
    width = max(0.02, 1.06 * pdf.peak.std() * 300**-0.2)
    grid = np.arange(np.floor((min(pdf.peak.min(), 1.0) - 6 * width) / P.STEP), np.ceil((max(pdf.peak.max(), 5.5) + 6 * width) / P.STEP) + 1) * P.STEP
    offsets = np.arange(-int(np.ceil(6 * width / P.STEP)), int(np.ceil(6 * width / P.STEP)) + 1)
    kernel = np.exp(-0.5 * (offsets * P.STEP / width) ** 2)

    def share(peaks):
        h = np.zeros(len(grid))
        for p in peaks:
            h[int(np.floor(p / P.STEP + 0.5) - round(grid[0] / P.STEP))] += 1
        c = np.cumsum(np.convolve(h, kernel / kernel.sum(), "same"))
        return 1 - np.interp(at, grid, c / c[-1])

    years = [pdf.peak[pdf.year == y].to_numpy() for y in range(2000, 2006)]
    weights = np.random.default_rng(P.SEED).multinomial(6, np.ones(6) / 6, 40)
    draws = np.array([share(np.concatenate([np.tile(p, n) for p, n in zip(years, w)])) for w in weights])
    np.testing.assert_allclose(got.estimate, share(pdf.peak), atol=1e-5)
    np.testing.assert_allclose(got.lower, np.percentile(draws, 2.5, axis=0), atol=1e-5)
    np.testing.assert_allclose(got.upper, np.percentile(draws, 97.5, axis=0), atol=1e-5)


def test_too_few_peaks(spark):
    one = spark.createDataFrame([(2000, 1.0), (2000, 2.0), (None, 3.0)], "year int, peak double")
    assert P.exceedance(one, spark.createDataFrame([(1.0,)], "threshold double")).count() == 0


def test_cube_is_the_share_at_each_threshold(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"year": rng.integers(2000, 2004, 120), "peak": np.round(rng.normal(3, 1, 120), 3)})
    deltas = [("a", 2030, 0.0), ("a", 2040, 0.25), ("b", 2030, 1.5)]
    got = P.cube(spark.createDataFrame(pdf), [2.0, 2.5, 2.5, 4.0], spark.createDataFrame(deltas, "by string, year int, delta double"), "by", draws=4, chunks=2, held=3).collect()
    width = max(0.02, 1.06 * pdf.peak.std() * 120**-0.2)
    grid = np.arange(-2000, 6000) * P.STEP
    offsets = np.arange(-int(np.ceil(6 * width / P.STEP)), int(np.ceil(6 * width / P.STEP)) + 1)
    kernel = np.exp(-0.5 * (offsets * P.STEP / width) ** 2)
    held = np.zeros(len(grid))
    for p in pdf.peak:
        held[int(np.floor(p / P.STEP + 0.5)) + 2000] += 1
    total = np.cumsum(np.convolve(held, kernel / kernel.sum(), "same"))
    want = {(b, e, y): round(705 * (1 - np.interp(round(e + 0.1 - d, 4), grid, total / total[-1])), 2) for b, y, d in deltas for e in (2.0, 2.5, 4.0)}
    assert {(r.by, r.elevation, r.year) for r in got} == set(want)
    assert all(abs(r.estimate - want[r.by, r.elevation, r.year]) < 0.02 and r.lower <= r.upper for r in got)
    assert P.cube(spark.createDataFrame(pdf), [], spark.createDataFrame(deltas, "by string, year int, delta double"), "by").count() == 0
