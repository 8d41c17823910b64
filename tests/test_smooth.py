"""Local regression against a plain version in numpy."""

import math

import numpy as np
import pytest

from cohortweave.functions import smooth


def plain(x, y, span=0.5, rounds=3, step=0.01):
    width = (x.max() - x.min()) * step
    at = {}
    for v in x:
        b = math.floor((v - x.min()) / width) if width > 0 else 0
        at[b] = max(v, at.get(b, v))
    knots = np.array(sorted({x.min(), *at.values()}))
    k = min(len(x), max(2, math.floor(span * len(x) + 1e-7)))
    robust, levels = np.ones(len(x)), None
    for _ in range(rounds + 1):
        found = []
        for a in knots:
            d = np.abs(x - a)
            h = max(np.sort(d)[k - 1], 1e-12)
            g = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * robust
            z = x - a
            s, sx, sy, sxx, sxy = g.sum(), (g * z).sum(), (g * y).sum(), (g * z * z).sum(), (g * z * y).sum()
            det = s * sxx - sx * sx
            slope = (s * sxy - sx * sy) / det if det > 1e-12 * (s * h) ** 2 else 0.0
            found.append((sy - slope * sx) / s)
        levels = np.array(found)
        left = np.abs(y - np.interp(x, knots, levels))
        scale = 6 * np.median(left)
        if scale == 0:
            break
        robust = np.clip(1 - (left / scale) ** 2, 0, None) ** 2
    return knots, levels


@pytest.mark.parametrize("n", [3, 60, 700])
def test_every_point_has_the_plain_level(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.gamma(2, 3, n), 2)
    y = np.sin(x / 3) + rng.normal(0, 0.2, n) + (rng.random(n) < 0.05) * 9
    points = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (2.0, None)], "x double, y double").repartition(5)
    knots, levels = smooth.local_regression(points)
    want = plain(x, y)
    assert np.allclose(knots, want[0]) and np.allclose(levels, want[1], atol=1e-6)
    got = points.where("x is not null").select("x", smooth.between(points["x"], knots, levels).alias("f")).toPandas()
    assert np.allclose(got["f"], np.interp(got["x"], knots, levels), atol=1e-9)


def test_one_value_and_none(spark):
    assert smooth.local_regression(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")) == ([1.0], [3.0])
    assert smooth.local_regression(spark.createDataFrame([], "x double, y double")) == ([0.0], [1.0])
