"""Fractional differencing and the test of its order, against the regressions written out."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fracdiff


def adf_t(x, lags=None):
    """The t of the lagged level, with a constant; the number of lagged differences by AIC on one common sample."""
    dx, n = np.diff(x), len(x)
    most = fracdiff.most_lags(n)

    def fit(k, start):
        y = dx[start:]
        a = np.column_stack([np.ones(len(y)), x[start:-1], *[dx[start - j : len(dx) - j] for j in range(1, k + 1)]])
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        return a, b, float(((y - a @ b) ** 2).sum())

    rows = len(dx) - most
    k = int(np.argmin([rows * np.log(fit(k, most)[2] / rows) + 2 * (2 + k) for k in range(most + 1)])) if lags is None else lags
    a, b, sse = fit(k, k)
    return k, float(b[1] / np.sqrt(sse / (len(a) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1]))


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(9)
    e = rng.standard_normal(9000)
    ar = np.zeros(2500)
    for k in range(1, 2500):
        ar[k] = 0.6 * ar[k - 1] + 0.2 * ar[k - 2] + e[k]
    return {"noise": e[:600], "walk": 4.6 + 0.01 * np.cumsum(e[:2400]), "ar": ar, "long": np.cumsum(e), "short": e[:150], "line": np.arange(400.0), "flat": np.full(400, 3.0)}


@pytest.fixture(scope="module")
def rows(spark, made):
    x = [(k, i, float(v)) for k, xs in made.items() for i, v in enumerate(xs)]
    return spark.createDataFrame([*x, ("noise", 600, None), ("noise", 601, math.nan)], "ticker string, i long, x double").cache()


def test_lags_and_t_as_regressions(spark, rows, made):
    grid = (0.0, 0.4, 0.75, 1.0)
    got = {(r.ticker, r.d): r for r in fracdiff.adf(rows, grid).collect()}
    for name in ("noise", "walk", "ar", "long"):
        for d in grid:
            w = np.array(fracdiff.weights(d))
            y = np.convolve(made[name], w, mode="valid") if len(w) < len(made[name]) else np.zeros(0)
            if len(y) < 100:
                assert (name, d) not in got
                continue
            k, t = adf_t(y)
            assert got[name, d].lags == k and got[name, d].n == len(y) and got[name, d].t == pytest.approx(t, rel=1e-7), (name, d)
    assert ("long", 0.4) in got and not [k for k in got if k[0] in ("short", "flat")] and ("line", 0.0) not in got


def test_p_values(spark):
    """Points of the published table: 1, 5 and 10 per cent."""
    t = spark.createDataFrame([(x,) for x in (-25.0, -5.0, -3.43, -2.86, -2.57, -1.61, 0.0, 2.0, 3.0)], "t double")
    got = [r.p for r in t.select(fracdiff.p_value(F.col("t")).alias("p")).collect()]
    assert got[0] == 0 and got[-1] == 1 and got == sorted(got)
    assert got[2] == pytest.approx(0.01, abs=3e-4) and got[3] == pytest.approx(0.05, abs=1e-3) and got[4] == pytest.approx(0.10, abs=1.5e-3)
    z = [-9.0, -4.1, -3.9, -1.0, 0.0, 0.3, 3.9, 4.1]
    cdf = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(fracdiff.normal_cdf(F.col("z")).alias("p")).collect()]
    assert cdf == pytest.approx([NormalDist().cdf(x) for x in z], rel=1e-9)


def test_least_order(spark, rows):
    got = {r.ticker: r.min_d for r in fracdiff.min_d(rows).collect()}
    assert set(got) == {"noise", "walk", "ar", "long", "short", "line", "flat"}
    assert got["noise"] == got["ar"] == 0.0 and 0 < got["walk"] <= 1 and 0 < got["long"] <= 1 and got["short"] is None and got["flat"] is None
    assert fracdiff.min_d(rows.where("false")).count() == 0
