"""Runs of the stationary bootstrap, intervals from their sums, and medians of growing sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import expanding_median
from tidemark.operators import audit, inference


def test_runs_fill_each_replicate_with_neighbours(spark):
    for block, low, high in ((1.0, 60, 60), (4.0, 12, 20), (10.0, 4, 9)):
        got = inference.runs(spark, 60, 200, block).orderBy("rep", "place").collect()
        assert low <= len(got) / 200 <= high and all(0 <= r.start < 60 for r in got)
        for rep in range(200):
            mine = [r for r in got if r.rep == rep]
            assert [r.place for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1]) and sum(r.length for r in mine) == 60
    assert [r.length for r in inference.runs(spark, 5, 3, 1e9).collect()] == [5, 5, 5]


@pytest.mark.parametrize("block", [1.0, 3.0])
def test_intervals_as_draws_written_out(spark, block):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0.01, 0.04, 90), rng.normal(0.0, 0.03, 90)
    df = spark.createDataFrame([(7 * k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))] + [(10_000, None, 0.1), (10_001, 0.1, float("nan"))], "seq long, a double, b double")
    places = {}
    for r in inference.runs(spark, 90, 300, block).orderBy("rep", "place").collect():
        places.setdefault(r.rep, []).extend((r.start + t) % 90 for t in range(r.length))
    sharpe = lambda x: x.mean() / x.std() * 12**0.5
    diffs = [sharpe(a[p]) - sharpe(b[p]) for p in places.values()]
    got = inference.paired_diff_ci(df, "a", "b", "seq", 300, block=block).first()
    assert (got.lo, got.hi) == pytest.approx((np.quantile(diffs, 0.025), np.quantile(diffs, 0.975)), abs=1e-9) and got.n == 90
    assert got.point == pytest.approx(sharpe(a) - sharpe(b)) and got.p_gt_0 == pytest.approx(np.mean(np.array(diffs) > 0))
    one = inference.sharpe_ci(df.where("a is not null and b is not null and not isnan(b)"), "a", "seq", 300, block=block).first()
    assert (one.lo, one.hi) == pytest.approx(np.quantile([sharpe(a[p]) for p in places.values()], [0.025, 0.975]), abs=1e-9)


def test_few_values_and_flat_ones_have_no_interval(spark):
    df = spark.range(20).select(F.col("id").alias("seq"), F.lit(0.01).alias("r"))
    assert inference.sharpe_ci(df.where("seq < 11"), "r", "seq", 50).count() == 0 and inference.sharpe_ci(df.where("false"), "r", "seq", 50).count() == 0
    assert inference.sharpe_ci(df, "r", "seq", 50, block=3.0).first().lo is None


@pytest.mark.parametrize("n,size", [(1, 4), (2, 4), (37, 4), (400, 7), (3000, None)])
def test_medians_of_growing_sets(spark, n, size):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 20, n) / 4 if n == 400 else np.sort(rng.standard_normal(n)) if n == 37 else rng.standard_normal(n)
    df = spark.createDataFrame([(k, float(x), "same") for k, x in enumerate(v)], "i long, v double, rank string")
    got = expanding_median(df, "v", "m", size).orderBy("i").collect()
    assert len(got) == n and got[0].m is None and {r["rank"] for r in got} == {"same"}
    assert [r.m for r in got[1:]] == pytest.approx([float(np.median(v[:k])) for k in range(1, n)])


def test_gates(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.random(100), rng.normal(size=100)))]
    df = spark.createDataFrame(rows, "k int, delta_h double, fwd double").withColumn("date", F.expr("date_add(date'2000-01-31', 30 * k)"))
    for causal in (True, False):
        got = audit.gate(df, causal, 40).orderBy("date").collect()
        for k, r in enumerate(got):
            t = np.median([x[1] for x in (rows[:k] if causal else rows)]) if k or not causal else None
            assert r.threshold == (pytest.approx(t) if t is not None else None)
            assert r.gated == (rows[k][2] if (causal and k < 40) or rows[k][1] <= t else 0.0)
    assert audit.gate(df.where("false")).count() == audit.gate(df.where("false"), False).count() == 0
