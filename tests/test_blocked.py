"""Series cut in blocks give what whole ones do, whatever the blocks; detrending of any order; long-run variance by boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import rows
from tidemark.functions import blocked, fractal, synthetic
from tidemark.operators import backtest, frames
from tidemark.sources import panels


@pytest.fixture(scope="module")
def bars(spark):
    """Three tickers over 900 days, the second with gaps and the third from day 100 on, with a null close."""
    day = F.expr("date_add(date'2000-01-01', cast(id as int))").alias("date")
    x = spark.range(900).select("id", day).crossJoin(spark.range(3).select(F.col("id").alias("k")))
    x = x.where("not (k = 1 and id % 7 in (2, 3)) and not (k = 2 and id < 100)")
    close = F.when((F.col("k") == 2) & (F.col("id") == 300), None).otherwise(100 + F.col("k") + F.pmod(F.xxhash64("id", "k"), F.lit(1000)) / 50.0)
    return x.select(F.concat(F.lit("t"), "k").alias("ticker"), "date", close.alias("close"), F.lit(1.0).alias("volume")).cache()


def made(bars):
    index = panels.index_panel(bars)
    feats = frames.features(index).cache()
    gaps = panels.grid(bars)
    noise = fractal.series(feats)
    holes = feats.withColumn("r", F.when(F.col("i") % 11 != 0, F.col("r")))
    return {
        "dense": panels.dense(bars), "index": index, "features": feats, "returns": frames.with_returns(bars), "filled": frames.filled(gaps, "close", "a", "b"), "z": frames.zscored(feats, "ret_1m", "z", 100),
        "series": noise, "profile": fractal.profile(noise, 100).drop("block"), "dfa": fractal.dfa(noise), "mfdfa": fractal.spectrum(fractal.mfdfa(noise)), "rs": fractal.modified_rs(noise), "nw": fractal.bandwidth(fractal.profile(noise, 100)),
        "rolling": fractal.rolling_dfa(holes, 250, 40), "spectra": fractal.rolling_mfdfa(holes, 250, 40), "apply": fractal.rolling_apply(holes, lambda x: x.mean(), 100, 30, 150),
    }


def test_blocks_of_any_size_give_the_same(spark, bars, monkeypatch):
    whole = {k: rows(df.columns, [tuple(r) for r in df.collect()]) for k, df in made(bars).items()}
    monkeypatch.setattr(blocked, "SIZE", 97)
    for k, df in made(bars).items():
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        assert len(got) == len(whole[k]) > 0, k
        for a, b in zip(got, whole[k]):
            assert all(x == y or math.isclose(x, y, rel_tol=1e-7, abs_tol=2e-5) for x, y in zip(a, b)), (k, a, b)


def test_scans_as_pandas(spark, monkeypatch):
    monkeypatch.setattr(blocked, "SIZE", 10)
    rng = np.random.default_rng(4)
    v = [None if x < 0.3 else float(x) for x in rng.random(77)]
    v[:15] = [None] * 15  # a whole block without values
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)] + [("b", 0, 2.0), ("c", 0, None)], "ticker string, i long, v double")
    kinds = ("sum", "count", "max", "last", "next", "mean", "std", "total", "n")
    got = blocked.scans(blocked.in_blocks(df), **{f"o_{k}": (k, "v") for k in kinds}).toPandas().sort_values(["ticker", "i"])
    one = got[got.ticker == "a"]
    s = one.v.reset_index(drop=True).astype(float)
    want = {"sum": s.fillna(0).cumsum().where(s.notna().cumsum() > 0), "count": s.notna().cumsum(), "max": s.cummax().ffill(), "last": s.ffill(), "next": s.bfill(), "mean": 0 * s.fillna(0) + s.mean(), "std": 0 * s.fillna(0) + s.std(), "total": 0 * s.fillna(0) + s.sum(), "n": 0 * s.fillna(0) + s.count()}
    for k in kinds:
        assert np.allclose(one[f"o_{k}"].to_numpy(float), want[k].to_numpy(float), equal_nan=True), k
    b, c = got[got.ticker == "b"].iloc[0], got[got.ticker == "c"].iloc[0]
    assert (b.o_sum, b.o_n, b.o_mean) == (2.0, 1, 2.0) and np.isnan(b.o_std) and c.o_n == c.o_count == 0 and np.isnan(c.o_sum)
    assert blocked.scans(blocked.in_blocks(df.where("false")), s=("sum", "v")).count() == 0


def test_numbers_need_no_window_over_a_ticker(spark):
    x = spark.range(50_000).select(F.element_at(F.array(F.lit("a"), F.lit("b")), F.when(F.col("id") < 40_000, 1).otherwise(2)).alias("ticker"), (F.col("id") * 3 - 7).alias("at"))
    got = blocked.numbered(x, "at")
    assert got.where("ticker = 'a' and i <> (at + 7) / 3").count() == 0 and got.where("ticker = 'b'").agg(F.min("i"), F.max("i")).first()[:] == (0, 9_999)
    ts = x.select("ticker", F.timestamp_seconds("at").alias("ts"))
    assert blocked.numbered(ts, "ts").agg(F.max("i")).first()[0] == 39_999


def brute(x, scales, order, both):
    y, out = np.cumsum(x - x.mean()), {}
    for s in scales:
        m, t = len(y) // s, np.arange(s)
        parts = [y[: m * s].reshape(m, s)] + ([y[len(y) - m * s :].reshape(m, s)] if both else [])
        out[s] = np.array([np.mean((p - np.polyval(np.polyfit(t, p, order), t)) ** 2) for p in np.concatenate(parts)])
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders_as_polyfit(spark, order):
    x = synthetic.white_noise(spark, 700, 1).select(F.lit("t").alias("ticker"), "i", "r").cache()
    r = np.array([v.r for v in x.orderBy("i").collect()])
    scales = fractal.dfa_scales(700, order)
    assert scales[0] > 2 * (order + 1)
    fs = {s: np.sqrt(v.mean()) for s, v in brute(r, scales, order, False).items()}
    want = np.polyfit(np.log(list(fs)), np.log(list(fs.values())), 1)[0]
    assert fractal.dfa(x, order=order).first().h == pytest.approx(want, abs=1e-8)
    wide = brute(r, fractal.mfdfa_scales(700, order), order, True)
    got = {(v.q, v.s): v.f for v in fractal.mfdfa(x, q_values=(-2.0, 0.0, 3.0), order=order).collect()}
    for (q, s), f in got.items():
        assert f == pytest.approx(np.exp(np.log(wide[s]).mean() / 2) if q == 0 else np.mean(wide[s] ** (q / 2)) ** (1 / q), rel=1e-7)
    assert len(got) == 3 * len(wide)
    # windows that overlap, from running sums
    one = fractal.rolling_dfa(x, 300, 100, order=order).orderBy("i").collect()
    for v in one:
        part = brute(r[v.i - 300 : v.i], fractal.dfa_scales(300, order), order, False)
        assert v.h == pytest.approx(np.polyfit(np.log(list(part)), [np.log(np.sqrt(e.mean())) for e in part.values()], 1)[0], abs=1e-7)
    assert [v.i for v in one] == [300, 400, 500, 600]


def test_spectra_of_noise_are_narrow_and_of_heavy_tails_wide(spark):
    rng = np.random.default_rng(42)
    made = {"noise": rng.standard_normal(4000), "tails": rng.standard_t(3, 4000), "short": rng.standard_normal(150)}
    x = spark.createDataFrame([(k, i, float(r)) for k, v in made.items() for i, r in enumerate(v)], "ticker string, i long, r double")
    h = {(v.ticker, v.q): v.h for v in fractal.spectrum(fractal.mfdfa(x)).collect()}
    width = {v.ticker: v.delta_h for v in fractal.delta_h(fractal.spectrum(fractal.mfdfa(x))).collect()}
    assert 0.43 < h["noise", 2.0] < 0.57 and width["noise"] < 0.15 and width["tails"] > width["noise"] and "short" not in width
    assert {v.ticker for v in fractal.spectrum(fractal.mfdfa(x.where("ticker = 'short'"))).collect()} == set()


def test_flat_series_have_no_spectrum(spark):
    flat = spark.range(400).select(F.lit("t").alias("ticker"), F.col("id").alias("i"), F.lit(0.01).alias("r"))
    assert fractal.spectrum(fractal.mfdfa(flat)).count() == 0 and fractal.rolling_mfdfa(flat, 250, 50).count() == 0
    assert fractal.dfa(flat.where("i < 90")).count() == 0 and fractal.rolling_dfa(flat.where("false"), 250, 50).count() == 0


def test_long_run_deviation_as_weighted_autocovariances(spark):
    rng = np.random.default_rng(5)
    e = rng.standard_normal(500)
    for q in (0, 1, 7, 120):
        x = np.convolve(e, [1, 0.8, 0.5])[:500]
        df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "ticker string, i long, r double")
        p = fractal.profile(df, 100)
        c = x - x.mean()
        want = sum((1 if j == 0 else 2 * (1 - j / (q + 1))) * (c[j:] * c[: len(c) - j]).sum() / 500 for j in range(q + 1))
        assert fractal.long_run_std(p, p.groupBy("ticker").agg(F.lit(q).alias("q"))).first().s == pytest.approx(math.sqrt(max(want, 1e-16)), rel=1e-9)


def test_months_without_a_row_have_a_return_of_nought(spark):
    x = spark.createDataFrame([("a", "2000-01-10", 0.1), ("a", "2000-01-20", 0.2), ("a", "2000-04-03", 0.5), ("b", "2000-02-29", None)], "ticker string, date string, r double").withColumn("date", F.col("date").cast("date"))
    got = {(r.ticker, str(r.date)): round(r.r, 9) for r in backtest.month_returns(x).collect()}
    assert got == {("a", "2000-01-31"): 0.3, ("a", "2000-02-29"): 0.0, ("a", "2000-03-31"): 0.0, ("a", "2000-04-30"): 0.5, **{("b", f"2000-{m}"): 0.0 for m in ("01-31", "02-29", "03-31", "04-30")}}
    assert backtest.month_returns(x.where("false")).count() == 0
