"""Panel queries against DuckDB on the small tables, and properties that the estimators must have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from tidemark.functions import fracdiff, fractal, synthetic
from tidemark.operators import backtest as bt
from tidemark.operators import audit, frames, model
from tidemark.plans import catalogue
from tidemark.sources import panels

FEW = ["daily_bars", "dense_panel", "feature_panel", "momentum_sort_backtest", "bt_stats_net", "hurst_dfa_full", "mfdfa_spectrum", "exec_shortfall", "exec_summary", "stream_hourly_bars", "ffd_series", "gen_ar1", "residualize_fwl", "welch_psd", "mean_psd", "series_alignment", "hurst_class_summary", "band_breaches", "shuffle_means", "rank_persistence"]


@pytest.mark.parametrize("name", FEW)
def test_query_matches_sql(spark, sf, name):
    n, m, bad = differences(spark, connect(sf), catalogue.QUERIES[name], catalogue.ORACLE[name], sf)
    assert n == m and not bad


def test_dfa_recovers_h_and_matches_polyfit(spark):
    made = synthetic.fgn(spark, [(2000, 0.5, k) for k in range(5)] + [(2000, 0.75, k) for k in range(5)] + [(2000, 0.3, k) for k in range(5)])
    named = made.select(F.concat_ws("|", "true_h", "seed").alias("ticker"), "i", "r").cache()
    got = {r.ticker: r.h for r in fractal.dfa(named).collect()}
    for h, low, high in ((0.5, 0.43, 0.57), (0.75, 0.65, 0.85), (0.3, 0.2, 0.4)):
        assert low < np.mean([v for k, v in got.items() if float(k.split("|")[0]) == h]) < high
    x = np.array([r.r for r in named.where("ticker = '0.5|0'").orderBy("i").collect()])
    y, fs, scales = np.cumsum(x - x.mean()), [], fractal.dfa_scales(len(x))
    for s in scales:
        parts = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s)
        fs.append(np.sqrt(np.mean([np.mean((p - np.polyval(np.polyfit(t, p, 1), t)) ** 2) for p in parts])))
    assert abs(np.polyfit(np.log(scales), np.log(fs), 1)[0] - got["0.5|0"]) < 1e-9



def test_costs_are_charged_on_notional(spark):
    rows = spark.createDataFrame([(1, 0.01, None, None), (2, 0.02, 4.0, 1.0), (3, 0.0, 2.0, 0.5)], "seq long, ls_r double, traded double, turnover double")
    net = [r.net_r for r in bt.net_returns(rows, 10.0).orderBy("seq").collect()]
    assert np.allclose(net, [0.01, 0.02 - 40e-4, -20e-4])
    legacy = rows.withColumn("traded", F.lit(None).cast("double"))
    assert np.allclose([r.net_r for r in bt.net_returns(legacy, 10.0).orderBy("seq").collect()], net)


def test_embargo_leaves_the_horizon_out(spark, sf):
    for r in catalogue.QUERIES["walkforward_train_sets"](spark, "/root/testdata/sf0.01").collect():
        assert r.last_used <= r.train_end and (r.rebal - r.train_end).days >= 30


def test_trees_are_fitted_anew_at_each_month_end(spark, monkeypatch):
    days = spark.range(700).select(F.expr("date_add(date'1995-01-01', cast(id as int))").alias("date"), F.col("id").alias("i"))
    rows = days.crossJoin(spark.range(12).select(F.format_string("t%02d", "id").alias("ticker"), F.col("id").alias("k")))
    noise = lambda j: (F.xxhash64("i", "k", F.lit(j)) % 1000) / 1000.0
    panel = rows.select("date", "ticker", *[noise(j).alias(f) for j, f in enumerate(model.FEATURES)]).withColumn("target", F.col("fd_z") + 0.1 * F.col("mom_12_1"))
    sets = model.train_sets(panel).count()
    got = model.walk_forward_trees(panel, trees=10).join(panel.select("date", "ticker", "fd_z"), ["date", "ticker"])
    assert got.count() == 12 * sets and sets > 12 and got.agg(F.corr("prediction", "fd_z")).first()[0] > 0.9
    asked, plain = [], model._learner
    monkeypatch.setattr(model, "_learner", lambda *a: asked.append(a) or plain(3, *a[1:]))
    gains = {r.feature: r.gain for r in model.tree_importances(panel).collect()}
    assert [a[0] for a in asked] == [200] and list(gains) == list(model.FEATURES) and max(gains, key=gains.get) == "fd_z"


def test_stream_reads_a_table_of_several_part_files(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want, got = (sorted(map(tuple, catalogue.QUERIES["stream_hourly_bars"](spark, str(d)).collect())) for d in (sf, tmp_path))
    assert want and got == want


def test_differencing_has_the_whole_memory(spark):
    x = [float((k * 7919) % 101) for k in range(1600)]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "ticker string, i long, x double")
    w = np.array(fracdiff.weights(0.4, 1e-5))
    got = [r.y for r in fracdiff.ffd(rows).where("y is not null").orderBy("i").collect()]
    assert len(w) > 1400 and np.allclose(got, np.convolve(x, w, mode="valid"))


def test_noise_floor_has_two_hundred_seeds(spark, sf, monkeypatch):
    asked, plain = [], synthetic.fgn
    monkeypatch.setattr(synthetic, "fgn", lambda s, series: asked.extend(series) or plain(s, series[:1]))
    assert catalogue.QUERIES["noise_floor"](spark, sf).count() == 1
    assert len(set(asked)) == 3000 and {n for n, _, _ in asked} == {500, 1000, 2000, 4000, 5300}


def test_made_series_are_made_once_in_many_tasks_and_never_broadcast(spark):
    made = synthetic.fgn(spark, [(4000, 0.5, k) for k in range(100)])
    assert len(made.inputFiles()) == 3 and made.select("seed", "i").distinct().count() == 400_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        got = fractal.profile(made.select(F.col("seed").cast("string").alias("ticker"), "i", "r"), 100).agg(F.count("y"), F.sum("y"))
        assert got.collect()[0][0] == 400_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = got._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "InPandas" not in plan and "BuildLeft" not in plan  # the rows are on the left


def test_each_backtest_scans_the_fact_table_once(spark, sf):
    for name in ("hurst_sort_backtest", "bt_stats_net", "boot_block_sharpe"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 0 and plan.count("Scan parquet") <= 4, name


def test_trees_without_an_embargo_know_the_future(spark):
    """A target that overlaps the prediction's day is learnt where no embargo keeps it out."""
    from tidemark.operators.trees import boosted

    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(4000, 3)), rng.normal(size=4000)
    known = boosted(x, x[:, 0] ** 2 + 0.1 * noise, x[:500], 100, 4, 50, 0.05, 64)
    blind = boosted(x[500:], noise[500:], x[:500], 100, 4, 50, 0.05, 64)
    assert np.corrcoef(known, x[:500, 0] ** 2)[0, 1] > 0.95 and abs(np.corrcoef(blind, noise[:500])[0, 1]) < 0.15


def test_rolling_spectra_are_those_of_the_windows(spark):
    noise = synthetic.white_noise(spark, 300, 2).select(F.format_string("t|%d", "series_id").alias("ticker"), "i", "r")
    got = {(r.ticker, r.i): r for r in fractal.rolling_mfdfa(noise, 220, 40).collect()}
    assert set(got) == {(f"t|{k}", i) for k in (0, 1) for i in (220, 260)}
    one = noise.where("ticker = 't|1' and i >= 40 and i < 260").select("ticker", (F.col("i") - 40).alias("i"), "r")
    want = fractal.spectrum(fractal.mfdfa(one, fractal.mfdfa_scales(220)))
    assert abs(fractal.delta_h(want).first().delta_h - got["t|1", 260].delta_h) < 1e-9


def test_short_periods_are_left_out_and_the_rest_has_its_noise(spark):
    days = spark.range(900).select(F.lit("t").alias("ticker"), F.expr("date_add(date'2000-01-01', cast(id as int))").alias("date"), synthetic.normal(F.lit("s"), "id").alias("r"))
    edges = [("whole", "2000-01-01", "2002-12-31"), ("short", "2000-01-01", "2000-10-25"), ("year", "2000-01-01", "2000-12-31")]
    got = {r.ticker: r for r in audit.subperiod_significance(days, edges, seeds=30).collect()}
    assert {k: r.n for k, r in got.items()} == {"t|whole": 900, "t|year": 366}
    assert 0 < got["t|whole"].noise < got["t|year"].noise
    for r in got.values():
        assert r.significant == (abs(r.h - 0.5) > 1.96 * r.noise)
    empty = audit.subperiod_significance(days.where("false"), edges)
    assert empty.count() == 0


def test_validation_tells_short_from_long_memory(spark):
    known = synthetic.fgn(spark, [(1000, h, k) for h in (0.3, 0.7) for k in range(5)])
    got = {(r.series, r.estimator): r for r in audit.validation(known, synthetic.white_noise(spark, 1000, 20), synthetic.ar1(spark, 1000, 0.5, 20)).collect()}
    assert len(got) == 6 and got["fractional noise 0.3", "dfa"].mean < 0.45 and got["fractional noise 0.7", "dfa"].mean > 0.6
    # lags take the inflation by short memory out of the range
    assert got["short memory", "classical range"].mean > got["short memory", "modified range"].mean
    assert got["white noise", "modified range"].rejections <= 5 and got["white noise", "modified range"].n == 20


def test_windows_with_a_fifth_missing_have_no_h(spark):
    noise = synthetic.white_noise(spark, 400, 1).select(F.lit("t").alias("ticker"), "i", "r")
    holes = noise.withColumn("r", F.when((F.col("i") < 200) | (F.col("i") >= 250), F.col("r")))
    whole = {r.i for r in fractal.rolling_dfa(noise, 200, 40).collect()}
    got = {r.i for r in fractal.rolling_dfa(holes, 200, 40).collect()}
    want = {i for i in whole if sum(200 <= k < 250 for k in range(i - 200, i)) <= 40}
    assert whole == {200, 240, 280, 320, 360} and got == want == {200, 240}


def test_series_are_aligned_by_their_keys(spark):
    day = lambda rows: spark.createDataFrame(rows, "date string, close double")
    got = frames.align("date", "close", a=day([("1", 1.0), ("2", None)]), b=day([("2", 5.0), ("3", 6.0)]), c=day([]))
    assert sorted(map(tuple, got.collect())) == [("1", 1.0, None, None), ("2", None, 5.0, None), ("3", None, 6.0, None)]


def test_prices_come_back_from_their_sinks(spark, tmp_path):
    days = spark.range(500).select(F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("ticker"), F.expr("date_add(date'2000-01-01', cast(id as int))").alias("date"), F.col("id").cast("double").alias("close"), F.lit(2.0).alias("volume"))
    panels.save_bars(days, f"{tmp_path}/bars")
    got = panels.load_prices(spark, f"{tmp_path}/bars", "2000-01-02", "2001-01-01", ["b"])
    assert got.columns == ["ticker", "date", "close"] and sorted(r.close for r in got.collect()) == [float(k) for k in range(1, 367, 2)]
    assert {r.close for r in panels.load_prices(spark, f"{tmp_path}/bars", "2000-01-01", "2009-01-01", field="volume").collect()} == {2.0}
    panels.save_csv(got, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == got.count()


def test_report_names_gross_and_net(spark, sf):
    text = bt.report(catalogue.momentum(spark, "/root/testdata/sf0.01"), "momentum")
    assert text.splitlines()[0] == "momentum" and "gross: return" in text and "net: return" in text
