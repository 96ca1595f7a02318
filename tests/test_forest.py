"""Trees from added histograms are those that one window's rows give by themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import synthetic
from tidemark.operators import forest, model


def alone(codes, y, at, trees, depth, least, rate, bins):
    """One window's trees, row by row."""
    edges = [forest.cuts(np.bincount(c, minlength=2 * forest.MOST + 1), bins) for c in codes.T]
    train, test = (np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]) for x in (codes, at))
    fitted, out = np.full(len(y), y.mean()), np.full(len(at), y.mean())
    for _ in range(trees):
        left, node, place = y - fitted, np.zeros(len(y), int), np.zeros(len(at), int)
        for level in range(depth):
            feature, cut = np.zeros(1 << level, int), np.full(1 << level, bins)
            for k in range(1 << level):
                best, mine = 0.0, node == k
                for f in range(train.shape[1]):
                    for c in range(bins):
                        a = mine & (train[:, f] <= c)
                        b = mine & ~a
                        if a.sum() >= least and b.sum() >= least:
                            gain = left[a].sum() ** 2 / a.sum() + left[b].sum() ** 2 / b.sum() - left[mine].sum() ** 2 / mine.sum()
                            if gain > best * (1 + 1e-12):
                                best, feature[k], cut[k] = gain, f, c
            node = 2 * node + (train[np.arange(len(y)), feature[node]] > cut[node])
            place = 2 * place + (test[np.arange(len(at)), feature[place]] > cut[place])
        leaf = rate * np.bincount(node, left, 1 << depth) / np.maximum(np.bincount(node, minlength=1 << depth), 1)
        fitted, out = fitted + leaf[node], out + leaf[place]
    return out


@pytest.fixture(scope="module")
def panel(spark):
    days = spark.range(260).select(F.expr("date_add(date'1995-01-01', cast(id as int))").alias("date"), F.col("id").alias("k"))
    rows = days.crossJoin(spark.range(12).select(F.concat(F.lit("t"), "id").alias("ticker"), F.col("id").alias("j")))
    made = rows.select("date", "ticker", *[(0.1 * synthetic.normal(F.lit(f), "k", "j")).alias(f) for f in model.FEATURES])
    return made.withColumn("target", F.sin(20 * F.col("fd_z")) + F.when(F.col("ret_1m") > 0, F.col("vol_60")).otherwise(0.0)).repartition(3).cache()


def test_as_each_window_alone(spark, panel, monkeypatch):
    monkeypatch.setattr(forest, "WRITE", 2)
    how = {"trees": 5, "depth": 3, "least": 40, "rate": 0.3, "bins": 8}
    protocol = {"embargo": 22, "min_train": 300}
    got = {(r.date, r.ticker): r.prediction for r in forest.walk_forward(panel, **how, **protocol).collect()}
    x = panel.select("date", "ticker", "target", *[forest.fine(f).alias(f) for f in model.FEATURES]).toPandas().sort_values(["date", "ticker"])
    sets = model.train_sets(panel, **protocol).collect()
    assert len(sets) >= 4
    for r in sets:
        train, test = x[(x.date >= r.train_start) & (x.date <= r.train_end)], x[x.date == r.rebal]
        want = alone(train[list(model.FEATURES)].to_numpy(), train.target.to_numpy(), test[list(model.FEATURES)].to_numpy(), **how)
        assert [got.pop((r.rebal, t)) for t in test.ticker] == pytest.approx(want.tolist(), abs=1e-9)
    assert not got


def test_no_month_end_has_rows_enough(spark, panel):
    assert forest.walk_forward(panel, trees=2, min_train=10**6).count() == forest.walk_forward(panel.where("false"), trees=2).count() == 0


def test_learns_what_is_there(spark, panel):
    got = forest.walk_forward(panel, trees=8, rate=0.3, bins=16, least=20, min_train=300).join(panel, ["date", "ticker"])
    assert got.agg(F.corr("prediction", "target")).first()[0] > 0.6
