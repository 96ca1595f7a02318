"""Fractional differencing with a fixed width, and the least order that makes a series stationary."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blocked

#: Rows of a ticker that are differenced together, or as many as there are weights, if more.
BLOCK = 4096


def weights(d: float, tau: float = 1e-5, most: int = 10_000) -> list[float]:
    """Up to the last that is at least ``tau`` in size."""
    w = [1.0]
    while len(w) < most and abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= tau:
        w.append(nxt)
    return w


def weight_table(spark: SparkSession, d: float, tau: float) -> DataFrame:
    return spark.createDataFrame(list(enumerate(weights(d, tau))), "k long, w double")


def ffd(rows: DataFrame, d: float = 0.4, tau: float = 1e-5) -> DataFrame:
    """rows (ticker, i, x), compacted: adds y, the weighted sum of x and what stands before; null until the weights fit.

    A ticker's rows are cut into blocks. A block and the values just before it, as many as there are weights, are one
    Arrow group, so that a value goes to one or two of them.
    """
    w = np.array(weights(d, tau))
    ahead, size = len(w) - 1, max(BLOCK, len(w))
    blocks = F.sequence(F.floor(F.col("i") / size), F.floor((F.col("i") + ahead) / size))
    dealt = rows.where("x is not null").select("ticker", "i", "x", F.explode(blocks).alias("block"))

    def one(pdf):
        import pandas as pd

        begin = int(pdf["block"].iloc[0]) * size
        x = np.full(size + ahead, np.nan)
        x[pdf["i"].to_numpy() - begin + ahead] = pdf["x"].to_numpy(float)
        y = np.convolve(x, w, mode="valid")
        k = np.flatnonzero(np.isfinite(y))
        return pd.DataFrame({"__t": pdf["ticker"].iloc[0], "__i": begin + k, "y": y[k]})

    made = dealt.groupBy("ticker", "block").applyInPandas(one, "__t string, __i long, y double")
    return rows.drop("y").join(made, (F.col("ticker") == F.col("__t")) & (F.col("i") == F.col("__i")), "left").drop("__t", "__i")


#: MacKinnon's response surface for the t with a constant, by powers of t: below and above the middle, and the ends beyond which p is 0 or 1.
P_SMALL, P_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
T_LEAST, T_MIDDLE, T_MOST = -18.83, -1.61, 2.74


def p_value(t: Column) -> Column:
    """Of the Dickey-Fuller t with a constant: the normal probability of a polynomial in t."""
    def polynomial(c: tuple[float, ...]) -> Column:
        return sum((F.lit(a) * F.pow(t, F.lit(float(k))) for k, a in enumerate(c)), F.lit(0.0))

    z = F.when(t <= T_MIDDLE, polynomial(P_SMALL)).otherwise(polynomial(P_LARGE))
    return F.when(t < T_LEAST, 0.0).when(t > T_MOST, 1.0).otherwise(normal_cdf(z))


def normal_cdf(z: Column) -> Column:
    """By its series about nought within four deviations, by the continued fraction of the tail outside: fifteen digits and twelve."""
    square = z * z

    def term(state: Column, k: Column) -> Column:
        t = state["t"] * square / (2 * k + 1)
        return F.struct(t.alias("t"), (state["s"] + t).alias("s"))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), term, lambda x: x["s"])
    density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
    far = density / F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(60))), F.abs(z), lambda c, k: F.abs(z) + k / c)
    return F.when(F.abs(z) <= 4, 0.5 + density * near).when(z > 0, 1 - far).otherwise(far)


def most_lags(n: int) -> int:
    return min(int(np.ceil(12 * (n / 100) ** 0.25)), (n - 1) // 2 - 2)


def design(y: np.ndarray, lags: int) -> np.ndarray:
    """Rows for the differences of y from the ``lags``-th on: a constant, the level before, the differences before, the difference itself."""
    dx = np.diff(y)
    return np.column_stack([np.ones(len(dx) - lags), y[lags:-1], *[dx[lags - j : len(dx) - j] for j in range(1, lags + 1)], dx[lags:]])


def chosen(gram: np.ndarray, head: np.ndarray, n: int) -> tuple[int, float] | None:
    """Number of lagged differences, and the t of the level: from the cross products of ``design`` with the most lags, and the values that its first rows
    don't reach. One triangular factor has the error of every number of lags; AIC chooses. None for columns that depend on each other."""
    lags = gram.shape[0] - 3
    scale = np.sqrt(np.diag(gram))
    if not (scale > 0).all():
        return None
    try:
        last = np.linalg.cholesky(gram / np.outer(scale, scale))[-1] * scale[-1]
    except np.linalg.LinAlgError:
        return None
    rows = n - 1 - lags
    errors = np.cumsum(last[::-1] ** 2)[::-1][2:]  # of models with 0, 1, ... lags
    k = int(np.argmin(rows * np.log(np.maximum(errors, 1e-300) / rows) + 2 * (2 + np.arange(lags + 1))))
    keep = [*range(k + 2), lags + 2]
    early = design(head, k)  # the rows that the common sample leaves out
    g = gram[np.ix_(keep, keep)] + early.T @ early
    inverse = np.linalg.inv(g[:-1, :-1])
    b = inverse @ g[:-1, -1]
    error = g[-1, -1] - b @ g[:-1, -1]
    return k, float(b[1] / np.sqrt(error / (n - 1 - k - (k + 2)) * inverse[1, 1]))


GRID = tuple(round(0.05 * k, 2) for k in range(21))
_PARTIAL = "ticker string, d double, n long, part long, gram array<double>, place array<long>, head array<double>"


def adf(rows: DataFrame, grid: tuple[float, ...] = GRID, tau: float = 1e-5) -> DataFrame:
    """ticker, d, n, lags, t, p_value: the augmented Dickey-Fuller test with a constant of each series differenced by each d.

    rows (ticker, i, x); values that aren't finite are passed over. Series of fewer than 200 values, and differenced ones of fewer than 100 or that a line fits, have no row.
    A block of a ticker and the values ahead of it are one Arrow group, which gives the cross products of level, differences and lags over the block's own rows;
    these are added up, 64 blocks at a time and then all of a (ticker, d), and one small matrix chooses the lags. A history is in no group.
    """
    known = {d: np.array(weights(d, tau)) for d in grid}
    longest = max(map(len, known.values()))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    compact = blocked.scans(blocked.in_blocks(rows.where(finite).select("ticker", "i", "x")), k=("count", "x"), n=("n", "x"), mean=("mean", "x")).where("n >= 200")
    # lags grow with the fourth root of the longest series: from a block's length, room for those of 10^9 values
    size = max(BLOCK, 2 * longest)
    ahead = longest + 700
    blocks = F.sequence(F.floor((F.col("k") - 1) / size), F.floor((F.col("k") - 1 + ahead) / size))
    dealt = compact.select("ticker", (F.col("k") - 1).alias("i"), "x", "n", "mean", F.explode(blocks).alias("block"))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        n, mean, block = int(pdf["n"].iloc[0]), float(pdf["mean"].iloc[0]), int(pdf["block"].iloc[0])
        x, first, begin = pdf["x"].to_numpy(float), int(pdf["i"].iloc[0]), block * size
        out = []
        for d, w in known.items():
            length = n - len(w) + 1
            if length < 100 or len(x) < len(w) or first + len(x) <= begin:
                continue
            lags = most_lags(length)
            y = np.convolve(x, w, mode="valid") - mean * w.sum()  # y[0] is value number first of the differenced series
            own = max(begin - (len(w) - 1), 0) - first  # the first of the block's own values
            start = max(own, lags + 1 - first)
            rows = design(y[start - lags - 1 :], lags) if start < len(y) else np.zeros((0, lags + 3))
            at = np.arange(max(own, 0), max(0, min(len(y), lags + 1 - first)))
            out.append((pdf["ticker"].iloc[0], d, length, block // 64, (rows.T @ rows).ravel(), at + first, y[at]))
        return pd.DataFrame(out, columns=["ticker", "d", "n", "part", "gram", "place", "head"])

    def merged(pdf):
        import pandas as pd

        first = pdf.iloc[0]
        return pd.DataFrame([(first["ticker"], first["d"], first["n"], 0, np.sum(list(pdf["gram"]), axis=0), np.concatenate(list(pdf["place"])), np.concatenate(list(pdf["head"])))], columns=list(pdf.columns))

    def tested(pdf):
        import pandas as pd

        x = merged(pdf).iloc[0]
        side = int(round(len(x["gram"]) ** 0.5))
        got = chosen(np.reshape(x["gram"], (side, side)), x["head"][np.argsort(x["place"])], int(x["n"]))
        return pd.DataFrame([(x["ticker"], x["d"], x["n"], *got)] if got else [], columns=["ticker", "d", "n", "lags", "t"])

    partial = dealt.groupBy("ticker", "block").applyInPandas(one, _PARTIAL).groupBy("ticker", "d", "part").applyInPandas(merged, _PARTIAL)
    return partial.groupBy("ticker", "d").applyInPandas(tested, "ticker string, d double, n long, lags long, t double").withColumn("p_value", p_value(F.col("t")))


def min_d(rows: DataFrame, grid: tuple[float, ...] = GRID, tau: float = 1e-5, most: float = 0.05) -> DataFrame:
    """ticker, min_d: the least d of the grid whose differenced series has a p-value under ``most``; null if none has, or under 200 values."""
    passed = adf(rows, grid, tau).where(F.col("p_value") < most).groupBy("ticker").agg(F.min("d").alias("min_d"))
    return rows.select("ticker").distinct().join(passed, "ticker", "left")
