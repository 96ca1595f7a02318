"""Long-memory estimators as grouped regressions over series tables (ticker, i, r).

``i`` counts a series' finite returns from 0. A window is detrended by polynomials that are
orthogonal over its places: the error that is left is its sum of squares less the square of each projection, over
norms that are known in closed form. So every estimator is one aggregation by
(ticker, scale, window) and one by (ticker, scale), and windows that overlap take their sums from running ones.
Series of any length are cut in blocks; none is one task.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.blocked import halo, in_blocks, inside, numbered, own, scans, spread, up_to

Q_VALUES = (-4.0, -3.0, -2.0, -1.0, 0.5, 1.0, 2.0, 3.0, 4.0)


def _grid(low: int, n: int, count: int, order: int) -> list[int]:
    grid = np.unique(np.logspace(np.log10(low), np.log10(max(n // 4, low)), count).astype(int))
    return [int(s) for s in grid if 2 * (order + 1) < s <= n // 2]


def dfa_scales(n: int, order: int = 1) -> list[int]:
    """Truncated log-spaced window lengths from 10 to a quarter of ``n``."""
    return _grid(10, n, 20, order)


def mfdfa_scales(n: int, order: int = 2) -> list[int]:
    """Truncated log-spaced window lengths from 20 to a quarter of ``n``."""
    return _grid(20, n, 12, order)


def finite(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def series(panel: DataFrame, value: str = "r", order: str = "date") -> DataFrame:
    """ticker, i, r: the finite values of each ticker, compacted. Rows that have a place i already needn't be ordered again."""
    rows = panel if "i" in panel.columns else numbered(panel, order)
    x = in_blocks(rows.where(finite(value)).select("ticker", "i", F.col(value).alias("r")))
    return scans(x, k=("count", "r")).select("ticker", (F.col("k") - 1).alias("i"), "r")


def profile(rows: DataFrame, least: int) -> DataFrame:
    """ticker, block, i, r, n, x (r less its mean) and y, the running sum of x; series of fewer than ``least`` go."""
    x = scans(in_blocks(rows.select("ticker", "i", "r")), n=("n", "r"), mean=("mean", "r"), std=("std", "r"), s=("sum", "r")).where(F.col("n") >= least)
    flat = F.col("std") <= 1e-13 * F.abs("mean")  # but for rounding
    return x.select("ticker", "block", "i", "r", "n", F.when(flat, 0.0).otherwise(F.col("r") - F.col("mean")).alias("x"), F.when(flat, 0.0).otherwise(F.col("s") - (F.col("i") + 1) * F.col("mean")).alias("y"))


def scales_of(n: str, of) -> Column:
    """``of`` a length, as an array."""

    @F.pandas_udf("array<int>")
    def by_length(n):
        known = {int(k): of(int(k)) for k in n.unique()}
        return n.map(lambda k: known[int(k)])

    return by_length(n)


def with_scales(rows: DataFrame, scales: list[int] | None, of) -> DataFrame:
    """Rows (with n and block) once for each scale of their series: those given, or ``of`` its length."""
    if scales is not None:
        return rows.withColumn("s", F.explode(F.array(*map(F.lit, scales))))
    lengths = rows.groupBy("ticker").agg(F.first("n").alias("__n")).select("ticker", scales_of("__n", of).alias("scales"))
    return spread(rows, lengths).withColumn("s", F.explode("scales")).drop("scales")


def orthogonal(s: Column, order: int) -> tuple[list[list[Column]], list[Column]]:
    """Polynomials over the s places of a window, which are counted from its middle: coefficients, constant first, and norms, of those of degree 0 to ``order``."""
    zero, one = F.lit(0.0), F.lit(1.0)
    found, norms = [[one]], [s]
    for k in range(1, order + 1):
        ratio = F.lit((k - 1) ** 2 / (16.0 * (k - 1) ** 2 - 4)) * (s * s - (k - 1) ** 2) if k > 1 else zero
        before = found[-2] if k > 1 else []
        found.append([(found[-1][j - 1] if j else zero) - (ratio * before[j] if j < len(before) else zero) for j in range(k + 1)])
        norms.append(norms[-1] * (F.lit(k * k / (16.0 * k * k - 4)) * (s * s - k * k)))
    return found, norms


def _windows(x: DataFrame, order: int) -> DataFrame:
    """ticker, s, w, from, f2, raw: the mean square that detrending leaves in each window, and that before. x (ticker, s, from, w, y, u), u from a window's middle.

    Variances and covariances are merged from partial ones before the shuffle, and need no other pass over a window.
    """
    s = F.col("s").cast("double")
    found, norms = orthogonal(s, order)
    poly = [sum((c * F.pow("u", F.lit(float(j))) for j, c in enumerate(p[1:], 1)), p[0]) for p in found]
    got = x.groupBy("ticker", "s", "from", "w").agg(F.var_pop("y").alias("raw"), *[F.covar_pop("y", poly[k]).alias(f"c{k}") for k in range(1, order + 1)])
    left = F.col("raw") - sum((s * F.pow(f"c{k}", F.lit(2.0)) / norms[k] for k in range(1, order + 1)), F.lit(0.0))
    return got.select("ticker", "s", "from", "w", left.alias("f2"), "raw")


def _cut(rows: DataFrame, both: bool) -> DataFrame:
    """Rows with n and s in windows from the start and, if ``both``, from the end: from, w, u."""
    x = rows.withColumn("m", F.expr("n div s")).withColumn("from", F.explode(F.array(*map(F.lit, (0, 1) if both else (0,)))))
    x = x.withColumn("j", F.when(F.col("from") == 0, F.col("i")).otherwise(F.col("i") - (F.col("n") - F.col("m") * F.col("s")))).where("j >= 0 and j < m * s")
    return x.withColumn("w", F.expr("j div s")).withColumn("u", F.expr("j % s") - (F.col("s") - 1) / 2.0)


def _slope(fs: DataFrame, *keys: str, least: int = 4) -> DataFrame:
    """keys, h: the slope of ln f on ln s where at least ``least`` scales have f > 0."""
    return fs.where("f > 0").groupBy(*keys).agg(F.regr_slope(F.ln("f"), F.ln("s")).alias("h"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).drop("k")


def dfa(rows: DataFrame, scales: list[int] | None = None, order: int = 1) -> DataFrame:
    """ticker, h by detrended fluctuation analysis of any order; series under 100 values, or with fewer than 4 scales, have none."""
    x = with_scales(profile(rows, 100), scales, lambda n: dfa_scales(n, order)).where(f"s > {2 * (order + 1)} and s <= n div 2")
    fs = _windows(_cut(x, False), order).groupBy("ticker", "s").agg(F.sqrt(F.avg(F.greatest("f2", F.lit(0.0)))).alias("f"))
    return _slope(fs, "ticker")


def moments(windows: DataFrame, keys: tuple[str, ...], q_values: tuple[float, ...] = Q_VALUES) -> DataFrame:
    """keys, q, s, f: mean fluctuations of the windows (keys, s, f2) by each q, where at least 4 windows have one."""
    each = windows.withColumn("q", F.explode(F.array(*map(F.lit, q_values))))
    near_zero = F.abs("q") < 1e-8
    f = F.when(near_zero, F.exp(F.avg(F.ln("f2")) / 2)).otherwise(F.pow(F.avg(F.pow("f2", F.col("q") / 2)), 1 / F.nullif("q", F.lit(0.0))))
    return each.groupBy(*keys, "q", "s").agg(f.alias("f"), F.count(F.lit(1)).alias("k")).where("k >= 4").drop("k")


def mfdfa(rows: DataFrame, scales: list[int] | None = None, q_values: tuple[float, ...] = Q_VALUES, order: int = 2) -> DataFrame:
    """ticker, q, s, f: fluctuations of windows from both ends, detrended by polynomials of ``order``; 200 values at least.

    A window that fits but for rounding has no fluctuation.
    """
    x = with_scales(profile(rows, 200), scales, lambda n: mfdfa_scales(n, order)).where(f"s > {2 * (order + 1)} and s <= n div 2")
    return moments(_windows(_cut(x, True), order).where("f2 > 1e-12D * raw"), ("ticker",), q_values)


def rolling_windows(compact: DataFrame, spans: DataFrame, longest: int, scales: list[int] | None, of, order: int, both: bool) -> DataFrame:
    """ticker, end, s, f2, raw of the windows within spans (ticker, end, lo, hi) of a compacted series (ticker, i, r), each of ``longest`` rows at most.

    Rows go to their block of ``longest`` and the next one, and all of a span stands in one of these pairs. There running sums of the profile times powers of the place
    (both from the middle of the pair, so that they stay small) give each window's sums at its two ends: so much as the windows have ends is joined, however
    many rows they cover. Window lengths are those given, or ``of`` a span's own length.
    """
    x = halo(compact.select("ticker", "i", "r"), before=longest, size=longest)
    mean = F.avg("r").over(W.partitionBy("ticker", "block"))
    x = x.withColumn("x", F.col("r") - mean).withColumn("y", F.sum(F.when(F.abs("x") > 1e-13 * F.abs(F.col("r")), F.col("x")).otherwise(0.0)).over(up_to()))
    x = x.withColumn("y", F.col("y") - F.avg("y").over(W.partitionBy("ticker", "block"))).withColumn("u", (F.col("i") - F.col("block") * longest).cast("double"))
    powers = [F.sum(F.col("y") * F.pow("u", F.lit(float(k)))).over(up_to()).alias(f"m{k}") for k in range(order + 1)]
    sums = x.select("ticker", "block", F.col("i").alias("at"), F.sum(F.col("y") * F.col("y")).over(up_to()).alias("yy"), *powers)
    cuts = spans.withColumn("block", F.floor((F.col("hi") - 1) / longest)).withColumn("n", F.col("hi") - F.col("lo"))
    cuts = cuts.withColumn("s", F.explode(scales_of("n", of) if scales is None else F.array(*map(F.lit, scales)))).where("s <= n div 2").withColumn("m", F.expr("n div s")).withColumn("from", F.explode(F.array(*map(F.lit, (0, 1) if both else (0,))))).withColumn("w", F.explode(F.expr("sequence(0L, m)")))
    at = F.when(F.col("from") == 0, F.col("lo") + F.col("w") * F.col("s")).otherwise(F.col("hi") - (F.col("m") - F.col("w")) * F.col("s")) - 1
    met = cuts.select("ticker", "end", "block", "s", "from", "w", at.alias("at")).join(sums, ["ticker", "block", "at"], "left")
    before = W.partitionBy("ticker", "end", "s", "from").orderBy("w")
    held = [f"m{k}" for k in range(order + 1)]
    differences = [(F.coalesce(F.col(k), F.lit(0.0)) - F.coalesce(F.lag(k).over(before), F.lit(0.0))).alias(k) for k in ("yy", *held)]
    # what rounding leaves in differences of running sums, however flat the window
    met = met.select("ticker", "end", "s", "w", (1e-13 * F.coalesce("yy", F.lit(0.0))).alias("noise"), (F.col("at") - F.col("block") * longest - (F.col("s") - 1) / 2.0).alias("mid"), *differences).where("w > 0")
    moved = [sum((comb(k, j) * F.pow(-F.col("mid"), F.lit(float(k - j))) * F.col(f"m{j}") for j in range(k)), F.col(f"m{k}")).alias(f"m{k}") for k in range(order + 1)]
    met = met.select("ticker", "end", "s", "noise", "yy", *moved)
    s = F.col("s").cast("double")
    found, norms = orthogonal(s, order)
    raw = (F.col("yy") - F.col("m0") * F.col("m0") / s) / s
    projected = [sum((c * F.col(f"m{j}") for j, c in enumerate(p[1:], 1)), p[0] * F.col("m0")) for p in found]
    left = raw - sum((projected[k] * projected[k] / norms[k] for k in range(1, order + 1)), F.lit(0.0)) / s
    return met.select("ticker", "end", "s", F.when(left * s > F.col("noise"), left).otherwise(0.0).alias("f2"), raw.alias("raw"))


def spans_of(panel: DataFrame, lookback: int, step: int) -> tuple[DataFrame, DataFrame]:
    """The compacted series of panel (ticker, i, r), which has a row for each place, and (ticker, end, lo, hi): where in it the ``lookback`` rows
    before each end stand, for ends lookback, lookback + step, ... with four fifths of the rows having a value."""
    x = in_blocks(panel.select("ticker", "i", F.when(finite("r"), F.col("r")).alias("r")))
    marked = scans(x, k=("count", "r"))
    compact = marked.where("r is not null").select("ticker", (F.col("k") - 1).alias("i"), "r")
    seen = halo(marked.drop("block"), before=lookback).withColumn("have", F.count("r").over(inside().rowsBetween(-lookback, -1))).withColumn("hi", F.coalesce(F.lag("k").over(inside()), F.lit(0)))
    ends = own(seen).where((F.col("i") >= lookback) & ((F.col("i") - lookback) % step == 0) & (F.col("have") >= 0.8 * lookback))
    return compact, ends.select("ticker", F.col("i").alias("end"), (F.col("hi") - F.col("have")).alias("lo"), "hi")


def spectrum(fluctuations: DataFrame, *keys: str) -> DataFrame:
    """keys (or ticker), q, h where at least 4 scales count."""
    return _slope(fluctuations, *(keys or ("ticker",)), "q")


def delta_h(spectra: DataFrame) -> DataFrame:
    """ticker, delta_h: the width of the spectrum, largest h less smallest."""
    return spectra.groupBy("ticker").agg((F.max("h") - F.min("h")).alias("delta_h"))


def bandwidth(rows: DataFrame) -> DataFrame:
    """ticker, n, rho, q: Andrews' bandwidth for an AR(1), between 1 and n div 4. rows has x (centred) and n."""
    lagged = own(halo(rows.select("ticker", "i", "x", "n"), before=1).withColumn("x1", F.lag("x").over(inside())))
    rho = F.least(F.greatest(F.try_divide(F.sum(F.col("x") * F.col("x1")), F.sum(F.col("x1") * F.col("x1"))), F.lit(-0.97)), F.lit(0.97))
    got = lagged.groupBy("ticker", "n").agg(F.coalesce(rho, F.lit(0.0)).alias("rho"))
    alpha = 4 * F.col("rho") * F.col("rho") / F.pow(1 - F.col("rho") * F.col("rho"), F.lit(2.0))
    q = F.ceil(F.lit(1.1447) * F.pow(alpha * F.col("n"), F.lit(1.0 / 3))).cast("int")
    return got.select("ticker", "n", "rho", F.greatest(F.lit(1), F.least(q, F.expr("cast(n div 4 as int)"))).alias("q"))


def long_run_std(rows: DataFrame, q: DataFrame) -> DataFrame:
    """ticker, q, s: Newey and West's. rows (ticker, block, i, x, y, n) of a profile, q (ticker, q).

    Weights that fall in a straight line to nought at lag q + 1 are what a box of q + 1 places makes of itself. So the weighted sum of
    autocovariances is the mean square of the sums of q + 1 neighbours, with nothing beyond either end, and each
    of these is a difference of the profile at two places: a row meets one other, whatever q.
    """
    x = spread(rows.select("ticker", "block", "i", "y", "n"), q.select("ticker", "q"))
    there = x.select("ticker", (F.col("i") + F.col("q") + 1).alias("i"), F.col("y").alias("y0"))
    met = x.join(there, ["ticker", "i"], "left")
    box = F.col("y") - F.coalesce("y0", F.lit(0.0))
    past = F.when(F.col("i").between(F.col("n") - F.col("q") - 1, F.col("n") - 2), F.col("y") * F.col("y")).otherwise(0.0)
    return met.groupBy("ticker", "q").agg(F.sqrt(F.greatest(F.sum(box * box + past) / (F.first("n") * (F.first("q") + 1)), F.lit(1e-16))).alias("s"))


def modified_rs(rows: DataFrame, q: int | None = None) -> DataFrame:
    """ticker, n, q, v, rejects_null_95, h_implied: Lo's rescaled range; ``q`` 0 is the classical one. 100 values at least."""
    x = profile(rows, 100)
    bands = bandwidth(x) if q is None else x.groupBy("ticker").agg(F.lit(q).alias("q"))
    ranges = x.groupBy("ticker", "n").agg((F.max("y") - F.min("y")).alias("range"))
    got = ranges.join(long_run_std(x, bands), "ticker").withColumn("rs", F.col("range") / F.col("s")).withColumn("v", F.col("rs") / F.sqrt("n"))
    return got.select("ticker", "n", "q", "v", ((F.col("v") > 1.862) | (F.col("v") < 0.809)).alias("rejects_null_95"), (F.ln("rs") / F.ln("n")).alias("h_implied"))


def rolling_dfa(panel: DataFrame, lookback: int = 500, step: int = 21, scales: list[int] | None = None, order: int = 1) -> DataFrame:
    """ticker, i, h: DFA of the ``lookback`` returns before row i, for i = lookback, lookback + step, ... where at least
    four fifths of them have a value; the others are passed over.

    panel (ticker, i, r) has a row for each place.
    """
    compact, spans = spans_of(panel, lookback, step)
    windows = rolling_windows(compact, spans, lookback, scales, lambda n: dfa_scales(n, order), order, False)
    fs = windows.groupBy("ticker", "end", "s").agg(F.sqrt(F.avg(F.greatest("f2", F.lit(0.0)))).alias("f"))
    return _slope(fs, "ticker", "end").withColumnRenamed("end", "i")


def rolling_mfdfa(panel: DataFrame, lookback: int = 500, step: int = 21, scales: list[int] | None = None, q_values: tuple[float, ...] = Q_VALUES, order: int = 2) -> DataFrame:
    """ticker, i, delta_h, h2: width of the multifractal spectrum, and h at q = 2, of the ``lookback`` returns before row i, for
    i = lookback, lookback + step, ... where at least four fifths of them have a value; the others are passed over. 200 values at least.

    panel (ticker, i, r) has a row for each place.
    """
    compact, spans = spans_of(panel, lookback, step)
    windows = rolling_windows(compact, spans.where("hi - lo >= 200"), lookback, scales, lambda n: mfdfa_scales(n, order), order, True)
    h = spectrum(moments(windows.where("f2 > 1e-12D * raw"), ("ticker", "end"), q_values), "ticker", "end")
    return h.groupBy("ticker", F.col("end").alias("i")).agg((F.max("h") - F.min("h")).alias("delta_h"), F.max(F.when(F.col("q") == 2, F.col("h"))).alias("h2"))


def rolling_apply(panel: DataFrame, fn, lookback: int, step: int = 21, size: int | None = None) -> DataFrame:
    """ticker, i, value: ``fn`` (a numpy array to a float) of the lookback rows before row i; null where a fifth of
    them lack a value or it raises. An Arrow group is a block of ``size`` rows and the lookback rows ahead of it."""
    size = size or max(8192, 4 * lookback)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        r, i, out = pdf["r"].to_numpy(float), pdf["i"].to_numpy(), []
        begin = int(pdf["block"].iloc[0]) * size
        for place in np.flatnonzero((i >= begin) & (i < begin + size) & (i >= lookback) & ((i - lookback) % step == 0)):
            x = r[place - lookback : place]
            x = x[np.isfinite(x)]
            try:
                v = float(fn(x)) if len(x) >= 0.8 * lookback else None
            except Exception:  # noqa: BLE001  what fn can't do has no value
                v = None
            out.append((pdf["ticker"].iloc[0], i[place], v))
        return pd.DataFrame(out, columns=["ticker", "i", "value"])

    return halo(panel.select("ticker", "i", "r"), before=lookback, size=size).groupBy("ticker", "block").applyInPandas(one, "ticker string, i long, value double")


def annual_vol(value: Column | str, least: int = 20) -> Column:
    return F.when(F.count(value) >= least, F.stddev_pop(value) * F.sqrt(F.lit(252.0)))
