"""Bootstrap intervals from runs of neighbours.

A replicate of the stationary bootstrap is a row of runs, some n / block of them. Its means and variances need no
more than the sums of each run, which running sums of the series give at the run's two ends. So there are as many
rows as runs, not draws. Independent draws are runs of one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.blocked import in_blocks, numbered, scans
from tidemark.functions.synthetic import uniform
from tidemark.sources.kept import kept


def most_runs(n: int, block: float) -> int:
    """Runs that are drawn for a replicate: eight deviations more than it takes on average. The last one goes on to the end."""
    return n if block <= 1 else min(n, math.ceil(n / block + 8 * math.sqrt(n / block) + 8))


def runs(session, n: int, n_boot: int, block: float = 1.0, seed: int = 0) -> DataFrame:
    """rep, place, start, length: the stationary bootstrap of a series of n. Each run begins anywhere, has a geometric length with mean
    ``block``, and goes around the series' end; the last one stops where the replicate is full."""
    many = most_runs(n, block)
    x = session.range(n_boot).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("j"))
    start = F.floor(uniform(F.lit(seed), "rep", "j") * n).cast("long")
    if block <= 1:
        return x.select("rep", F.col("j").cast("long").alias("place"), start.alias("start"), F.lit(1).cast("long").alias("length"))
    drawn = (1 + F.floor(F.ln(uniform(F.lit("r"), F.lit(seed), "rep", "j")) / math.log(1 - 1 / block))).cast("long")
    drawn = F.least(F.when(F.col("j") == many - 1, F.lit(n)).otherwise(drawn), F.lit(n))
    placed = x.select("rep", "j", start.alias("start"), drawn.alias("drawn")).withColumn("place", F.sum("drawn").over(W.partitionBy("rep").orderBy("j")) - F.col("drawn"))
    return placed.where(F.col("place") < n).select("rep", "place", "start", F.least("drawn", n - F.col("place")).alias("length"))


def replicates(rows: DataFrame, values: tuple[str, ...], n: int, n_boot: int, block: float, seed: int) -> DataFrame:
    """rep and, for each value, the sum and the sum of squares over a replicate: s_<value>, ss_<value>. rows (k, values), k from 0."""
    squares = {f"ss_{v}": F.col(v) * F.col(v) for v in values}
    x = rows.select(F.lit("").alias("ticker"), F.col("k").alias("i"), *[F.col(v).alias(f"s_{v}") for v in values], *[c.alias(k) for k, c in squares.items()])
    held = [f"s_{v}" for v in values] + list(squares)
    sums = scans(in_blocks(x), **{k: ("sum", k) for k in held})
    sums = kept(sums.select((F.col("i") + 1).alias("at"), *held))  # of all that stands before a place
    whole = [F.col(k).alias(f"all_{k}") for k in held]
    total = sums.where(F.col("at") == n).select(*whole)  # one row
    drawn = runs(rows.sparkSession, n, n_boot, block, seed).withColumn("end", F.col("start") + F.col("length"))
    around = F.col("end") > n
    ends = drawn.select("rep", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign"), F.lit(0).alias("turns")), F.struct(F.when(around, F.col("end") - n).otherwise(F.col("end")).alias("at"), F.lit(1.0).alias("sign"), around.cast("int").alias("turns")))).alias("e")).select("rep", "e.*")
    met = ends.join(sums, "at", "left").crossJoin(F.broadcast(total))
    return met.groupBy("rep").agg(*[F.sum(F.col("sign") * F.coalesce(F.col(k), F.lit(0.0)) + F.col("turns") * F.col(f"all_{k}")).alias(k) for k in held])


def finite(*values: str):
    out = F.lit(True)
    for v in values:
        out = out & F.col(v).isNotNull() & ~F.isnan(v)
    return out


def sharpe(value: str, periods: int = 12):
    return F.try_divide(F.avg(value), F.stddev_pop(value)) * F.sqrt(F.lit(float(periods)))


def sharpe_of(value: str, n: int, periods: int = 12):
    """The same from a replicate's sums."""
    mean = F.col(f"s_{value}") / n
    left = F.col(f"ss_{value}") / n - mean * mean
    return F.when(left > 1e-14 * F.col(f"ss_{value}") / n, mean / F.sqrt(left) * math.sqrt(periods))


def sharpe_ci(values: DataFrame, value: str, order: str, n_boot: int = 5000, alpha: float = 0.05, block: float = 1.0, seed: int = 0) -> DataFrame:
    """lo, point, hi, n, expected_block in one row; none under 12 values."""
    rows = kept(numbered(values.where(finite(value)), order, keys=(), out="k"))
    point = rows.agg(sharpe(value).alias("point"), F.count(F.lit(1)).alias("n")).where("n >= 12")
    n = rows.count()
    reps = replicates(rows, (value,), n, n_boot, block, seed).select(sharpe_of(value, n).alias("s")) if n else rows.select(F.lit(None).cast("double").alias("s"))
    edges = reps.agg(F.percentile("s", F.lit(alpha / 2)).alias("lo"), F.percentile("s", F.lit(1 - alpha / 2)).alias("hi"))
    return point.crossJoin(edges).select("lo", "point", "hi", "n", F.lit(float(block)).alias("expected_block"))


def paired_diff_ci(values: DataFrame, a: str, b: str, order: str, n_boot: int = 5000, alpha: float = 0.05, block: float = 1.0, seed: int = 0) -> DataFrame:
    """Of the Sharpe of a less that of b, both drawn by the same runs; adds p_gt_0. Two one-row tables meet at the end."""
    rows = kept(numbered(values.where(finite(a, b)), order, keys=(), out="k"))
    point = rows.agg((sharpe(a) - sharpe(b)).alias("point"), F.count(F.lit(1)).alias("n")).where("n >= 12")
    n = rows.count()
    reps = replicates(rows, (a, b), n, n_boot, block, seed).select((sharpe_of(a, n) - sharpe_of(b, n)).alias("s")) if n else rows.select(F.lit(None).cast("double").alias("s"))
    edges = reps.agg(F.percentile("s", F.lit(alpha / 2)).alias("lo"), F.percentile("s", F.lit(1 - alpha / 2)).alias("hi"), F.avg((F.col("s") > 0).cast("double")).alias("p_gt_0"))
    return point.crossJoin(edges).select("lo", "point", "hi", "n", "p_gt_0", F.lit(float(block)).alias("expected_block"))
