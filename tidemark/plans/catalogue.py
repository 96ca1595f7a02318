"""All queries on the panel operators, with the SQL that says what each should return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import fracdiff, fractal, spectral, synthetic
from tidemark.operators import audit, execution, forest, frames, inference, model
from tidemark.operators import backtest as bt
from tidemark.plans.oracle import normal_sql, pick, scales_sql, sql
from tidemark.sources import cache, markup, panels
from tidemark.sources.kept import kept, shared_folder
from tidemark.streaming import bars as stream

FLAGSHIP = "momentum_sort_backtest"
#: Draws of a bootstrap; the SQL makes as many.
DRAWS = 5000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def broad_class():
    return F.concat(F.lit("class"), (F.substring("ticker", 7, 9).try_cast("int") % 5).cast("string"))


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, floats rounded to six places without a negative zero."""
    def one(name: str, kind: str):
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("long").alias(name)
        return (F.round(name, 6) + 0.0).alias(name) if kind == "double" else F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def bars(s: SparkSession, d: str) -> DataFrame:
    """The daily bars: the only scan of the fact table, whatever a query makes of them."""
    return kept(panels.brand_bars(s, d))


def index(s: SparkSession, d: str) -> DataFrame:
    return panels.index_panel(bars(s, d))


def feats(s: SparkSession, d: str) -> DataFrame:
    return kept(frames.features(index(s, d)))


def with_fd_z(feats: DataFrame) -> DataFrame:
    """Weights and z-score together need over 1,700 rows of a ticker, more than the least of 500 that published practice asks for."""
    return frames.zscored(fracdiff.ffd(feats.withColumnRenamed("lp", "x"), tau=1e-5), "y", "fd_z")


def panel_of(feats: DataFrame) -> DataFrame:
    return with_fd_z(feats).na.drop(subset=[*model.FEATURES, "target"])


def ml_panel(s: SparkSession, d: str) -> DataFrame:
    return kept(panel_of(feats(s, d)))


def momentum(s: SparkSession, d: str) -> bt.Backtest:
    x = feats(s, d)
    return bt.sort_backtest(x.select("ticker", "date", F.col("mom_12_1").alias("factor")), x)


def hurst_panel(s: SparkSession, d: str) -> DataFrame:
    """ticker, i, date, h, vol, cls."""
    return with_hurst(feats(s, d))


def with_hurst(x: DataFrame) -> DataFrame:
    h = fractal.rolling_dfa(x.select("ticker", "i", "r"), 500, 21)
    return h.join(x.select("ticker", "i", "date", F.col("vol_252").alias("vol")), ["ticker", "i"]).withColumn("cls", broad_class())


def returns_series(s: SparkSession, d: str) -> DataFrame:
    return kept(fractal.series(frames.with_returns(index(s, d))))


# Sources


@query(pick("px", "ticker date", "close volume"))
def daily_bars(s, d):
    return panels.brand_bars(s, d)


def _place(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query(sql("SELECT ticker, date, round(volume, 6) AS close FROM px WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'"))
def bars_sink(s, d):
    """Bars written by year, and a field of some days read back: other years' files are not opened."""
    to = _place(s, "bars")
    panels.save_bars(panels.brand_bars(s, d), to)
    return panels.load_prices(s, to, "1996-03-01", "1997-02-28", field="volume")


@query(pick("mom_bt", "seq date", "ls_r turnover"))
def csv_sink(s, d):
    """A backtest's series as CSV with a header, and read back."""
    to = _place(s, "csv")
    panels.save_csv(momentum(s, d).returns.select("seq", "date", "ls_r", "turnover"), to)
    return panels.read_csv(s, to, "seq long, date date, ls_r double, turnover double")


@query("SELECT event_type AS ticker, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::BIGINT AS hour, count(*) AS n, min((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS first FROM events GROUP BY 1, 2")
def zone_strip(s, d):
    """Events by the hour of a zone's wall clock."""
    x = panels.table(s, d, "events").select(F.col("event_type").alias("ticker"), panels.local_time("ts", "America/New_York").alias("t"))
    return x.groupBy("ticker", F.hour("t").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))


@query(pick("nat", "ticker asset_class date", "close volume"))
def daily_bars_classed(s, d):
    return panels.nation_bars(s, d)


@query(pick("dense", "ticker date", "close"))
def dense_panel(s, d):
    return panels.dense(bars(s, d))


@query(pick("ret", "ticker date", "lp r"))
def log_returns(s, d):
    return frames.with_returns(index(s, d)).select("ticker", "date", "lp", "r")


@query(sql("SELECT ticker, date, round(close, 6) + 0.0::DOUBLE AS close FROM px WHERE ticker IN (SELECT ticker FROM px GROUP BY ticker HAVING count(close) >= CAST(floor((SELECT count(DISTINCT date) FROM px) * 0.6::DOUBLE) AS BIGINT))"))
def coverage_filter(s, d):
    return frames.covered(bars(s, d).select("ticker", "date", "close"), 0.6)


@query("SELECT page_id, CAST(n - 1 AS BIGINT) AS n, field FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a(?: [^<>]*)?>([^<>]*)</a>', 1)) AS f0, generate_subscripts(regexp_extract_all(html, '<a(?: [^<>]*)?>([^<>]*)</a>', 1), 1) AS n, translate(trim(f0), '.', '-') AS field FROM pages)")
def html_table_extract(s, d):
    return panels.html_fields(panels.table(s, d, "pages"), "a")


_LOADS = (("close", "1995-01-01", "1995-06-30"), ("volume", "1995-01-01", "1995-06-30"), ("close", "1994-10-01", "1995-12-31"), ("close", "1995-02-01", "1995-03-01"))
_WANTED = [("close", "1995-01-01", "1995-06-30"), ("volume", "1995-01-01", "1995-06-30"), ("close", "1994-10-01", "1994-12-31"), ("close", "1995-07-01", "1995-12-31")]


def _loaded(s, d):
    """The requests of _LOADS, one after the other, through a cache that begins empty: the rows of each, and the gaps that it read."""
    root, all_bars = f"{shared_folder(s)}/cache-{uuid.uuid4().hex}", bars(s, d)
    return [cache.load(s, root, cache.requests(s, all_bars, *asked), cache.from_bars(all_bars)) for asked in _LOADS]


@query(sql("SELECT ticker, date, round(close, 6) + 0.0::DOUBLE AS close FROM px WHERE date BETWEEN DATE '1994-10-01' AND DATE '1995-12-31'"))
def price_cache(s, d):
    """A request that what is held covers in part."""
    return _loaded(s, d)[2][0].select("ticker", "date", F.col("value").alias("close"))


@query(sql("SELECT field, start, CAST(last AS DATE) AS last, count(*) AS tickers FROM (SELECT DISTINCT ticker FROM px), (VALUES " + ", ".join(f"('{f}', DATE '{a}', DATE '{b}')" for f, a, b in _WANTED) + ") v(field, start, last) GROUP BY ALL"))
def price_cache_reads(s, d):
    """What was asked of the source in all: no day of a field twice."""
    read = [gaps for _, gaps in _loaded(s, d)]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3]).groupBy("field", "start", F.col("end").alias("last")).agg(F.count(F.lit(1)).alias("tickers"))


def _directory(s, d):
    """page_id, html: each 200 customers as a web page of two tables; a segment is one cell beside all its customers."""
    x = panels.table(s, d, "customer").select(F.expr("c_custkey div 200").alias("page_id"), "c_mktsegment", "c_name")
    lines = x.groupBy("page_id", "c_mktsegment").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    cells = F.transform("names", lambda name, k: F.concat(F.lit("<tr>"), F.when(k == 0, F.concat(F.lit("<td rowspan='"), F.size("names").cast("string"), F.lit("'>"), F.col("c_mktsegment"), F.lit("</td>"))).otherwise(F.lit("")), F.lit("<td><a href='#'>"), name, F.lit("</a>.&amp;</td></tr>\n")))
    dealt = lines.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "page_id")  # by number: pages are small and much work, and by their bytes would be one task
    made = dealt.select("page_id", F.struct("c_mktsegment", F.array_join(cells, "").alias("rows")).alias("part")).groupBy("page_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return made.select("page_id", F.concat(F.lit("<h1>x</h1><table><tr><td>no head</td></tr></table><TABLE class=t><tr><th>Sector</th><th>Symbol</th></tr>"), F.array_join(F.transform("parts", lambda p: p["rows"]), ""), F.lit("</TABLE>")).alias("html"))


@query("SELECT c_custkey // 200 AS page_id, 1::BIGINT AS n, row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_mktsegment, c_name) AS row, c_name || '-&' AS value, c_mktsegment AS sector FROM customer")
def html_table_column(s, d):
    """Two columns of a table by the names over them."""
    cells = kept(markup.tables(_directory(s, d)))
    sector = markup.column(cells, "Sector").withColumnRenamed("value", "sector")
    return markup.column(cells, "Symbol").join(sector, ["page_id", "n", "row"])


@query("SELECT DISTINCT c_mktsegment AS member FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT p_brand FROM part")
def universe_union(s, d):
    parts = [panels.table(s, d, t).select(F.col(c).alias("member")) for t, c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("part", "p_brand"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS asset_class FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def universe_lookup_default(s, d):
    classes = panels.table(s, d, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return panels.table(s, d, "customer").join(classes, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("asset_class"))


@query("SELECT DISTINCT p_type AS fine, CASE WHEN p_type LIKE 'STANDARD%' THEN 'STANDARD' WHEN p_type LIKE 'SMALL %' THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) ELSE split_part(p_type, ' ', 1) END AS broad FROM part")
def class_map_broad(s, d):
    words = F.split("p_type", " ")
    two = F.concat_ws(" ", F.get(words, 0), F.coalesce(F.get(words, 1), F.lit("")))
    broad = F.when(F.col("p_type").startswith("STANDARD"), "STANDARD").when(F.col("p_type").startswith("SMALL "), two).otherwise(F.get(words, 0))
    return panels.table(s, d, "part").select(F.col("p_type").alias("fine"), broad.alias("broad")).distinct()


# Windows


@query(pick("featz", "ticker date", "mom_12_1 ret_1m vol_60 vol_252 fd_z target fwd_vol_21"))
def feature_panel(s, d):
    return with_fd_z(feats(s, d)).select("ticker", "date", "mom_12_1", "ret_1m", "vol_60", "vol_252", "fd_z", "target", "fwd_vol_21")


@query(pick("panel", "ticker date", "mom_12_1 ret_1m vol_60 vol_252 fd_z target"))
def ml_panel_rows(s, d):
    return panel_of(feats(s, d)).select("ticker", "date", *model.FEATURES, "target")


@query(pick("zsc", "ticker date", "z", "z IS NOT NULL"))
def rolling_zscore(s, d):
    return frames.zscored(feats(s, d), "ret_1m", "z").where("z is not null").select("ticker", "date", "z")


@query(sql("SELECT ticker, date, round(CASE WHEN mom_12_1 IS NOT NULL THEN 0.5::DOUBLE * coalesce(z, 0) + 0.5::DOUBLE * mom_12_1 END, 6) + 0.0::DOUBLE AS blend FROM zsc"))
def blend_factor(s, d):
    x = frames.zscored(feats(s, d), "ret_1m", "z")
    return x.select("ticker", "date", (0.5 * F.coalesce("z", F.lit(0.0)) + 0.5 * F.col("mom_12_1")).alias("blend"))


_GAPPY = "(SELECT g.ticker, g.date, p.close FROM grid g LEFT JOIN px p ON p.ticker = g.ticker AND p.date = g.date)"


@query(sql(f"SELECT ticker, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date), 6) AS before, round(first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS after FROM {_GAPPY}"))
def asof_fills(s, d):
    """Each brand on every day, with the gaps that it really has."""
    return frames.filled(panels.grid(bars(s, d)), "close", "before", "after").select("ticker", "date", "before", "after")


# Backtests


@query(pick("mom_m", "ticker date", "factor"))
def month_end_factor(s, d):
    return bt.month_factor(feats(s, d).select("ticker", "date", F.col("mom_12_1").alias("factor")))


@query(pick("mret", "ticker date", "r"))
def monthly_returns(s, d):
    return bt.month_returns(feats(s, d))


@query(pick("mom_sig", "ticker date", "r factor"))
def month_grid_shift(s, d):
    x = feats(s, d)
    return bt.signals(x.select("ticker", "date", F.col("mom_12_1").alias("factor")), x).select("ticker", "date", "r", "factor")


@query(pick("mom_legs", "date ticker leg", "weight"))
def holdings(s, d):
    return momentum(s, d).legs


@query(pick("mom_bt", "seq date", "long_r short_r ls_r traded turnover net_r"))
def momentum_sort_backtest(s, d):
    return bt.net_returns(momentum(s, d).returns)


@query(sql("SELECT seq, round(ls_r - coalesce(turnover * 4, 0) * 10 / 1e4, 6) + 0.0::DOUBLE AS net_r FROM mom_bt"))
def legacy_cost_path(s, d):
    return bt.net_returns(momentum(s, d).returns.withColumn("traded", F.lit(None).cast("double"))).select("seq", "net_r")


def _stats_sql(v, cost):
    return sql(f"SELECT round(avg({v}) * 12, 6) AS ann_return, round(stddev_samp({v}) * sqrt(12), 6) AS ann_vol, round(avg({v}) * 12 / (stddev_samp({v}) * sqrt(12)), 6) AS sharpe, round(min(dd), 6) + 0.0::DOUBLE AS max_drawdown, round(avg(CAST({v} > 0 AS DOUBLE)), 6) AS hit_rate, count(*) AS n_periods, round(avg(turnover), 6) AS turnover, {cost}::DOUBLE AS cost_bps_per_side FROM (SELECT *, eq / max(eq) OVER (ORDER BY seq) - 1 AS dd FROM (SELECT *, product(1 + {v}) OVER (ORDER BY seq) AS eq FROM mom_bt)) HAVING count(*) >= 2")


@query(_stats_sql("ls_r", 0))
def bt_stats_gross(s, d):
    return bt.stats(momentum(s, d).returns)


@query(_stats_sql("net_r", 10))
def bt_stats_net(s, d):
    return bt.stats(bt.net_returns(momentum(s, d).returns), "net_r", 10.0)


@query(pick("mom_eq", "seq date", "equity drawdown"))
def equity_curve(s, d):
    return bt.equity(momentum(s, d).returns)


def _line_sql(k, name, v):
    return f"SELECT {k}::BIGINT AS seq, coalesce(max(printf('{name}: return %+.2f%% vol %.2f%% sharpe %.2f drawdown %.2f%% months %d', 1200 * m, 100 * sqrt(12) * s, coalesce(m * 12 / nullif(s * sqrt(12), 0), 0), 100 * d, n)), '{name}: no returns') AS line FROM (SELECT avg({v}) AS m, stddev_samp({v}) AS s, min(dd) AS d, count(*) AS n FROM (SELECT *, eq / max(eq) OVER (ORDER BY seq) - 1 AS dd FROM (SELECT *, product(1 + {v}) OVER (ORDER BY seq) AS eq FROM mom_bt)) HAVING count(*) >= 2)"


@query(sql(_line_sql(0, "gross", "ls_r") + " UNION ALL " + _line_sql(1, "net", "net_r")))
def bt_report(s, d):
    """The report's lines of text."""
    return bt.report_lines(momentum(s, d))


@query(sql("SELECT leg, ticker AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY leg), 6) AS share FROM mom_legs GROUP BY leg, ticker"))
def composition_ticker(s, d):
    return bt.composition(momentum(s, d).legs, "ticker")


@query(sql("SELECT leg, 'class' || (TRY_CAST(substr(ticker, 7) AS INT) % 5) AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY leg), 6) AS share FROM mom_legs GROUP BY leg, key"))
def composition_class(s, d):
    return bt.composition(momentum(s, d).legs, broad_class())


@query(sql("SELECT leg, ticker, n FROM (SELECT leg, ticker, count(*) AS n, row_number() OVER (PARTITION BY leg ORDER BY count(*) DESC, ticker) AS rk FROM mom_legs GROUP BY leg, ticker) WHERE rk <= 3"))
def leg_top_members(s, d):
    counted = momentum(s, d).legs.groupBy("leg", "ticker").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rk", F.row_number().over(W.partitionBy("leg").orderBy(F.desc("n"), "ticker"))).where("rk <= 3").drop("rk")


@query(sql("SELECT metric, round(value, 6) + 0.0::DOUBLE AS value FROM (UNPIVOT (SELECT avg(ls_r) AS mean_gross, avg(net_r) AS mean_net, avg(turnover) AS turnover FROM mom_bt) ON mean_gross, mean_net, turnover INTO NAME metric VALUE value)"))
def stats_unpivot(s, d):
    x = bt.net_returns(momentum(s, d).returns).agg(F.avg("ls_r").alias("mean_gross"), F.avg("net_r").alias("mean_net"), F.avg("turnover").alias("turnover"))
    return x.unpivot([], ["mean_gross", "mean_net", "turnover"], "metric", "value")


_BRANDS = [f"Brand#{k}" for k in range(1, 26)]


@query(sql("SELECT date, " + ", ".join(f"max(round(r, 6) + 0.0::DOUBLE) FILTER (WHERE ticker = '{b}') AS \"{b}\"" for b in _BRANDS) + " FROM mret GROUP BY date"))
def panel_pivot(s, d):
    """All tickers as columns."""
    return kept(bt.month_returns(feats(s, d))).groupBy("date").pivot("ticker").agg(F.max("r"))


@query(pick("hurst_bt", "seq date", "long_r short_r ls_r traded turnover net_r"))
def hurst_sort_backtest(s, d):
    x = feats(s, d)
    return bt.net_returns(bt.sort_backtest(with_hurst(x).select("ticker", "date", F.col("h").alias("factor")), x).returns)


@query(pick("res", "date ticker cls", "h vol residual"))
def residualize_fwl(s, d):
    return bt.residualize(hurst_panel(s, d))


@query(sql("SELECT date, count(*) AS n, count(DISTINCT cls) + 1 AS n_params, round(1 - sum(residual * residual) / nullif(var_pop(h) * count(*), 0), 6) + 0.0::DOUBLE AS r2 FROM res GROUP BY date"))
def r2_class_vol(s, d):
    x = bt.residualize(hurst_panel(s, d)).groupBy("date")
    return x.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("cls") + 1).alias("n_params"), (1 - F.try_divide(F.sum(F.col("residual") * F.col("residual")), F.var_pop("h") * F.count(F.lit(1)))).alias("r2"))


@query(sql("SELECT round(avg(r2), 6) + 0.0::DOUBLE AS r2, count(*) AS n FROM (SELECT date, 1 - sum(residual * residual) / nullif(var_pop(h) * count(*), 0) AS r2 FROM res GROUP BY date ORDER BY date DESC LIMIT 20)"))
def r2_last_rebalances(s, d):
    """Mean R2 of class and volatility over the last 20 rebalances."""
    return r2_class_vol(s, d).orderBy(F.desc("date")).limit(20).agg(F.avg("r2").alias("r2"), F.count(F.lit(1)).alias("n"))


@query(pick("res_bt", "seq date", "long_r short_r ls_r traded turnover net_r"))
def residual_sort_backtest(s, d):
    x = feats(s, d)
    residual = bt.residualize(with_hurst(x)).select("ticker", "date", F.col("residual").alias("factor"))
    return bt.net_returns(bt.sort_backtest(residual, x).returns)


# Estimators


@query(pick("dfa", "ticker", "h"))
def hurst_dfa_full(s, d):
    return fractal.dfa(returns_series(s, d))


@query(pick("roll", "ticker i", "h"))
def hurst_dfa_rolling(s, d):
    return hurst_panel(s, d).select("ticker", "i", "h")


@query(sql("SELECT round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(quantile_cont(h, 0.05), 6) AS p05, round(quantile_cont(h, 0.95), 6) AS p95, round(max(h) - min(h), 6) AS range, count(*) AS n, count(*) FILTER (WHERE abs(h - 0.5) > 0.05) AS far FROM dfa"))
def hurst_distribution(s, d):
    x = fractal.dfa(returns_series(s, d))
    return x.agg(F.avg("h").alias("mean"), F.stddev_samp("h").alias("std"), F.percentile("h", F.lit(0.05)).alias("p05"), F.percentile("h", F.lit(0.95)).alias("p95"), (F.max("h") - F.min("h")).alias("range"), F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("h") - 0.5) > 0.05).alias("far"))


@query(sql("SELECT ticker, round(h, 6) AS h FROM dfa ORDER BY h DESC, ticker LIMIT 5"))
def hurst_topk(s, d):
    return fractal.dfa(returns_series(s, d)).orderBy(F.desc("h"), "ticker").limit(5)


def _dfa_sql(source):
    """SQL for ticker, h of a source with ticker, i, n, x."""
    return f"(WITH src AS {source}, scl AS ({scales_sql('src', 10, 20, 1)}) SELECT ticker, regr_slope(ln(f), ln(s)) AS h FROM (SELECT ticker, s, sqrt(avg(mse)) AS f FROM (SELECT ticker, s, i // s AS w, greatest(regr_syy(y, i) - regr_sxy(y, i) ** 2 / regr_sxx(y, i), 0) / s AS mse FROM (SELECT ticker, i, n, sum(x) OVER (PARTITION BY ticker ORDER BY i) AS y FROM src) JOIN scl USING (ticker, n) WHERE i < s * (n // s) GROUP BY ticker, s, i // s) GROUP BY ticker, s) WHERE f > 0 GROUP BY ticker HAVING count(*) >= 4)"


@query(pick("dfa2", "ticker", "h"))
def hurst_dfa_quadratic(s, d):
    """Windows detrended by parabolas."""
    return fractal.dfa(returns_series(s, d), order=2)


@query(sql("SELECT 'class' || (TRY_CAST(substr(ticker, 7) AS INT) % 5) AS cls, count(*) AS n, round(avg(h), 6) AS h_mean, round(stddev_samp(h), 6) AS h_std FROM dfa GROUP BY cls"))
def hurst_class_summary(s, d):
    x = fractal.dfa(returns_series(s, d)).groupBy(broad_class().alias("cls"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("h_mean"), F.stddev_samp("h").alias("h_std"))


@query(sql("SELECT ticker, round(CASE WHEN count(r) >= 20 THEN stddev_pop(r) * sqrt(252) END, 6) AS ann_vol FROM ret GROUP BY ticker"))
def annual_vol(s, d):
    return frames.with_returns(index(s, d)).groupBy("ticker").agg(fractal.annual_vol("r").alias("ann_vol"))


@query(sql("SELECT ticker, i, round(value, 6) AS value FROM (SELECT ticker, i, stddev_pop(r) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS value FROM ret) WHERE i >= 500 AND (i - 500) % 21 = 0"))
def rolling_factor(s, d):
    """Any function of a window's returns as a factor; here their standard deviation."""
    return fractal.rolling_apply(frames.with_returns(index(s, d)), lambda x: x.std(), 500)


def _rs_sql(nw):
    return sql(f"SELECT ticker, n, q, round(rs / sqrt(n), 6) AS v, rs / sqrt(n) > 1.862 OR rs / sqrt(n) < 0.809 AS rejects_null_95, round(ln(rs) / ln(n), 6) AS h_implied FROM (SELECT ticker, n, CAST(q AS BIGINT) AS q, rng / s AS rs FROM (SELECT ticker, n, max(y) - min(y) AS rng FROM prof GROUP BY ALL) JOIN {nw} USING (ticker))")


@query(_rs_sql("nw"))
def lo_rs_modified(s, d):
    return fractal.modified_rs(returns_series(s, d))


@query(_rs_sql("nw0"))
def lo_rs_classic(s, d):
    return fractal.modified_rs(returns_series(s, d), 0)


@query(pick("bandq", "ticker n q", "rho"))
def andrews_bandwidth(s, d):
    return fractal.bandwidth(fractal.profile(returns_series(s, d), 100))


@query(pick("nw", "ticker q", "s"))
def newey_west(s, d):
    x = fractal.profile(returns_series(s, d), 100)
    return fractal.long_run_std(x, fractal.bandwidth(x))


@query(pick("mf_h", "ticker q", "h"))
def mfdfa_spectrum(s, d):
    return fractal.spectrum(fractal.mfdfa(returns_series(s, d)))


@query(sql("SELECT ticker, round(max(h) - min(h), 6) + 0.0::DOUBLE AS delta_h FROM mf_h GROUP BY ticker"))
def mfdfa_delta_h(s, d):
    return fractal.delta_h(fractal.spectrum(fractal.mfdfa(returns_series(s, d))))


@query(sql("SELECT split_part(ticker, '|', 1) AS ticker, CAST(split_part(ticker, '|', 2) AS BIGINT) AS i, round(delta_h, 6) + 0.0::DOUBLE AS delta_h, round(h2, 6) AS h2 FROM rmf"))
def rolling_mfdfa(s, d):
    return fractal.rolling_mfdfa(feats(s, d))


def _gates(s, d):
    """date, delta_h, fwd of the first ticker: the width of the spectrum over the rows up to a day, and the return of the 21 rows after it."""
    x = feats(s, d)
    least = x.agg(F.min("ticker").alias("__t"))
    one = kept(x.join(F.broadcast(least), F.col("ticker") == F.col("__t"), "left_semi"))
    widths = fractal.rolling_mfdfa(one).select("ticker", (F.col("i") - 1).alias("i"), "delta_h")
    return kept(one.join(widths, ["ticker", "i"]).where("delta_h is not null and target is not null").select("date", "delta_h", F.col("target").alias("fwd")))


@query(pick("causal", "date", "delta_h fwd threshold gated"))
def regime_gate_causal(s, d):
    return audit.gate(_gates(s, d))


@query(pick("leaky", "date", "delta_h fwd threshold gated"))
def regime_gate_leaky(s, d):
    return audit.gate(_gates(s, d), causal=False)


@query(sql("SELECT round(corr(delta_h, fwd), 6) + 0.0::DOUBLE AS corr_fwd, round(corr(delta_h, abs(fwd)), 6) + 0.0::DOUBLE AS corr_abs, count(*) AS n FROM gates"))
def gate_correlations(s, d):
    return _gates(s, d).agg(F.corr("delta_h", "fwd").alias("corr_fwd"), F.corr("delta_h", F.abs("fwd")).alias("corr_abs"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT a.date, round(a.close, 2) AS lines, round(b.close, 2) AS orders FROM lines_d a JOIN orders_d b USING (date)"))
def calendar_intersection(s, d):
    a, b = panels.daily_totals(s, d)
    return a.join(b.withColumnRenamed("close", "o"), "date").select("date", F.round("close", 2).alias("lines"), F.round("o", 2).alias("orders"))


@query(sql("SELECT date, round(a.close, 2) AS lines, round(b.close, 2) AS orders FROM lines_d a FULL JOIN orders_d b USING (date)"))
def series_alignment(s, d):
    lines, orders = panels.daily_totals(s, d)
    return frames.align("date", "close", lines=lines, orders=orders).select("date", F.round("lines", 2).alias("lines"), F.round("orders", 2).alias("orders"))


_FFD = "WITH RECURSIVE wt AS (SELECT 0::BIGINT AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4::DOUBLE - (k + 1) + 1) / (k + 1) FROM wt WHERE abs(-w * (0.4::DOUBLE - (k + 1) + 1) / (k + 1)) >= 1e-3)"


@query(_FFD + " SELECT k, round(w, 6) AS w FROM wt")
def ffd_weights(s, d):
    return fracdiff.weight_table(s, 0.4, 1e-3)


_FFD_Y = sql("SELECT ticker, date, round(y, 6) + 0.0::DOUBLE AS y FROM ffd_all WHERE y IS NOT NULL")
_FFD_Z = sql("SELECT ticker, date, round(fd_z, 6) + 0.0::DOUBLE AS z FROM ffd_z WHERE fd_z IS NOT NULL")


@query(_FFD_Y)
def ffd_series(s, d):
    """With all weights down to 1e-5."""
    x = frames.with_returns(index(s, d)).withColumnRenamed("lp", "x")
    return fracdiff.ffd(x).where("y is not null").select("ticker", "date", "y")


@query(_FFD_Z)
def ffd_zscore(s, d):
    x = frames.with_returns(index(s, d)).withColumnRenamed("lp", "x")
    return frames.zscored(fracdiff.ffd(x), "y", "z").where("z is not null").select("ticker", "date", "z")


QUERIES["ffd_series_whole"], ORACLE["ffd_series_whole"] = QUERIES["ffd_series"], _FFD_Y
QUERIES["ffd_zscore_whole"], ORACLE["ffd_zscore_whole"] = QUERIES["ffd_zscore"], _FFD_Z


@query()
def adf_by_order(s, d):
    """The test behind the least order: lags by AIC, t and p-value of each ticker and d."""
    return fracdiff.adf(frames.with_returns(index(s, d)).select("ticker", "i", F.col("lp").alias("x")))


@query()
def min_d_adf(s, d):
    return fracdiff.min_d(frames.with_returns(index(s, d)).select("ticker", "i", F.col("lp").alias("x")))


# Intraday


@query(pick("hb", "ticker ts", "open high low close volume"))
def hourly_bars(s, d):
    return panels.hourly_bars(s, d)


@query(pick("shape", "ticker hour n", "abs_ret volume abs_ret_shape volume_shape"))
def hour_seasonality(s, d):
    return execution.seasonality(panels.hourly_bars(s, d))


@query(sql("SELECT hour, round(avg(abs_ret_shape), 6) AS abs_ret, round(avg(volume_shape), 6) AS volume, count(DISTINCT ticker) AS n FROM shape GROUP BY hour"))
def hour_seasonality_agg(s, d):
    return execution.seasonality(panels.hourly_bars(s, d)).groupBy("hour").agg(F.avg("abs_ret_shape").alias("abs_ret"), F.avg("volume_shape").alias("volume"), F.count_distinct("ticker").alias("n"))


@query(sql("SELECT hour, round(v, 6) AS volume FROM (SELECT hour, avg(volume_shape) AS v FROM shape GROUP BY hour) ORDER BY round(v, 9) DESC, hour LIMIT 3"))
def top_hours(s, d):
    x = execution.seasonality(panels.hourly_bars(s, d)).groupBy("hour").agg(F.avg("volume_shape").alias("volume"))
    return x.orderBy(F.desc(F.round("volume", 9)), "hour").limit(3)


@query(pick("vprof", "ticker hour", "share"))
def volume_profile(s, d):
    return execution.volume_profile(execution.halves(panels.hourly_bars(s, d)).where("half = 0"))


@query(pick("vwap", "ticker date n", "vwap"))
def day_vwap(s, d):
    return execution.day_vwap(panels.hourly_bars(s, d))


@query(pick("cost", "ticker date", "uniform vwap_profile avoid_open front_load end_load"))
def exec_shortfall(s, d):
    return execution.shortfall(panels.hourly_bars(s, d))


@query(sql("SELECT schedule, round(avg(bps), 6) + 0.0::DOUBLE AS mean, round(quantile_cont(bps, 0.5), 6) + 0.0::DOUBLE AS median, round(stddev_samp(bps), 6) AS std, round(quantile_cont(bps, 0.1), 6) AS p10, round(quantile_cont(bps, 0.9), 6) AS p90, count(bps) AS n FROM costl GROUP BY schedule"))
def exec_summary(s, d):
    return execution.summary(execution.shortfall(panels.hourly_bars(s, d)))


@query(sql("SELECT schedule, round(avg(x), 6) + 0.0::DOUBLE AS mean_diff, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) + 0.0::DOUBLE AS t, count(x) AS n FROM (SELECT l.schedule, c.uniform - l.bps AS x FROM costl l JOIN cost c USING (ticker, date) WHERE l.schedule <> 'uniform') GROUP BY schedule"))
def exec_paired_t(s, d):
    return execution.paired_t(execution.shortfall(panels.hourly_bars(s, d)))


@query(sql("SELECT ticker, round(avg(uniform - vwap_profile), 6) + 0.0::DOUBLE AS saved FROM cost GROUP BY ticker ORDER BY avg(uniform - vwap_profile) DESC, ticker LIMIT 3"))
def exec_per_ticker_topk(s, d):
    x = execution.shortfall(panels.hourly_bars(s, d)).groupBy("ticker").agg(F.avg(F.col("uniform") - F.col("vwap_profile")).alias("saved"))
    return x.orderBy(F.desc("saved"), "ticker").limit(3)


@query(pick("psd", "ticker", "freq psd"))
def welch_psd(s, d):
    return spectral.psd(fractal.series(frames.with_returns(panels.hourly_bars(s, d), "ts")))


@query(sql("SELECT round(freq, 6) + 0.0::DOUBLE AS freq, round(avg(psd), 6) + 0.0::DOUBLE AS psd, count(*) AS n FROM psd GROUP BY freq"))
def mean_psd(s, d):
    return welch_psd(s, d).groupBy("freq").agg(F.avg("psd").alias("psd"), F.count(F.lit(1)).alias("n"))


_STREAM = "SELECT event_type AS ticker, time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS volume, round(max(value), 6) AS high, round(min(value), 6) AS low FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


@query(_STREAM)
def stream_hourly_bars(s, d):
    return stream.replay(s, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Inference


def _ci_sql(t, v, block):
    return sql(f"SELECT round((SELECT quantile_cont({v}, 0.025) FROM {t}_s), 6) + 0.0::DOUBLE AS lo, round(sqrt(12) * avg(net_r) / stddev_pop(net_r), 6) + 0.0::DOUBLE AS point, round((SELECT quantile_cont({v}, 0.975) FROM {t}_s), 6) + 0.0::DOUBLE AS hi, count(*) AS n, {block}::DOUBLE AS expected_block FROM bs HAVING count(*) >= 12")


@query(_ci_sql("bt1", "s", 1))
def boot_iid_sharpe(s, d):
    return inference.sharpe_ci(bt.net_returns(momentum(s, d).returns), "net_r", "seq", DRAWS)


@query(_ci_sql("bt3", "s", 3))
def boot_block_sharpe(s, d):
    return inference.sharpe_ci(bt.net_returns(momentum(s, d).returns), "net_r", "seq", DRAWS, block=3.0)


@query(sql("SELECT round((SELECT quantile_cont(g - s, 0.025) FROM bt3_s), 6) + 0.0::DOUBLE AS lo, round(sqrt(12) * (avg(ls_r) / stddev_pop(ls_r) - avg(net_r) / stddev_pop(net_r)), 6) + 0.0::DOUBLE AS point, round((SELECT quantile_cont(g - s, 0.975) FROM bt3_s), 6) + 0.0::DOUBLE AS hi, count(*) AS n, round((SELECT avg(CAST(g - s > 0 AS DOUBLE)) FROM bt3_s), 6) AS p_gt_0, 3::DOUBLE AS expected_block FROM bs HAVING count(*) >= 12"))
def boot_paired_diff(s, d):
    return inference.paired_diff_ci(bt.net_returns(momentum(s, d).returns), "ls_r", "net_r", "seq", DRAWS, block=3.0)


# Audits


def _rebalances(s, d):
    return hurst_panel(s, d).withColumn("idx", F.expr("(i - 500) div 21")).select("idx", "ticker", "h")


@query(sql("SELECT lag, lag * 21::BIGINT AS lag_days, round(greatest(0, 1 - lag * 21 / 500.0::DOUBLE), 6) AS window_overlap, round(avg(rho), 6) + 0.0::DOUBLE AS rho, count(rho) AS pairs FROM (SELECT lag, idx, corr(ra, rb) AS rho FROM (SELECT lag, idx, rank() OVER (PARTITION BY lag, idx ORDER BY a) + (count(*) OVER (PARTITION BY lag, idx, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY lag, idx ORDER BY b) + (count(*) OVER (PARTITION BY lag, idx, b) - 1) / 2.0::DOUBLE AS rb FROM (SELECT v.lag, (x.i - 500) // 21 AS idx, x.h AS a, y.h AS b FROM roll x, (VALUES (1), (6), (12), (24), (36), (48)) v(lag), roll y WHERE y.ticker = x.ticker AND y.i = x.i + 21 * v.lag)) GROUP BY ALL HAVING count(*) > 20) GROUP BY lag"))
def rank_persistence(s, d):
    """From a lag of 24 on the two windows share no day."""
    x = audit.rank_persistence(_rebalances(s, d), (1, 6, 12, 24, 36, 48))
    return x.select("lag", (F.col("lag") * F.lit(21).cast("long")).alias("lag_days"), F.greatest(F.lit(0.0), 1 - F.col("lag") * 21 / 500.0).alias("window_overlap"), "rho", "pairs")


@query(sql("SELECT round(avg(s), 6) AS mean_std, count(s) AS n FROM (SELECT i, stddev_samp(h) AS s FROM roll GROUP BY i)"))
def xs_dispersion(s, d):
    return audit.dispersion(_rebalances(s, d))


#: DFA of white noise as long as a rolling window, 200 series: what the estimator makes of nothing.
FLOOR_SERIES = 200
_NOISE = "(SELECT id // 500 AS ticker, id % 500 AS i, 500 AS n, e - avg(e) OVER (PARTITION BY id // 500) AS x FROM (SELECT id, " + normal_sql("id // 500", "id % 500") + f" AS e FROM range(0, {500 * FLOOR_SERIES}) t(id)))"
_FLOOR = f"(SELECT stddev_pop(h) AS noise FROM {_dfa_sql(_NOISE)})"


def _floor(s):
    """One row with noise, the standard deviation of h over series of white noise."""
    x = synthetic.white_noise(s, 500, FLOOR_SERIES).select(F.col("series_id").cast("string").alias("ticker"), "i", "r")
    return fractal.dfa(x).agg(F.stddev_pop("h").alias("noise"))


@query(sql(f"SELECT ticker, count(*) AS windows, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(any_value(noise), 6) AS noise, count(*) FILTER (WHERE abs(h - 0.5) > 1.96 * noise) AS breaches, round(avg(CAST(abs(h - 0.5) > 1.96 * noise AS DOUBLE)), 6) AS share FROM roll, {_FLOOR} GROUP BY ticker"))
def band_breaches(s, d):
    """Rolling windows whose h is beyond what noise alone gives in 95 of 100 cases."""
    return audit.breaches(hurst_panel(s, d), _floor(s))


@query(sql(f"SELECT round(any_value(o), 6) AS observed, round(any_value(noise), 6) AS noise, round(sqrt(greatest(any_value(o) ** 2 - any_value(noise) ** 2, 0)), 6) AS implied FROM (SELECT avg(s) AS o FROM (SELECT i, stddev_samp(h) AS s FROM roll GROUP BY i)), {_FLOOR}"))
def implied_dispersion(s, d):
    """What of the dispersion between tickers is left when the estimator's own noise is taken out."""
    return audit.implied_dispersion(audit.dispersion(_rebalances(s, d)), _floor(s))


def _shuffled_sql(reps):
    return f"(SELECT ticker || '|' || rep AS ticker, row_number() OVER (PARTITION BY ticker, rep ORDER BY md5(rep || ':' || ticker || ':' || i)) - 1 AS i, x, n FROM prof, range({reps}) t(rep))"


#: Shuffles of a ticker that are averaged.
SHUFFLES = 3


@query(sql(f"SELECT ticker, round(any_value(r), 6) AS h_real, round(avg(h), 6) AS h_shuffled, round(max(h) FILTER (WHERE rep = '0'), 6) AS h_single FROM (SELECT dfa.ticker, dfa.h AS r, g.h, split_part(g.ticker, '|', 2) AS rep FROM dfa JOIN {_dfa_sql(_shuffled_sql(SHUFFLES))} g ON split_part(g.ticker, '|', 1) = dfa.ticker) GROUP BY ticker"))
def shuffle_means(s, d):
    """h of the returns in their order, its mean over shuffles, and that of one shuffle, whose spread over tickers is the noise."""
    x = returns_series(s, d)
    made = fractal.dfa(synthetic.shuffles(x, SHUFFLES)).select(F.substring_index("ticker", "|", 1).alias("ticker"), F.substring_index("ticker", "|", -1).alias("rep"), F.col("h").alias("g"))
    means = made.groupBy("ticker").agg(F.avg("g").alias("h_shuffled"), F.max(F.when(F.col("rep") == "0", F.col("g"))).alias("h_single"))
    return fractal.dfa(x).join(means, "ticker").select("ticker", F.col("h").alias("h_real"), "h_shuffled", "h_single")


@query(sql(f"SELECT split_part(ticker, '|', 1) AS ticker, round(h, 6) AS h FROM {_dfa_sql(_shuffled_sql(1))}"))
def shuffle_control(s, d):
    return fractal.dfa(synthetic.shuffled(returns_series(s, d)))


@query(pick("(SELECT ticker, min(date) AS first, max(date) AS last, count(close) AS n, min(date) <= DATE '1995-01-10' AS covered FROM px GROUP BY ticker)", "ticker first last n covered"))
def coverage_audit(s, d):
    return audit.coverage(panels.brand_bars(s, d), "1995-01-10")


_SUB = "(SELECT * FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, r - avg(r) OVER (PARTITION BY ticker) AS x FROM (SELECT ticker || '|' || name AS ticker, date, r FROM ret, (VALUES ('early', DATE '1995-01-01', DATE '1998-01-01'), ('late', DATE '1998-01-01', DATE '2002-01-01')) v(name, a, b) WHERE date BETWEEN a AND b AND r IS NOT NULL)) WHERE n >= 300)"
_SUB_NOISE = f"(SELECT n || '|' || seed AS ticker, i, n, e - avg(e) OVER (PARTITION BY n, seed) AS x FROM (SELECT n, seed, i, {normal_sql(chr(110) + ' || ' + repr(':') + ' || seed', 'i')} AS e FROM (SELECT n, seed, unnest(range(0, n)) AS i FROM (SELECT DISTINCT n FROM {_SUB}), range(0, 50) t(seed))))"


@query(sql(f"SELECT h.ticker, l.n, round(h.h, 6) AS h, round(noise, 6) AS noise, abs(h.h - 0.5) > 1.96 * noise AS significant FROM {_dfa_sql(_SUB)} h JOIN (SELECT DISTINCT ticker, n FROM {_SUB}) l USING (ticker) JOIN (SELECT CAST(split_part(ticker, '|', 1) AS BIGINT) AS n, stddev_pop(h) AS noise FROM {_dfa_sql(_SUB_NOISE)} GROUP BY 1) z ON z.n = l.n"))
def subperiod_audit(s, d):
    periods = [("early", "1995-01-01", "1998-01-01"), ("late", "1998-01-01", "2002-01-01")]
    return audit.subperiod_significance(frames.with_returns(index(s, d)).select("ticker", "date", "r"), periods)


@query(pick("sets", "rebal train_start train_end last_used n_train n_test", "", "n_test >= 10"))
def walkforward_train_sets(s, d):
    return model.train_sets(ml_panel(s, d))


@query(sql("SELECT p.date, p.ticker, round(s.intercept + s.slope * p.mom_12_1, 6) + 0.0::DOUBLE AS prediction FROM sets s JOIN panel p ON p.date = s.rebal WHERE s.n_test >= 10"))
def walkforward_ols(s, d):
    return model.walk_forward_ols(ml_panel(s, d))


@query()
def walkforward_gbt(s, d):
    return forest.walk_forward(ml_panel(s, d))


@query()
def gbt_sort_backtest(s, d):
    """The predictions traded: those of a month end are the next month's signal."""
    x = feats(s, d)
    made = forest.walk_forward(kept(panel_of(x))).withColumnRenamed("prediction", "factor")
    return bt.net_returns(bt.sort_backtest(bt.carried(made, x), x).returns)


@query(sql("SELECT ticker, date, round(factor, 6) + 0.0::DOUBLE AS factor FROM (SELECT t.ticker, m.date, last_value(f.factor IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY m.date) AS factor FROM months m CROSS JOIN (SELECT DISTINCT ticker FROM ols) t LEFT JOIN ols f ON f.ticker = t.ticker AND last_day(f.date) = m.date) WHERE factor IS NOT NULL"))
def prediction_factor(s, d):
    """Predictions of the regressions as a factor for every month: one without keeps the last."""
    x = feats(s, d)
    made = model.walk_forward_ols(kept(panel_of(x))).withColumnRenamed("prediction", "factor")
    return bt.carried(made, x)


@query()
def feature_importance(s, d):
    return model.tree_importances(ml_panel(s, d))


# Generators


@query(pick("noise", "series_id i", "r"))
def gen_white_noise(s, d):
    return synthetic.white_noise(s, 500, 4)


@query(sql("SELECT series_id, i, round(sum(r) OVER (PARTITION BY series_id ORDER BY i), 6) + 0.0::DOUBLE AS x FROM noise"))
def gen_random_walk(s, d):
    return synthetic.random_walk(s, 500, 4)


@query(sql("SELECT a.series_id, a.i, round(coalesce(sum(b.r * pow(0.5, a.i - b.i)), 0), 6) + 0.0::DOUBLE AS r FROM noise a LEFT JOIN noise b ON b.series_id = a.series_id AND b.i > 0 AND b.i <= a.i GROUP BY a.series_id, a.i"))
def gen_ar1(s, d):
    return synthetic.ar1(s, 500, 0.5, 4)


@query()
def gen_fgn(s, d):
    return synthetic.fgn(s, [(500, 0.3, 1), (500, 0.7, 2)])


@query()
def noise_floor(s, d):
    x = synthetic.fgn(s, [(n, h, k) for n in (500, 1000, 2000, 4000, 5300) for h in (0.45, 0.5, 0.55) for k in range(200)])
    named = x.select(F.concat_ws("|", "n", "true_h", "seed").alias("ticker"), "i", "r")
    h = fractal.dfa(named).select(F.split("ticker", r"\|").alias("p"), "h").select(F.col("p")[0].cast("long").alias("n"), F.col("p")[1].cast("double").alias("true_h"), "h")
    return h.groupBy("n", "true_h").agg(F.avg("h").alias("mean"), (F.avg("h") - F.first("true_h")).alias("bias"), F.stddev_pop("h").alias("std"))


@query()
def estimator_validation(s, d):
    """What the estimators make of series whose memory is known."""
    long = synthetic.fgn(s, [(4000, h, k) for h in (0.3, 0.5, 0.6, 0.7, 0.8) for k in range(20)])
    return audit.validation(long, synthetic.white_noise(s, 2000, 50), synthetic.ar1(s, 2000, 0.5, 50))
