"""What the queries should return, as SQL for DuckDB: named table expressions, and a text for each query."""

from __future__ import annotations

import math
import re

from tidemark.functions.fractal import Q_VALUES

W = "(PARTITION BY ticker ORDER BY date)"


def values(xs) -> str:
    return ", ".join(f"({x})" for x in xs)


def rolling(of: str, x: str, a: str, b: str, n: int, alias: str) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {a} AND {b})"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {of}({x}) {frame} END AS {alias}"


def unit(key: str) -> str:
    return f"((CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normal_sql(series: str, i: str) -> str:
    """The noise of ``synthetic.normal`` for two expressions."""
    key = f" || ({series}) || ':' || ({i})"
    return f"sqrt(-2 * ln({unit(chr(39) + 'a:' + chr(39) + key)})) * cos(2 * pi() * {unit(chr(39) + 'b:' + chr(39) + key)})"


def scales_sql(source: str, low: int, count: int, order: int) -> str:
    """ticker, n, s: the window lengths of each series of a source, by its own length."""
    a, last = f"{math.log10(low)!r}::DOUBLE", count - 1
    grid = f"CASE WHEN k = {last} THEN pow(10.0::DOUBLE, log10(m::DOUBLE)) ELSE pow(10.0::DOUBLE, {a} + k * ((log10(m::DOUBLE) - {a}) / {last}.0::DOUBLE)) END"
    return f"SELECT DISTINCT ticker, n, s FROM (SELECT ticker, n, CAST(floor({grid}) AS BIGINT) AS s FROM (SELECT DISTINCT ticker, n, greatest(n // 4, {low}) AS m FROM {source}), range(0, {count}) u(k)) WHERE s > {2 * (order + 1)} AND s <= n // 2"


CTES: dict[str, str] = {
    "px": "SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "nat": "SELECT n_name AS ticker, r_name AS asset_class, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "grid": "SELECT * FROM (SELECT DISTINCT date FROM px) CROSS JOIN (SELECT DISTINCT ticker FROM px)",
    "dense": f"SELECT g.ticker, g.date, last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date) AS close FROM grid g LEFT JOIN px p ON p.ticker = g.ticker AND p.date = g.date",
    "ix": f"SELECT ticker, date, 100 * exp(sum(0.01::DOUBLE * z) OVER {W}) AS close FROM (SELECT *, (close - avg(close) OVER (PARTITION BY ticker)) / stddev_samp(close) OVER (PARTITION BY ticker) AS z FROM dense WHERE close IS NOT NULL AND date >= (SELECT max(f) FROM (SELECT min(date) AS f FROM px GROUP BY ticker)))",
    "ret": f"SELECT *, ln(close) AS lp, ln(close) - lag(ln(close)) OVER {W} AS r, row_number() OVER {W} - 1 AS i FROM ix",
    "feat": f"""SELECT *, (lp - lag(lp, 252) OVER {W}) - (lp - lag(lp, 21) OVER {W}) AS mom_12_1, lp - lag(lp, 21) OVER {W} AS ret_1m,
      sqrt(252) * {rolling('stddev_samp', 'r', '59 PRECEDING', 'CURRENT ROW', 60, 'v60').replace(' AS v60', '')} AS vol_60,
      sqrt(252) * {rolling('stddev_samp', 'r', '251 PRECEDING', 'CURRENT ROW', 252, 'v').replace(' AS v', '')} AS vol_252,
      lead(lp, 21) OVER {W} - lp AS target,
      sqrt(252) * {rolling('stddev_samp', 'r', '1 FOLLOWING', '21 FOLLOWING', 21, 'v').replace(' AS v', '')} AS fwd_vol_21 FROM ret""",
    "zsc": f"SELECT *, (ret_1m - m) / nullif(s, 0) AS z FROM (SELECT *, {rolling('avg', 'ret_1m', '251 PRECEDING', 'CURRENT ROW', 252, 'm')}, {rolling('stddev_samp', 'ret_1m', '251 PRECEDING', 'CURRENT ROW', 252, 's')} FROM feat)",
    "ffd_w": "SELECT k, w FROM (SELECT j AS k, product(CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE (j - 1 - 0.4::DOUBLE) / j END) OVER (ORDER BY j) AS w FROM range(0, 10000) t(j)) WHERE abs(w) >= 1e-5",
    "ffd_y": "SELECT ticker, i, sum(w * lp) AS y FROM (SELECT ticker, i + k AS i, w, lp FROM ret, ffd_w) GROUP BY ticker, i HAVING count(*) = (SELECT count(*) FROM ffd_w)",
    "ffd_all": "SELECT r.*, y FROM ret r LEFT JOIN ffd_y USING (ticker, i)",
    "ffd_z": f"SELECT ticker, date, i, y, (y - m) / nullif(s, 0) AS fd_z FROM (SELECT *, {rolling('avg', 'y', '251 PRECEDING', 'CURRENT ROW', 252, 'm')}, {rolling('stddev_samp', 'y', '251 PRECEDING', 'CURRENT ROW', 252, 's')} FROM ffd_all)",
    "featz": "SELECT feat.*, fd_z FROM feat JOIN ffd_z USING (ticker, date)",
    "panel": "SELECT * FROM featz WHERE mom_12_1 IS NOT NULL AND ret_1m IS NOT NULL AND vol_60 IS NOT NULL AND vol_252 IS NOT NULL AND fd_z IS NOT NULL AND target IS NOT NULL",
    "months": "SELECT last_day(CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE)) AS date FROM (SELECT min(date) AS a, max(date) AS b FROM ret)",
    "mret": "SELECT t.ticker, m.date, coalesce(sum(r), 0) AS r FROM months m CROSS JOIN (SELECT DISTINCT ticker FROM ret) t LEFT JOIN ret ON ret.ticker = t.ticker AND last_day(ret.date) = m.date GROUP BY ALL",
    "fac_mom": "SELECT ticker, date, mom_12_1 AS factor FROM feat",
    "prof": "SELECT ticker, i, n, x, sum(x) OVER (PARTITION BY ticker ORDER BY i) AS y FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, r - avg(r) OVER (PARTITION BY ticker) AS x FROM ret WHERE r IS NOT NULL) WHERE n >= 100",
    "dfa_s": scales_sql("prof", 10, 20, 1),
    "dfa_w": "SELECT ticker, s, i // s AS w, greatest(regr_syy(y, i) - regr_sxy(y, i) ** 2 / regr_sxx(y, i), 0) / s AS mse FROM prof JOIN dfa_s USING (ticker, n) WHERE i < s * (n // s) GROUP BY ticker, s, i // s",
    "dfa_f": "SELECT ticker, s, sqrt(avg(mse)) AS f FROM dfa_w GROUP BY ALL",
    "dfa": "SELECT ticker, regr_slope(ln(f), ln(s)) AS h FROM dfa_f WHERE f > 0 GROUP BY ticker HAVING count(*) >= 4",
    "roll_s": scales_sql("rprof", 10, 20, 1),
    "roll_f": "SELECT ticker, s, sqrt(avg(mse)) AS f FROM (SELECT ticker, s, greatest(regr_syy(y, i) - regr_sxy(y, i) ** 2 / regr_sxx(y, i), 0) / s AS mse FROM rprof JOIN roll_s USING (ticker, n) WHERE i < s * (n // s) GROUP BY ticker, s, i // s) GROUP BY ticker, s",
    "roll": "SELECT split_part(ticker, '|', 1) AS ticker, CAST(split_part(ticker, '|', 2) AS BIGINT) AS i, regr_slope(ln(f), ln(s)) AS h FROM roll_f WHERE f > 0 GROUP BY ALL HAVING count(*) >= 4",
    "dfa2_s": scales_sql("prof", 10, 20, 2),
    "dfa2_w": "SELECT ticker, s, (sum(yc * yc) - sum(yc * u) ** 2 / (s * (s * s - 1.0::DOUBLE) / 12) - sum(yc * (u * u - (s * s - 1) / 12.0::DOUBLE)) ** 2 / (s::DOUBLE * (s * s - 1) * (s * s - 4) / 180)) / s AS mse FROM (SELECT ticker, s, i // s AS w, i % s - (s - 1) / 2.0::DOUBLE AS u, y - avg(y) OVER (PARTITION BY ticker, s, i // s) AS yc FROM prof JOIN dfa2_s USING (ticker, n) WHERE i < s * (n // s)) GROUP BY ticker, s, w",
    "dfa2": "SELECT ticker, regr_slope(ln(f), ln(s)) AS h FROM (SELECT ticker, s, sqrt(avg(greatest(mse, 0))) AS f FROM dfa2_w GROUP BY ALL) WHERE f > 0 GROUP BY ticker HAVING count(*) >= 4",
    "fac_hurst": "SELECT ticker, date, h AS factor FROM roll JOIN ret USING (ticker, i)",
    "rollvol": "SELECT r.ticker, r.i, r.date, r.h, f.vol_252 AS vol, 'class' || (TRY_CAST(substr(r.ticker, 7) AS INT) % 5) AS cls FROM (SELECT ticker, i, h, date FROM roll JOIN ret USING (ticker, i)) r JOIN feat f USING (ticker, i)",
    "res1": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, count(*) OVER (PARTITION BY date, cls) AS k FROM rollvol WHERE h IS NOT NULL AND vol IS NOT NULL) WHERE n >= 20 AND k >= 2",
    "res2": "SELECT date, ticker, cls, h, vol, h - avg(h) OVER (PARTITION BY date, cls) AS hd, vol - avg(vol) OVER (PARTITION BY date, cls) AS vd FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n2 FROM res1) WHERE n2 >= 20",
    "res": "SELECT *, hd - coalesce(sum(hd * vd) OVER (PARTITION BY date) / nullif(sum(vd * vd) OVER (PARTITION BY date), 0), 0) * vd AS residual FROM res2",
    "fac_res": "SELECT ticker, date, residual AS factor FROM res",
    "band": "SELECT ticker, n, coalesce(least(greatest(sum(x * x1) / nullif(sum(x1 * x1), 0), -0.97), 0.97), 0)::DOUBLE AS rho FROM (SELECT *, CASE WHEN x1_ IS NULL THEN NULL ELSE x1_ END AS x1 FROM (SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY i) AS x1_ FROM prof)) GROUP BY ALL",
    "bandq": "SELECT *, greatest(1, least(CAST(ceil(1.1447::DOUBLE * pow(4 * rho * rho / pow(1 - rho * rho, 2) * n, 1.0::DOUBLE / 3)) AS BIGINT), n // 4)) AS q FROM band",
    "nw": "SELECT a.ticker, q.q, sqrt(greatest(sum(CASE WHEN q.j = 0 THEN 1 ELSE 2 * (1 - q.j / (q.q + 1.0::DOUBLE)) END * a.x * b.x / a.n), 1e-16)) AS s FROM prof a JOIN (SELECT ticker, q, unnest(range(0, q + 1)) AS j FROM bandq) q ON q.ticker = a.ticker JOIN prof b ON b.ticker = a.ticker AND b.i = a.i - q.j GROUP BY a.ticker, q.q",
    "nw0": "SELECT ticker, 0 AS q, sqrt(greatest(sum(x * x / n), 1e-16)) AS s FROM prof GROUP BY ALL",
    "mf_s": scales_sql("prof", 20, 12, 2),
    "mf_x": """SELECT *, j // s AS w, j % s - (s - 1) / 2.0::DOUBLE AS u FROM (
      SELECT ticker, i, y, n, s, n // s AS m, d, CASE WHEN d = 0 THEN i ELSE i - (n - (n // s) * s) END AS j
      FROM prof JOIN mf_s USING (ticker, n), (VALUES (0), (1)) t(d) WHERE n >= 200) WHERE j >= 0 AND j < m * s""",
    "mf_w": "SELECT ticker, s, (sum(yc * yc) - sum(yc * u) ** 2 / (s * (s * s - 1.0::DOUBLE) / 12) - sum(yc * (u * u - (s * s - 1) / 12.0::DOUBLE)) ** 2 / (s::DOUBLE * (s * s - 1) * (s * s - 4) / 180)) / s AS f2, sum(yc * yc) / s AS raw FROM (SELECT *, y - avg(y) OVER (PARTITION BY ticker, s, d, w) AS yc FROM mf_x) GROUP BY ticker, s, d, w",
    "mf_f": f"SELECT ticker, q, s, pow(avg(pow(f2, q / 2)), 1 / q) AS f FROM mf_w, (VALUES {values(f'{q}::DOUBLE' for q in Q_VALUES)}) v(q) WHERE f2 > 1e-12::DOUBLE * raw GROUP BY ticker, q, s HAVING count(*) >= 4",
    "mf_h": "SELECT ticker, q, regr_slope(ln(f), ln(s)) AS h FROM mf_f WHERE f > 0 GROUP BY ALL HAVING count(*) >= 4",
    "hb": "SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, first(value + 1 ORDER BY ts, event_id) AS open, max(value + 1) AS high, min(value + 1) AS low, last(value + 1 ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2",
    "seas": "SELECT ticker, hour(ts) AS hour, avg(a) AS abs_ret, avg(volume) AS volume, count(*) AS n FROM (SELECT *, abs(ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY ts)) AS a FROM hb) GROUP BY 1, 2",
    "shape": "SELECT *, abs_ret / nullif(avg(abs_ret) OVER (PARTITION BY ticker), 0) AS abs_ret_shape, volume / nullif(avg(volume) OVER (PARTITION BY ticker), 0) AS volume_shape FROM seas",
    "half": "SELECT *, CASE WHEN pos <= n_all // 2 THEN 0 ELSE 1 END AS half FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_all, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS pos FROM hb) WHERE n_all >= 200",
    "vprof": "SELECT ticker, hour, v / t AS share FROM (SELECT *, sum(v) OVER (PARTITION BY ticker) AS t FROM (SELECT ticker, hour(ts) AS hour, avg(volume) AS v FROM half WHERE half = 0 GROUP BY 1, 2)) WHERE t > 0",
    "vwap": "SELECT ticker, CAST(ts AS DATE) AS date, CASE WHEN sum(volume) > 0 THEN sum((high + low + close) / 3 * volume) / sum(volume) ELSE avg(close) END AS vwap, count(*) AS n FROM hb GROUP BY 1, 2",
    "test": "SELECT t.*, coalesce(v.share, 1.0::DOUBLE / t.n) AS w FROM (SELECT *, CAST(ts AS DATE) AS date, count(*) OVER (PARTITION BY ticker, CAST(ts AS DATE)) AS n, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) AS rn FROM half WHERE half = 1) t LEFT JOIN vprof v ON v.ticker = t.ticker AND v.hour = hour(t.ts) WHERE t.n >= 4 AND t.ticker IN (SELECT ticker FROM vprof)",
    "fills": "SELECT ticker, date, CASE WHEN sum(volume) > 0 THEN sum((high + low + close) / 3 * volume) / sum(volume) ELSE avg(close) END AS vwap, avg(close) AS uniform, coalesce(sum(w * close) / nullif(sum(w), 0), avg(close)) AS vwap_profile, avg(close) FILTER (WHERE rn > 1) AS avoid_open, first(close ORDER BY ts) AS front_load, last(close ORDER BY ts) AS end_load FROM test GROUP BY 1, 2",
    "cost": "SELECT ticker, date, " + ", ".join(f"1e4 * ({s} - vwap) / vwap AS {s}" for s in ("uniform", "vwap_profile", "avoid_open", "front_load", "end_load")) + " FROM fills",
    "costl": "SELECT * FROM (UNPIVOT cost ON uniform, vwap_profile, avoid_open, front_load, end_load INTO NAME schedule VALUE bps)",
    "me": "SELECT rebal FROM (SELECT last_day(date) AS m, max(date) AS rebal, lead(last_day(date)) OVER (ORDER BY last_day(date)) AS more FROM panel GROUP BY 1) WHERE more IS NOT NULL",
    "wday": "SELECT d::DATE AS d, row_number() OVER (ORDER BY d) AS k FROM range(DATE '1980-01-01', DATE '2030-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5",
    "win": "SELECT rebal, CAST(rebal - INTERVAL 60 MONTH AS DATE) AS train_start, (SELECT b.d FROM wday b WHERE b.k = (SELECT max(a.k) FROM wday a WHERE a.d < rebal) - 21) AS train_end FROM me",
    "sets": "SELECT w.*, max(p.date) AS last_used, count(*) AS n_train, (SELECT count(*) FROM panel t WHERE t.date = w.rebal) AS n_test, regr_slope(p.target, p.mom_12_1) AS slope, regr_intercept(p.target, p.mom_12_1) AS intercept FROM win w JOIN panel p ON p.date BETWEEN w.train_start AND w.train_end GROUP BY w.rebal, w.train_start, w.train_end HAVING count(*) >= 1000",
    "ols": "SELECT p.date, p.ticker, s.intercept + s.slope * p.mom_12_1 AS factor FROM sets s JOIN panel p ON p.date = s.rebal WHERE s.n_test >= 10",
    "psd_x": "SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, abs(r) AS x FROM (SELECT ticker, ts, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY ts) AS r FROM hb) WHERE isfinite(r)",
    "psd_l": "SELECT *, l - l // 2 AS step FROM (SELECT *, least(256, n // 2) AS l FROM psd_x WHERE n > 128)",
    "psd_s": "SELECT ticker, k, i - k * step AS j, l, x - avg(x) OVER (PARTITION BY ticker, k) AS x FROM (SELECT *, unnest([i // step - 1, i // step]) AS k FROM psd_l) WHERE k >= 0 AND k * step + l <= n AND i - k * step < l",
    "psd_w": "SELECT ticker, k, l, j, x * (0.5 - 0.5 * cos(2 * pi() * j / l)) AS x, sum((0.5 - 0.5 * cos(2 * pi() * j / l)) ** 2) OVER (PARTITION BY ticker, k) AS power FROM psd_s",
    "psd_f": "SELECT ticker, k, l, f, (sum(x * cos(2 * pi() * f * j / l)) ** 2 + sum(x * sin(2 * pi() * f * j / l)) ** 2) / any_value(power) * CASE WHEN f = 0 OR 2 * f = l THEN 1 ELSE 2 END AS p FROM psd_w, range(0, 129) t(f) WHERE f <= l // 2 GROUP BY ticker, k, l, f",
    "psd": "SELECT ticker, f / l AS freq, avg(p) AS psd FROM psd_f GROUP BY ticker, f, l",
    "lines_d": "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS close FROM lineitem GROUP BY 1",
    "orders_d": "SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS close FROM orders GROUP BY 1",
    "gaterows": "SELECT date, delta_h, fwd FROM (SELECT a.date, max(r.h) - min(r.h) AS delta_h, any_value(a.fwd) AS fwd FROM (SELECT ticker, i, date, target AS fwd FROM feat) a JOIN roll r USING (ticker, i) WHERE a.fwd IS NOT NULL AND a.ticker IS NOT NULL GROUP BY a.date) WHERE false",
    "gates": "SELECT f.date, m.delta_h, f.target AS fwd FROM rmf m JOIN feat f ON m.ticker = f.ticker || '|' || (f.i + 1) WHERE f.ticker = (SELECT min(ticker) FROM ix) AND m.delta_h IS NOT NULL AND f.target IS NOT NULL",
    "causal": "SELECT *, CASE WHEN rn <= 40 OR delta_h <= threshold THEN fwd ELSE 0 END AS gated FROM (SELECT *, row_number() OVER (ORDER BY date) AS rn, median(delta_h) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS threshold FROM gates)",
    "leaky": "SELECT *, CASE WHEN delta_h <= threshold THEN fwd ELSE 0 END AS gated FROM (SELECT *, median(delta_h) OVER () AS threshold FROM gates)",
    "noise": f"SELECT id // 500 AS series_id, id % 500 AS i, sqrt(-2 * ln({unit(chr(39) + 'a:' + chr(39) + ' || (id // 500) || ' + chr(39) + ':' + chr(39) + ' || (id % 500)')})) * cos(2 * pi() * {unit(chr(39) + 'b:' + chr(39) + ' || (id // 500) || ' + chr(39) + ':' + chr(39) + ' || (id % 500)')}) AS r FROM range(0, 2000) t(id)",
}
del CTES["gaterows"]


def backtest(name: str) -> None:
    """Table expressions of a sort by fac_<name>: _m, _legs, _mon and _bt."""
    f = name
    CTES[f"{f}_m"] = f"SELECT ticker, last_day(date) AS date, arg_max(factor, date) AS factor FROM fac_{f} WHERE factor IS NOT NULL GROUP BY 1, 2"
    CTES[f"{f}_sig"] = f"SELECT r.ticker, r.date, r.r, m.factor FROM mret r JOIN {f}_m m ON m.ticker = r.ticker AND last_day(CAST(m.date + INTERVAL 1 MONTH AS DATE)) = r.date WHERE r.date IN (SELECT date FROM {f}_m)"
    CTES[f"{f}_rk"] = f"SELECT *, (rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS pct, count(*) OVER (PARTITION BY date) AS n FROM {f}_sig"
    CTES[f"{f}_sd"] = f"SELECT *, CASE WHEN pct > 4 / 5.0::DOUBLE THEN 'L' WHEN pct <= 1 / 5.0::DOUBLE THEN 'S' END AS leg FROM {f}_rk WHERE n >= 25"
    CTES[f"{f}_legs"] = f"SELECT date, ticker, r, leg, CASE WHEN leg = 'L' THEN 1.0::DOUBLE / ln ELSE -1.0::DOUBLE / sn END AS weight FROM (SELECT *, count(*) FILTER (WHERE leg = 'L') OVER (PARTITION BY date) AS ln, count(*) FILTER (WHERE leg = 'S') OVER (PARTITION BY date) AS sn FROM {f}_sd WHERE leg IS NOT NULL) WHERE ln >= 5 AND sn >= 5"
    CTES[f"{f}_mon"] = f"SELECT date, row_number() OVER (ORDER BY date) AS seq, avg(r) FILTER (WHERE leg = 'L') AS long_r, avg(r) FILTER (WHERE leg = 'S') AS short_r, sum(abs(weight)) AS gross FROM {f}_legs GROUP BY date"
    CTES[f"{f}_held"] = f"SELECT m.seq, l.ticker, l.weight FROM {f}_legs l JOIN {f}_mon m USING (date)"
    CTES[f"{f}_trade"] = f"SELECT seq, sum(abs(d)) AS traded FROM (SELECT coalesce(a.seq, b.seq + 1) AS seq, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM {f}_held a FULL JOIN {f}_held b ON b.ticker = a.ticker AND b.seq + 1 = a.seq) GROUP BY seq"
    CTES[f"{f}_bt"] = f"SELECT m.seq, m.date, m.long_r, m.short_r, m.long_r - m.short_r AS ls_r, t.traded, t.traded / 2 / m.gross AS turnover, m.long_r - m.short_r - coalesce(t.traded, 0) * 10 / 1e4 AS net_r FROM {f}_mon m LEFT JOIN {f}_trade t ON t.seq = m.seq AND m.seq > 1"
    CTES[f"{f}_eq"] = f"SELECT seq, date, equity, equity / max(equity) OVER (ORDER BY seq) - 1 AS drawdown FROM (SELECT *, product(1 + ls_r) OVER (ORDER BY seq) AS equity FROM {f}_bt)"


for _name in ("mom", "hurst", "res"):
    backtest(_name)


CTES["rprof"] = "SELECT *, sum(x) OVER (PARTITION BY ticker ORDER BY i) AS y FROM (SELECT p.ticker || '|' || e.i AS ticker, row_number() OVER (PARTITION BY p.ticker, e.i ORDER BY p.i) - 1 AS i, count(*) OVER (PARTITION BY p.ticker, e.i) AS n, p.r - avg(p.r) OVER (PARTITION BY p.ticker, e.i) AS x FROM ret e JOIN ret p ON p.ticker = e.ticker AND p.i >= e.i - 500 AND p.i < e.i WHERE e.i >= 500 AND (e.i - 500) % 21 = 0 AND p.r IS NOT NULL) WHERE n >= 400"
for _k in "sxwfh":
    CTES[f"rmf_{_k}"] = CTES[f"mf_{_k}"].replace("mf_", "rmf_").replace("prof", "rprof")
CTES["rmf"] = "SELECT ticker, max(h) - min(h) AS delta_h, max(h) FILTER (WHERE q = 2) AS h2 FROM rmf_h GROUP BY ticker"


def boot(block: float) -> None:
    """Runs of neighbours, written out draw by draw."""
    n = f"bt{int(block)}"
    CTES["bs"] = "SELECT seq - 1 AS k, net_r, ls_r, count(*) OVER () AS n FROM mom_bt"
    most = "n" if block <= 1 else f"least(n, CAST(ceil(n / {block}::DOUBLE + 8 * sqrt(n / {block}::DOUBLE) + 8) AS BIGINT))"
    drawn = "1" if block <= 1 else f"CASE WHEN j = most - 1 THEN n ELSE least(n, 1 + CAST(floor(ln({unit(chr(39) + 'r:0:' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || j')}) / ln(1 - 1 / {block}::DOUBLE)) AS BIGINT)) END"
    start = f"CAST(floor({unit(chr(39) + '0:' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || j')} * n) AS BIGINT)"
    CTES[f"{n}_r"] = f"SELECT rep, j, n, {start} AS st, {drawn} AS drawn FROM (SELECT rep, n, most, unnest(range(0, most)) AS j FROM (SELECT n, {most} AS most FROM bs LIMIT 1), range(0, 5000) t(rep))"
    CTES[f"{n}_d"] = f"SELECT rep, (st + unnest(range(0, least(drawn, n - place)))) % n AS k FROM (SELECT *, CAST(sum(drawn) OVER (PARTITION BY rep ORDER BY j) - drawn AS BIGINT) AS place FROM {n}_r) WHERE place < n"
    CTES[f"{n}_s"] = f"SELECT rep, sqrt(12) * avg(net_r) / nullif(stddev_pop(net_r), 0) AS s, sqrt(12) * avg(ls_r) / nullif(stddev_pop(ls_r), 0) AS g FROM {n}_d d JOIN bs USING (k) GROUP BY rep"


boot(1.0)
boot(3.0)


def sql(text: str) -> str:
    """The text after those table expressions that it needs."""
    need, seen = set(re.findall(r"\w+", text)), set()
    while new := (need & CTES.keys()) - seen:
        seen |= new
        for k in new:
            need |= set(re.findall(r"\w+", CTES[k]))
    order: list[str] = []

    def add(k: str) -> None:
        for d in re.findall(r"\w+", CTES[k]):
            if d in CTES and d != k and d not in order:
                add(d)
        if k not in order:
            order.append(k)

    for k in CTES:
        if k in seen:
            add(k)
    return "WITH " + ",\n".join(f"{k} AS ({CTES[k]})" for k in order) + "\n" + text if order else text


def pick(source: str, keys: str, floats: str = "", where: str = "") -> str:
    """Columns as they are, and floats rounded to six places."""
    cols = [*keys.split(), *[f"round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE AS {x}" for x in floats.split()]]
    return sql(f"SELECT {', '.join(cols)} FROM {source}" + (f" WHERE {where}" if where else ""))
