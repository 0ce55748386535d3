"""The driver queries once more, as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from ..operators.features import REGISTER

def _local(x: str) -> str:
    return f"(({x}) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')"


def _utc(x: str) -> str:
    return f"(({x})::TIMESTAMP AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC')"


def _periods(day: str) -> str:
    return f"((epoch({_utc(f'{day} + INTERVAL 1 DAY')}) - epoch({_utc(day)})) / 1800)::INTEGER"


def _period(t: str) -> str:
    return f"(floor((epoch({t}) - epoch({_utc(f'({_local(t)})::DATE')})) / 1800) + 1)::INTEGER"


HH = "hh AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS t, floor(sum(round(value * 100)::BIGINT) / count(value)) / 100.0 AS price, count(*)::DOUBLE AS volume FROM events GROUP BY 1)"
G = f"{HH}, g AS (SELECT r.t, price, volume FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 30 MINUTE)) AS t FROM hh) r LEFT JOIN hh USING (t))"
THIN = f"{G}, x AS (SELECT t, CASE WHEN volume >= 3 THEN price END AS p FROM g)"
STEPPED = f"{G}, x AS (SELECT t, floor(price / 100) * 100.0 AS x FROM g)"
DAYS = "od AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1)"
BASE = f"""{G}, base AS (
  SELECT t AS target_time, price AS actual, {_local("t")}::DATE AS d, (hour({_local("t")}) * 60 + minute({_local("t")}))::INTEGER AS m, {_utc(f"({_local('t')})::DATE - 1 + INTERVAL 11 HOUR")} AS dec FROM g
), px AS (SELECT d, m, actual AS price, target_time AS source_time, target_time + INTERVAL 90 MINUTE AS av FROM base WHERE actual IS NOT NULL),
days AS (SELECT DISTINCT d, dec FROM base),
pd AS (SELECT d, avg(price) AS mean, max(price) - min(price) AS spread, max(av) AS av FROM px GROUP BY d)"""
FILL = """a AS (SELECT *, max(t) FILTER (p IS NOT NULL) OVER (ORDER BY t) AS ta, min(t) FILTER (p IS NOT NULL) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM x),
f AS (
  SELECT a.*, coalesce(a.p IS NULL AND (epoch(tb) - epoch(ta)) / 1800 - 1 <= 2, false) AS short, xa.p + (xb.p - xa.p) * (epoch(a.t) - epoch(ta)) / nullif(epoch(tb) - epoch(ta), 0) AS line
  FROM a LEFT JOIN x xa ON xa.t = a.ta LEFT JOIN x xb ON xb.t = a.tb
)"""
CLEAN = f"""hh AS (SELECT t, CASE WHEN price < 150 THEN 0.0 ELSE floor(price / 20) * 20.0 END AS price, volume FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS t, floor(sum(round(value * 100)::BIGINT) / count(value)) / 100.0 AS price, count(*)::DOUBLE AS volume FROM events GROUP BY 1)),
g AS (SELECT r.t, price, volume FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 30 MINUTE)) AS t FROM hh) r LEFT JOIN hh USING (t)),
j AS (SELECT *, coalesce(abs(price) <= 1e-9 AND volume < 4, false) AS defaulted, coalesce(abs(price) > 1e-9 AND volume < 4, false) AS anomaly FROM g),
x AS (SELECT t, volume, defaulted, anomaly, CASE WHEN NOT defaulted THEN price END AS p FROM j),
{FILL},
r1 AS (SELECT *, sum(CASE WHEN coalesce(lagp <> p, true) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS run FROM (SELECT *, lag(p) OVER (ORDER BY t) AS lagp FROM f)),
c AS (
  SELECT t, CASE WHEN short THEN line ELSE p END AS price, defaulted, anomaly, coalesce(p < 0 OR p > 450, false) AS oob, p IS NOT NULL AND count(*) OVER (PARTITION BY run) >= 2 AS stuck, short AS interpolated,
    {_local("t")}::DATE AS settlement_date, {_period("t")} AS settlement_period
  FROM r1
), u AS (SELECT *, price IS NOT NULL AND NOT oob AND NOT stuck AS period_usable, count(*) OVER (PARTITION BY settlement_date) = {_periods("settlement_date")} AS day_complete FROM c),
cl AS (SELECT *, day_complete AND bool_and(period_usable) OVER (PARTITION BY settlement_date) AS day_usable FROM u)"""
TYPED = "ty AS (SELECT ts::DATE AS day, event_type, floor(sum(round(value * 100)::BIGINT) / count(value)) / 100.0 AS price, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"
TYPES = ["click", "error", "purchase", "signup", "view"]
WIDE = f"{TYPED}, w AS (SELECT day, " + ", ".join(f"max(price) FILTER (event_type = '{t}') AS {t}_price, max(volume) FILTER (event_type = '{t}') AS {t}_volume" for t in TYPES) + " FROM ty GROUP BY day)"
SCORED = f"""{BASE}, wk AS (SELECT days.d, px.m, avg(px.price) AS mean_7d FROM days JOIN px ON px.d BETWEEN days.d - 8 AND days.d - 2 AND px.av < days.dec GROUP BY 1, 2),
sc AS (
  SELECT b.*, p2.price AS naive_d2, p7.price AS naive_d7, wk.mean_7d, wk.mean_7d - 60.0 AS q10, wk.mean_7d AS q50, wk.mean_7d + 60.0 AS q90
  FROM base b LEFT JOIN px p2 ON p2.d = b.d - 2 AND p2.m = b.m AND p2.av < b.dec LEFT JOIN px p7 ON p7.d = b.d - 7 AND p7.m = b.m AND p7.av < b.dec LEFT JOIN wk ON wk.d = b.d AND wk.m = b.m
), mt AS (SELECT * FROM sc WHERE actual IS NOT NULL AND naive_d2 IS NOT NULL AND naive_d7 IS NOT NULL AND mean_7d IS NOT NULL)"""
MARKET = f"""{G}, tg AS (SELECT t AS target_time, price AS price_apx, volume, {_local("t")}::DATE AS d, (hour({_local("t")}) * 60 + minute({_local("t")}))::INTEGER AS m, {_period("t")} AS settlement_period, {_utc(f"({_local('t')})::DATE - 1 + INTERVAL 11 HOUR")} AS dec FROM g),
vw AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 2 DAY AS target_time, ts AS published_at, value FROM events WHERE event_type = 'view'),
ck AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 2 DAY AS target_time, ts AS published_at, value FROM events WHERE event_type = 'click'),
pit AS (
  SELECT tg.*, vw.value AS wind, vw.published_at AS wind_at, ck.value AS demand
  FROM tg ASOF LEFT JOIN vw ON tg.target_time = vw.target_time AND tg.dec > vw.published_at ASOF LEFT JOIN ck ON tg.target_time = ck.target_time AND tg.dec > ck.published_at
)"""
FEATURES = f"""{MARKET}, px AS (SELECT d, m, price_apx AS price, target_time + INTERVAL 90 MINUTE AS av FROM tg WHERE price_apx IS NOT NULL AND NOT coalesce(volume < 2, false)),
days AS (SELECT DISTINCT d, dec FROM tg),
pd AS (SELECT d, avg(price) AS mean, max(price) - min(price) AS spread, max(av) AS av FROM px GROUP BY d),
er AS (SELECT d, avg((wind - price_apx) / 500.0) AS e, max(target_time) + INTERVAL 90 MINUTE AS av FROM pit WHERE wind IS NOT NULL AND price_apx IS NOT NULL GROUP BY d),
w7 AS (SELECT days.d, avg(price) AS mean, stddev_samp(price) AS std FROM days JOIN px ON px.d BETWEEN days.d - 8 AND days.d - 2 AND px.av < days.dec GROUP BY 1),
s7 AS (SELECT days.d, px.m, avg(price) AS mean FROM days JOIN px ON px.d BETWEEN days.d - 8 AND days.d - 2 AND px.av < days.dec GROUP BY 1, 2),
b28 AS (SELECT days.d, avg(e) AS bias FROM days JOIN er ON er.d BETWEEN days.d - 29 AND days.d - 2 AND er.av < days.dec GROUP BY 1),
lp AS (SELECT days.d, px.price FROM days ASOF LEFT JOIN px ON days.dec > px.av),
ff AS (
  SELECT p.target_time, p.d AS settlement_date, p.settlement_period AS f_settlement_period, p.m AS f_minute_of_day, (isodow({_local("p.target_time")}) - 1)::INTEGER AS f_day_of_week,
    (isodow({_local("p.target_time")}) >= 6)::INTEGER AS f_is_weekend, month({_local("p.target_time")})::INTEGER AS f_month, round(wind, 6) AS f_wind_forecast_mw, round(wind / 500.0, 6) AS f_wind_forecast_share,
    round(demand, 6) AS f_demand_forecast_mw, round(demand - wind, 6) AS f_residual_demand_mw, round(p2.price, 6) AS f_price_d2_same_time, round(p7.price, 6) AS f_price_d7_same_time,
    round(s7.mean, 6) AS f_price_7d_same_time_mean, round(d2.mean, 6) AS f_price_d2_mean, round(d2.spread, 6) AS f_price_d2_spread, round(w7.mean, 6) AS f_price_7d_mean, round(w7.std, 6) AS f_price_7d_std,
    round(lp.price, 6) AS f_last_known_price, round(e2.e, 6) AS f_wind_err_d2, round(b28.bias, 6) AS f_wind_bias_28d, round(e2.e - b28.bias, 6) AS f_wind_err_d2_demeaned
  FROM pit p LEFT JOIN px p2 ON p2.d = p.d - 2 AND p2.m = p.m AND p2.av < p.dec LEFT JOIN px p7 ON p7.d = p.d - 7 AND p7.m = p.m AND p7.av < p.dec
    LEFT JOIN pd d2 ON d2.d = p.d - 2 AND d2.av < p.dec LEFT JOIN er e2 ON e2.d = p.d - 2 AND e2.av < p.dec LEFT JOIN w7 ON w7.d = p.d LEFT JOIN s7 ON s7.d = p.d AND s7.m = p.m LEFT JOIN b28 ON b28.d = p.d LEFT JOIN lp ON lp.d = p.d
)"""


def _boot(name: str, source: str, values: list[str], seed: int, reps: int = 2000, block: int = 7) -> str:
    """CTEs of bootstrap sums over ``source(day, values)``: ``name(rep, n, values)``."""
    pre = ", ".join(f"sum({v}) OVER (ORDER BY day) AS {v}" for v in values)
    zero = ", ".join("0.0" for _ in values)
    sums = ", ".join(f"sum(e.{v} - a.{v} + CASE WHEN x.e > x.n THEN z.{v} ELSE 0 END) AS {v}" for v in values)
    return f"""{name}_p AS (SELECT row_number() OVER (ORDER BY day) AS i, {pre} FROM {source} UNION ALL SELECT 0, {zero}),
{name}_d AS (
  SELECT rep, n, s AS a, s + least({block}, n - blk * {block}) AS e
  FROM (SELECT rep, blk, n, ((rep * 7919 + blk * 104729 + {seed * 1299709}) % 2147483647) % n AS s FROM range({reps}) r(rep), (SELECT count(*) AS n FROM {source}) c, LATERAL (SELECT unnest(range((n + {block - 1}) // {block})) AS blk))
),
{name} AS (
  SELECT x.rep, any_value(x.n) AS n, {sums} FROM {name}_d x JOIN {name}_p a ON a.i = x.a JOIN {name}_p e ON e.i = CASE WHEN x.e > x.n THEN x.e - x.n ELSE x.e END JOIN {name}_p z ON z.i = x.n GROUP BY x.rep
)"""


def _checks(ctes: str, source: str, checks: dict[str, str], digits: int | None, kind: str = "DOUBLE") -> str:
    value = f"round(({{}})::DOUBLE, {digits})" if digits is not None else f"({{}})::{kind}"
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {value.format(v)} AS value FROM {source}" for k, v in checks.items())


def _providers() -> dict[str, str]:
    out = {"rows": "count(*)"}
    for p in ("click", "view"):
        total = "(coalesce(sum(click_volume), 0) + coalesce(sum(view_volume), 0))"
        out |= {f"{p}_price_missing": f"count(*) FILTER ({p}_price IS NULL)", f"{p}_price_negative": f"count(*) FILTER ({p}_price < 0)", f"{p}_price_min": f"min({p}_price)", f"{p}_price_max": f"max({p}_price)", f"{p}_price_mean": f"avg({p}_price)", f"{p}_price_volume_share": f"100 * sum({p}_volume) / {total}"}
    return out


_D = "click_price - view_price"
_SCEN = "sn AS (SELECT * FROM (VALUES (0, 2.0, 0.9, 0.0, 2.0, 1.0, 0.0), (1, 2.0, 0.9, 0.0, 2.0, 1.0, 20.0), (2, 1.0, 0.8, 0.1, 0.9, 0.5, 0.0)) v(scenario, energy, rt, lo, hi, start, wear))"
CLOCKED = f"""{G}, gd AS (SELECT t, {_local("t")}::DATE AS settlement_date, price FROM g), gp AS (SELECT t, settlement_date, coalesce(price, floor(sum(round(price * 100)::BIGINT) OVER w / count(price) OVER w) / 100.0) AS p FROM gd WINDOW w AS (PARTITION BY settlement_date)),
gn AS (SELECT *, row_number() OVER (PARTITION BY settlement_date ORDER BY t) AS i, count(*) OVER (PARTITION BY settlement_date) AS n FROM gp),
{_SCEN},
cp AS (SELECT gn.*, sn.*, CASE WHEN i <= 4 THEN 0.5 WHEN i > n - 4 THEN -0.5 * rt ELSE 0.0 END::DOUBLE AS mw FROM gn, sn WHERE n = {_periods("settlement_date")})"""

SQL: dict[str, str] = {
    "asof_purchase_view": "SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts",
    "asof_latest_error": "SELECT p.event_id, v.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') v ON p.ts > v.ts",
    "asof_tie_boundary": "SELECT o.o_orderkey, o.o_custkey, l.prev_key FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS prev_key FROM orders GROUP BY 1, 2) l ON o.o_custkey = l.o_custkey AND o.o_orderdate > l.o_orderdate",
    "too_late_counts": "SELECT count(*) AS n_late, count(DISTINCT p.event_id) AS n_rows_late FROM events p JOIN events v ON p.event_type = 'purchase' AND v.event_type = 'view' AND p.user_id = v.user_id AND p.ts::DATE = v.ts::DATE AND v.ts >= p.ts",
    "grid_periods_per_day": f"SELECT d AS settlement_date, {_periods('d')}::BIGINT AS n_periods, {_periods('d')} AS last_period, {_periods('d')} AS expected FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)",
    "labels_roundtrip": f"SELECT o_orderkey, {_local('t')}::DATE AS settlement_date, {_period('t')} AS settlement_period, t AS back FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 48) * INTERVAL 30 MINUTE AS t FROM orders)",
    "decision_times": f"SELECT d AS settlement_date, {_utc('d - 1 + INTERVAL 11 HOUR')} AS decision_time FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)",
    "calendar_keys": f"WITH {G} SELECT t AS target_time, {_local('t')}::DATE AS local_date, (hour({_local('t')}) * 60 + minute({_local('t')}))::INTEGER AS minute_of_day, (isodow({_local('t')}) - 1)::INTEGER AS day_of_week, month({_local('t')})::INTEGER AS month, row_number() OVER (PARTITION BY {_local('t')} ORDER BY t) = 1 AS first_occurrence FROM g",
    "resolved_publication": f"SELECT event_id, CASE WHEN ts < {_utc('day')} THEN ts ELSE {_utc('day - 1 + INTERVAL 9 HOUR')} END AS published_at, CASE WHEN ts < {_utc('day')} THEN 'archive' ELSE 'schedule' END AS published_at_source, NOT (ts < {_utc('day')}) AS published_at_suspect FROM (SELECT event_id, ts, ts::DATE + (event_id % 3 - 1)::INTEGER AS day FROM events)",
    "halfhour_series": f"WITH {G} SELECT t, price, volume FROM g",
    "grid_gaps": f"WITH {THIN} SELECT t, CASE WHEN p IS NULL THEN count(*) FILTER (p IS NULL) OVER (PARTITION BY b) ELSE 0 END AS gap FROM (SELECT *, count(p) OVER (ORDER BY t) AS b FROM x)",
    "fill_short_gaps": f"WITH {THIN}, {FILL} SELECT t, round(CASE WHEN short THEN line ELSE p END, 6) AS price, short AS price_interpolated FROM f",
    "stuck_runs": f"WITH {STEPPED}, r AS (SELECT *, sum(CASE WHEN coalesce(l <> x, true) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS run FROM (SELECT *, lag(x) OVER (ORDER BY t) AS l FROM x)) SELECT t, x IS NOT NULL AND count(*) OVER (PARTITION BY run) >= 2 AS stuck FROM r",
    "zero_runs": f"WITH {STEPPED}, z AS (SELECT t, coalesce(x <= 100, false) AS z FROM x), r AS (SELECT *, sum(CASE WHEN coalesce(l <> z, true) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS run FROM (SELECT *, lag(z) OVER (ORDER BY t) AS l FROM z)) SELECT t, z AND count(*) OVER (PARTITION BY run) >= 2 AS zero_run FROM r",
    "longest_run": f"WITH {STEPPED}, r AS (SELECT sum(CASE WHEN coalesce(l <> x, true) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS run FROM (SELECT *, lag(x) OVER (ORDER BY t) AS l FROM x WHERE x IS NOT NULL)) SELECT max(n) AS longest_run FROM (SELECT count(*) AS n FROM r GROUP BY run)",
    "row_jumps": f"WITH {G} SELECT t, round(abs(price - lag(price) OVER (ORDER BY t)), 6) AS jump_in, round(abs(lead(price) OVER (ORDER BY t) - price), 6) AS jump_out FROM g",
    "rolling_daily": f"WITH {DAYS} SELECT day, round(CASE WHEN count(*) OVER w >= 3 THEN avg(total) OVER w END, 4) AS rolling_mean, round(sum(total) OVER (ORDER BY day), 2) AS cumulative FROM od WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "default_vs_traded": f"WITH {G} SELECT t, coalesce(abs(p) <= 1e-9 AND volume < 6, false) AS defaulted, coalesce(abs(p) > 1e-9 AND volume < 6, false) AS anomaly, coalesce(p < 50 OR p > 400, false) AS out_of_band FROM (SELECT *, CASE WHEN price < 150 THEN 0.0 ELSE price END AS p FROM g)",
    "clean_pass": f"WITH {CLEAN} SELECT t, round(price, 6) AS price, defaulted AS price_defaulted, oob AS price_out_of_band, stuck AS price_stuck, interpolated AS price_interpolated, settlement_date, settlement_period, period_usable, day_complete, day_usable FROM cl",
    "day_usability": f"WITH {CLEAN} SELECT settlement_date, count(*) AS observed, {_periods('settlement_date')} AS expected, any_value(day_complete) AS day_complete, any_value(day_usable) AS day_usable FROM cl GROUP BY settlement_date",
    "quality_report": _checks(CLEAN, "cl", {"rows_out": "count(*)", "price_missing": "count(*) FILTER (price IS NULL)", "price_interpolated": "count(*) FILTER (interpolated)", "price_out_of_band": "count(*) FILTER (oob)", "price_stuck": "count(*) FILTER (stuck)", "price_defaulted": "count(*) FILTER (defaulted)", "price_liquidity_anomaly": "count(*) FILTER (anomaly)", "days_total": "count(DISTINCT settlement_date)", "days_incomplete": "count(DISTINCT settlement_date) FILTER (NOT day_complete)", "days_unusable": "count(DISTINCT settlement_date) FILTER (NOT day_usable)", "rows_in": "any_value((SELECT count(*) FROM hh))", "duplicates": "any_value((SELECT count(*) - count(DISTINCT t) FROM hh))", "inserted": "count(*) - any_value((SELECT count(DISTINCT t) FROM hh))"}, None, "BIGINT"),
    "pivot_types": f"WITH {WIDE} SELECT * FROM w",
    "pivot_fuel_revisions": "WITH r AS (SELECT ts::DATE AS day, event_type, arg_max(value, ts) AS value, arg_max(event_id % 50 = 0, ts) AS moved, max(ts) AS ts FROM events GROUP BY 1, 2) "
    + "SELECT day, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS gen_{t}_mw" for t in TYPES) + ", bool_or(moved) AS rekeyed, min(ts) AS start_time FROM r GROUP BY 1",
    "vwap_types": f"WITH {WIDE} SELECT day, round(" + "(" + " + ".join(f"coalesce({t}_price * {t}_volume, 0)" for t in TYPES) + ") / (" + " + ".join(f"coalesce({t}_volume, 0)" for t in TYPES) + "), 6) AS vwap, " + " + ".join(f"coalesce({t}_volume, 0)" for t in TYPES) + " AS volume FROM w",
    "latest_revision": "SELECT user_id, ts::DATE AS day, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2",
    "first_event": "SELECT user_id, ts::DATE AS day, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1, 2",
    "lag_same_time": f"WITH {BASE} SELECT b.target_time, p2.price AS d2, p7.price AS d7 FROM base b LEFT JOIN px p2 ON p2.d = b.d - 2 AND p2.m = b.m AND p2.av < b.dec LEFT JOIN px p7 ON p7.d = b.d - 7 AND p7.m = b.m AND p7.av < b.dec",
    "lag_day_stats": f"WITH {BASE} SELECT b.target_time, round(pd.mean, 6) AS d2_mean, round(pd.spread, 6) AS d2_spread FROM base b LEFT JOIN pd ON pd.d = b.d - 2 AND pd.av < b.dec",
    "trailing_7d": f"WITH {BASE} SELECT days.d AS local_date, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, count(*) AS n FROM days JOIN px ON px.d BETWEEN days.d - 8 AND days.d - 2 AND px.av < days.dec GROUP BY 1",
    "trailing_28d_bias": f"WITH {BASE} SELECT days.d AS local_date, round(avg(mean - 250.0), 6) AS bias, count(*) AS n FROM days JOIN pd ON pd.d BETWEEN days.d - 29 AND days.d - 2 AND pd.av < days.dec GROUP BY 1",
    "last_known": f"WITH {BASE} SELECT days.d AS settlement_date, px.price AS last_price, px.source_time FROM days ASOF LEFT JOIN px ON days.dec > px.av",
    "point_in_time": f"WITH {MARKET} SELECT target_time, settlement_period, price_apx, wind AS wind_forecast_mw, wind_at AS wind_published_at, demand AS demand_forecast_mw FROM pit",
    "availability_check": f"WITH {MARKET} SELECT count(*) FILTER (wind_at >= dec) AS wind_published_at_late, round(min((floor(epoch(dec)) - floor(epoch(wind_at))) / 3600), 6) AS margin_hours FROM pit",
    "feature_frame": f"WITH {FEATURES} SELECT * EXCLUDE (settlement_date) FROM ff",
    "score_table": f"WITH {SCORED}, l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS forecast, {f} - actual AS e FROM mt" for f in ("naive_d2", "naive_d7", "mean_7d")) + "), s AS (SELECT forecast, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM l GROUP BY 1) SELECT forecast, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(1 - mae / (SELECT mae FROM s WHERE forecast = 'naive_d7'), 6) AS skill FROM s",
    "mae_by_hour": f"WITH {SCORED} SELECT (m // 60)::INTEGER AS hour, " + ", ".join(f"round(avg(abs({f} - actual)), 6) AS mae_{f}" for f in ("naive_d2", "naive_d7", "mean_7d")) + " FROM mt GROUP BY 1",
    "reliability": f"WITH {SCORED}, l AS (" + " UNION ALL ".join(f"SELECT '{q}' AS quantile, {v}::DOUBLE AS nominal, actual - {q} AS e FROM sc WHERE actual IS NOT NULL AND q50 IS NOT NULL" for q, v in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))) + ") SELECT quantile, nominal, round(avg((e <= 0)::INTEGER), 6) AS observed_share, round(avg(greatest(nominal * e, (nominal - 1) * e)), 6) AS pinball FROM l GROUP BY 1, 2",
    "coverage": f"WITH {SCORED} SELECT count(*) AS n, round(avg((actual BETWEEN q10 AND q90)::INTEGER), 6) AS coverage, round(avg(q90 - q10), 6) AS mean_width FROM sc WHERE actual IS NOT NULL AND q10 IS NOT NULL",
    "skill_window": f"WITH {SCORED}, k AS (SELECT *, mean_7d - actual AS e, {_period('target_time')} AS sp FROM sc WHERE actual IS NOT NULL AND mean_7d IS NOT NULL), s AS (SELECT count(DISTINCT d) AS days, count(*) AS periods, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, corr(mean_7d, actual) AS corr, avg(abs(e)) FILTER (sp <= 16) AS mae_early, avg(abs(e)) FILTER (sp >= 33) AS mae_late FROM k) SELECT days, periods, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(corr, 6) AS corr, round(mae_early, 6) AS mae_early, round(mae_late, 6) AS mae_late, round(mae_late / mae_early, 6) AS growth FROM s",
    "date_islands": f"WITH {DAYS}, b AS (SELECT day, day - (row_number() OVER (ORDER BY day))::INTEGER AS k FROM od WHERE n > (SELECT avg(n) FROM od)) SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM b GROUP BY k",
    "season_window": f"WITH {DAYS} SELECT year(day)::INTEGER AS year, count(*) AS days, round(sum(total), 2) AS total FROM od WHERE month(day) * 100 + day(day) BETWEEN 315 AND 610 GROUP BY 1",
    "block_bootstrap_ci": "WITH o AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS all_t, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END) AS even_t FROM orders GROUP BY 1), " + _boot("b", "o", ["even_t", "all_t"], 1) + " SELECT round(quantile_cont(even_t / all_t, 0.025), 6) AS lo, round(quantile_cont(even_t / all_t, 0.5), 6) AS median, round(quantile_cont(even_t / all_t, 0.975), 6) AS hi FROM b",
    "block_ratio_verdict": f"WITH {DAYS}, oa AS (SELECT day, total FROM od WHERE year(day) = 1996), ob AS (SELECT day, total FROM od WHERE year(day) = 1997), " + _boot("ba", "oa", ["total"], 1, 10_000) + ", " + _boot("bb", "ob", ["total"], 2, 10_000) + ", r AS (SELECT (ba.total / ba.n) / (bb.total / bb.n) AS x FROM ba JOIN bb USING (rep)), q AS (SELECT quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.975) AS hi FROM r) SELECT round(lo, 6) AS lo, round(median, 6) AS median, round(hi, 6) AS hi, CASE WHEN lo >= 0.8 THEN 'GENUINE' WHEN hi < 0.7 THEN 'REGENERATED' ELSE 'INCONCLUSIVE' END AS verdict FROM q",
    "trailing_thresholds": "WITH q AS (SELECT o_orderdate::DATE AS day, quantile_cont(o_totalprice, 0.25) AS l, quantile_cont(o_totalprice, 0.75) AS h FROM orders GROUP BY 1) SELECT day, round(avg(l) OVER w, 4) AS low, round(avg(h) OVER w, 4) AS high FROM q WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
    "realisable_spread": f"WITH {HH}, d AS (SELECT {_local('t')}::DATE AS day, price, row_number() OVER (PARTITION BY {_local('t')}::DATE ORDER BY price) AS u, row_number() OVER (PARTITION BY {_local('t')}::DATE ORDER BY price DESC) AS w FROM hh) SELECT day, k::INTEGER AS k, round(avg(price) FILTER (w <= k) - avg(price) FILTER (u <= k) / 0.9, 6) AS spread FROM d, (SELECT unnest([2, 4, 8]) AS k) GROUP BY 1, 2 HAVING count(*) >= 2 * k",
    "settle_schedule": f"WITH {CLOCKED}, s AS (SELECT settlement_date, scenario, any_value(rt) AS rt, any_value(wear) AS wear, any_value(hi - lo) AS usable, any_value(start) AS start, sum(greatest(mw, 0) * 0.5) AS imp, sum(greatest(-mw, 0) * 0.5) AS exp, sum(-p * mw * 0.5) AS rev FROM cp GROUP BY 1, 2) SELECT settlement_date, scenario, round(imp, 6) AS import_mwh, round(exp, 6) AS export_mwh, round(rev, 6) AS gross_revenue, round((wear * exp)::DOUBLE, 6) AS wear, round(rev - wear * exp, 6) AS net_revenue, round(exp / usable, 6) AS cycles, round((start + sqrt(rt) * imp - exp / sqrt(rt))::DOUBLE, 6) + 0.0 AS final_soc FROM s",
    "feasibility": f"WITH {CLOCKED}, q AS (SELECT *, start + sum(CASE WHEN mw > 0 THEN sqrt(rt) * mw * 0.5 ELSE mw * 0.5 / sqrt(rt) END) OVER (PARTITION BY settlement_date, scenario ORDER BY i) AS soc FROM cp) SELECT settlement_date, scenario, concat_ws('; ', CASE WHEN bool_or(abs(mw) > 1 + 1e-6) THEN 'power_high' END, CASE WHEN bool_or(soc < lo - 1e-6) THEN 'soc_low' END, CASE WHEN bool_or(soc > hi + 1e-6) THEN 'soc_high' END, CASE WHEN abs(arg_max(soc, i) - any_value(start)) > 1e-4 THEN 'soc_end' END) AS problems FROM q GROUP BY 1, 2",
    "monthly_rollup": f"WITH {DAYS} SELECT date_trunc('month', day)::DATE AS month, round(sum(total), 2) AS total, sum(n)::BIGINT AS n FROM od GROUP BY 1",
    "strategy_rollup": "WITH d AS (SELECT o_orderdate::DATE AS day, o_orderstatus AS strategy, sum(o_totalprice) AS r FROM orders GROUP BY 1, 2) SELECT s.strategy, s.year::INTEGER AS year, round(sum(r), 2) AS revenue, count(r) AS days FROM (SELECT DISTINCT strategy, y AS year FROM (SELECT DISTINCT strategy FROM d), (SELECT DISTINCT year(day) AS y FROM d) UNION ALL SELECT DISTINCT strategy, NULL FROM d) s LEFT JOIN d ON d.strategy = s.strategy AND (s.year IS NULL OR year(d.day) = s.year) GROUP BY 1, 2",
    "day_set_reconcile": "WITH a AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_totalprice > 300000), b AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_totalprice < 50000) SELECT count(*) FILTER (b.day IS NULL) AS left_only, count(*) FILTER (a.day IS NULL) AS right_only, count(*) FILTER (a.day IS NOT NULL AND b.day IS NOT NULL) AS both, min(coalesce(a.day, b.day)) AS first_day, max(coalesce(a.day, b.day)) AS last_day FROM a FULL JOIN b ON a.day = b.day",
    "provider_report": _checks(WIDE, "w", _providers(), 4),
    "provider_comparison": _checks(WIDE, "w", {"n_a": "count(click_price)", "n_b": "count(view_price)", "n_both": f"count({_D})", "corr": "corr(click_price, view_price)", "mean_diff": f"avg({_D})", "median_diff": f"quantile_cont({_D}, 0.5)", "mean_abs_diff": f"avg(abs({_D}))", "p95_abs_diff": f"quantile_cont(abs({_D}), 0.95)", "n_large": f"count(*) FILTER (abs({_D}) > 5)"} | {f"{p}_{k}": v.format(f"{p}") for p in ("click_price", "view_price", "click_volume", "view_volume") for k, v in (("median", "quantile_cont({}, 0.5)"), ("mean", "avg({})"), *((("max", "max({})"), ("total", "sum({})")) if p.endswith("volume") else ()))}, 4),
    "liquidity_report": _checks(f"{G}, z AS (SELECT CASE WHEN price < 150 THEN 0.0 ELSE price END AS p, volume AS v FROM g)", "z", {"rows": "count(*)", "zero_prices": "count(*) FILTER (abs(p) <= 1e-9)", "defaulted": "count(*) FILTER (abs(p) <= 1e-9 AND v < 6)", "traded_zeros": "count(*) FILTER (abs(p) <= 1e-9 AND v >= 6)", "zero_without_volume": "count(*) FILTER (abs(p) <= 1e-9 AND v IS NULL)", "anomalies": "count(*) FILTER (abs(p) > 1e-9 AND v < 6)"}, None),
    "vintage_timeliness": f"WITH v AS (SELECT ts, ts::DATE + (event_id % 3)::INTEGER AS day FROM events WHERE event_type = 'view'), l AS (SELECT day, ts < {_utc('day')} AS ok, (epoch({_utc('day')}) - floor(epoch(ts))) / 3600 AS lead FROM v) SELECT year(day)::INTEGER AS year, count(*) AS rows, count(*) FILTER (NOT ok) AS late_or_missing, round(quantile_cont(lead, 0.5) FILTER (ok), 6) AS median_lead, round(min(lead) FILTER (ok), 6) AS min_lead FROM l GROUP BY 1",
    "timezone_evidence": f"WITH s AS (SELECT t, (hour({_local('t')}) + minute({_local('t')}) / 60)::DOUBLE AS u, (hour(t) + minute(t) / 60)::DOUBLE AS l, month(t) IN (12, 1, 2) AS w, month(t) IN (6, 7, 8) AS s FROM (SELECT o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS t FROM orders)) SELECT quantile_cont(u, 0.5) FILTER (w) AS as_utc_winter, quantile_cont(u, 0.5) FILTER (s) AS as_utc_summer, quantile_cont(l, 0.5) FILTER (w) AS as_local_winter, quantile_cont(l, 0.5) FILTER (s) AS as_local_summer FROM s",
    "day_coverage": f"WITH {HH}, d AS (SELECT {_local('t')}::DATE AS day, count(*) AS n FROM hh GROUP BY 1) SELECT n, {_periods('day')} AS expected, count(*) AS days FROM d GROUP BY 1, 2",
    "price_range": f"WITH {HH}, d AS (SELECT {_local('t')}::DATE AS day, max(price) - min(price) AS r FROM hh GROUP BY 1) SELECT round(avg(r), 6) AS mean_range, round(quantile_cont(r, 0.5), 6) AS median_range, arg_max(day, r) AS widest_day, arg_min(day, r) AS narrowest_day FROM d",
    "rekeyed_labels": f"WITH {G} SELECT t, {_local('t')}::DATE AS settlement_date, {_period('t')} AS settlement_period, (epoch(t)::BIGINT // 1800) % 97 IN (5, 6) AS moved FROM g",
}
SQL["missing_shares"] = f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(({f} IS NULL)::INTEGER), 6) AS missing_share, min(settlement_date) FILTER ({f} IS NOT NULL) AS first_day FROM ff" for f in REGISTER.features)
SQL["threshold_dispatch"] = f"""
WITH RECURSIVE {CLOCKED},
q AS (SELECT settlement_date, quantile_cont(price, 0.25) AS l, quantile_cont(price, 0.75) AS h FROM gd WHERE price IS NOT NULL GROUP BY 1),
th AS (SELECT settlement_date, avg(l) OVER w AS low, avg(h) OVER w AS high FROM q WINDOW w AS (ORDER BY settlement_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
cx AS (SELECT settlement_date, scenario, i, p, low, high, sqrt(rt)::DOUBLE AS eta, lo::DOUBLE AS lo, hi::DOUBLE AS hi, start::DOUBLE AS start, wear::DOUBLE AS wear FROM cp JOIN th USING (settlement_date) WHERE low IS NOT NULL),
st AS (
  SELECT settlement_date, scenario, 0::BIGINT AS i, start AS soc, 0.0::DOUBLE AS imp, 0.0::DOUBLE AS exp, 0.0::DOUBLE AS rev FROM cx WHERE i = 1
  UNION ALL
  SELECT settlement_date, scenario, i, soc + CASE WHEN mw > 0 THEN eta * mw * 0.5::DOUBLE ELSE mw * 0.5::DOUBLE / eta END, imp + greatest(mw, 0) * 0.5::DOUBLE, exp + greatest(-mw, 0) * 0.5::DOUBLE, rev - p * mw * 0.5::DOUBLE
  FROM (
    SELECT cx.*, st.soc, st.imp, st.exp, st.rev,
      CASE WHEN p <= low THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (hi - soc) / (eta * 0.5::DOUBLE))) WHEN p >= high THEN -greatest(0.0::DOUBLE, least(1.0::DOUBLE, (soc - lo) * eta / 0.5::DOUBLE)) ELSE 0.0::DOUBLE END AS mw
    FROM st JOIN cx ON cx.settlement_date = st.settlement_date AND cx.scenario = st.scenario AND cx.i = st.i + 1)
), fin AS (
  SELECT st.*, k.eta, k.start, k.wear, k.usable, k.mean, k.start + k.eta * imp - exp / k.eta AS final_soc
  FROM st JOIN (SELECT settlement_date, scenario, max(i) AS n, any_value(eta) AS eta, any_value(start) AS start, any_value(wear) AS wear, any_value(hi - lo) AS usable, avg(p) AS mean FROM cx GROUP BY 1, 2) k
    ON k.settlement_date = st.settlement_date AND k.scenario = st.scenario AND k.n = st.i
)
SELECT settlement_date, scenario, round(imp, 6) AS import_mwh, round(exp, 6) AS export_mwh, round(rev, 6) AS gross_revenue, round(wear * exp, 6) AS wear, round(rev - wear * exp, 6) AS net_revenue,
  round(exp / usable, 6) AS cycles, round(final_soc, 6) + 0.0 AS final_soc, round(final_soc - start, 6) + 0.0 AS residual_mwh, round(rev + (final_soc - start) * mean, 6) AS marked_revenue
FROM fin
"""
SQL["asof_bucketed"] = SQL["asof_purchase_view"]

# The audit once more: features by range joins and correlated aggregates against those of the frame, and least margins of what they use.
_BY_MARGIN = {
    "NULL": ["f_settlement_period", "f_minute_of_day", "f_day_of_week", "f_is_weekend", "f_month"], "mw": ["f_wind_forecast_mw", "f_wind_forecast_share"], "md": ["f_demand_forecast_mw"], "mb": ["f_residual_demand_mw"],
    "mp": [f for f in REGISTER.features if f.startswith("f_price")], "ml": ["f_last_known_price"], "me": ["f_wind_err_d2", "f_wind_bias_28d", "f_wind_err_d2_demeaned"],
}
_AGAIN = {
    "f_settlement_period": "p.settlement_period", "f_minute_of_day": "p.m", "f_day_of_week": f"(dayofweek({_local('p.target_time')}) + 6) % 7", "f_is_weekend": f"(dayofweek({_local('p.target_time')}) IN (0, 6))::INTEGER", "f_month": f"strftime({_local('p.target_time')}, '%m')::INTEGER",
    "f_wind_forecast_mw": "(SELECT arg_max(value, published_at) FROM vw WHERE vw.target_time = p.target_time AND published_at < p.dec)", "f_wind_forecast_share": "(SELECT arg_max(value, published_at) FROM vw WHERE vw.target_time = p.target_time AND published_at < p.dec) / 500.0",
    "f_demand_forecast_mw": "(SELECT arg_max(value, published_at) FROM ck WHERE ck.target_time = p.target_time AND published_at < p.dec)", "f_residual_demand_mw": "p.demand - p.wind",
    "f_price_d2_same_time": "w.x2", "f_price_d7_same_time": "w.x7", "f_price_7d_same_time_mean": "w.x", "f_price_d2_mean": "z.mean2", "f_price_d2_spread": "z.spread2", "f_price_7d_mean": "z.mean", "f_price_7d_std": "z.std", "f_last_known_price": "l.x",
    "f_wind_err_d2": "er2.e2", "f_wind_bias_28d": "er2.bias", "f_wind_err_d2_demeaned": "er2.e2 - er2.bias",
}
SQL["availability_audit"] = f"""WITH {FEATURES},
pj AS (SELECT days.d, days.dec, px.d AS sd, px.m, px.price, px.av, px.av < days.dec AS ok FROM days JOIN px ON days.d - px.d BETWEEN 2 AND 8),
z AS (SELECT d, avg(price) FILTER (ok) AS mean, stddev_samp(price) FILTER (ok) AS std, CASE WHEN bool_and(ok) FILTER (d - sd = 2) THEN avg(price) FILTER (d - sd = 2) END AS mean2, CASE WHEN bool_and(ok) FILTER (d - sd = 2) THEN max(price) FILTER (d - sd = 2) - min(price) FILTER (d - sd = 2) END AS spread2,
  min(epoch(dec) - epoch(av)) FILTER (ok) / 3600 AS margin FROM pj GROUP BY d),
w AS (SELECT d, m, avg(price) AS x, max(price) FILTER (d - sd = 2) AS x2, max(price) FILTER (d - sd = 7) AS x7 FROM pj WHERE ok GROUP BY d, m),
l AS (SELECT days.d, arg_max(px.price, px.av) AS x, (epoch(any_value(days.dec)) - epoch(max(px.av))) / 3600 AS margin FROM days JOIN px ON px.av < days.dec GROUP BY days.d),
er2 AS (SELECT days.d, avg(e) FILTER (days.d - er.d = 2) AS e2, avg(e) AS bias, min(epoch(dec) - epoch(av)) / 3600 AS margin FROM days JOIN er ON days.d - er.d BETWEEN 2 AND 29 AND er.av < days.dec GROUP BY days.d),
mg AS (SELECT (SELECT min(margin) FROM z) AS mp, (SELECT min(margin) FROM l) AS ml, (SELECT min(margin) FROM er2) AS me,
  (SELECT min(floor(epoch(dec)) - floor(epoch(published_at))) / 3600 FROM vw JOIN tg USING (target_time) WHERE published_at < dec) AS mw, (SELECT min(floor(epoch(dec)) - floor(epoch(published_at))) / 3600 FROM ck JOIN tg USING (target_time) WHERE published_at < dec) AS md,
  (SELECT min(least(a, b)) FROM (SELECT target_time, min(floor(epoch(dec)) - floor(epoch(published_at))) / 3600 AS a FROM vw JOIN tg USING (target_time) WHERE published_at < dec GROUP BY 1) FULL JOIN (SELECT target_time, min(floor(epoch(dec)) - floor(epoch(published_at))) / 3600 AS b FROM ck JOIN tg USING (target_time) WHERE published_at < dec GROUP BY 1) USING (target_time)) AS mb),
df AS (SELECT count(*) AS rows, {", ".join(f"count(*) FILTER (NOT coalesce(abs(ff.{k} - ({v})) <= 2e-6 * greatest(1, abs(ff.{k})), ff.{k} IS NULL AND ({v}) IS NULL)) AS {k}" for k, v in _AGAIN.items())}
  FROM ff JOIN pit p USING (target_time) LEFT JOIN z ON z.d = p.d LEFT JOIN w ON w.d = p.d AND w.m = p.m LEFT JOIN l ON l.d = p.d LEFT JOIN er2 ON er2.d = p.d)
SELECT rows, feature, mismatches, round(margin, 6) AS least_margin_hours, CASE WHEN mismatches = 0 AND coalesce(margin > 0, true) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({" UNION ALL ".join(f"SELECT rows, '{f}' AS feature, {f} AS mismatches, ({k})::DOUBLE AS margin FROM df, mg" for k, fs in _BY_MARGIN.items() for f in fs)})"""
_EVEN = "o AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS all_t, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END) AS even_t, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS o_t, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS f_t FROM orders GROUP BY 1)"
_BOUNDS = "SELECT round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.975), 6) AS hi FROM ({})"
SQL["skill_interval"] = f"WITH {_EVEN}, " + _boot("b", "o", ["even_t", "all_t"], 1) + " " + _BOUNDS.format("SELECT 1 - even_t / all_t AS x FROM b")
SQL["paired_capture"] = f"WITH {_EVEN}, " + _boot("b", "o", ["o_t", "f_t", "all_t"], 1) + " " + _BOUNDS.format("SELECT (o_t - f_t) / all_t AS x FROM b")
_NETS = "o AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS all_net, count(*) AS all_mwh, " + ", ".join(f"sum(CASE WHEN o_orderstatus = '{k}' THEN o_totalprice ELSE 0 END) - 150000.0::DOUBLE AS {k}_net, count(*) FILTER (o_orderstatus = '{k}') AS {k}_mwh" for k in "FOP") + " FROM orders GROUP BY 1), c AS (SELECT * FROM o WHERE dayofweek(day) <> 0)"
SQL["strategy_table"] = f"WITH {_NETS}, " + ", ".join(_boot(f"b{x}", x, ["all_net", "F_net", "O_net", "P_net"], 1) for x in "oc") + " " + " UNION ALL ".join(
    f"SELECT '{p}' AS period, '{k}' AS strategy, count(*) AS days, round(sum({k}_net) / 2.0::DOUBLE / (count(*) / 365.25::DOUBLE), 2) AS per_mw_year, round(sum({k}_mwh) / 4.0::DOUBLE / (count(*) / 365.25::DOUBLE), 4) AS cycles_year, count(*) FILTER ({k}_net < -1e-6) AS loss_days, round(sum({k}_net) / sum(all_net), 6) AS capture, "
    + ("NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high" if k == "all" else ", ".join(f"(SELECT round(quantile_cont({k}_net / all_net, {q}), 6) FROM b{x}) AS {n}" for n, q in (("ci_low", 0.025), ("ci_high", 0.975))))
    + f" FROM {x}"
    for x, p in (("o", "all"), ("c", "clean")) for k in ("all", "F", "O", "P")
)
_MOVED = f"{G}, m AS (SELECT price, (epoch(t)::BIGINT // 1800) % 97 AS k, abs(price - lag(price) OVER (ORDER BY t)) AS ji, abs(lead(price) OVER (ORDER BY t) - price) AS jo FROM g)"
SQL["outturn_report"] = _checks(_MOVED, "m", {"rows": "count(*)", "moved": "count(*) FILTER (k IN (5, 6))", "starts": "count(*) FILTER (k <> 7)", "starts_agree": "count(*) FILTER (k <> 7)", "gen_wind_mw_missing": "count(*) FILTER (price IS NULL)", "jump_into_moved": "avg(ji) FILTER (k IN (5, 6))", "jump_out_of_moved": "avg(jo) FILTER (k IN (5, 6))", "jump_elsewhere": "avg(ji) FILTER (k NOT IN (5, 6))"}, 4)
SQL["range_window"] =f"WITH {DAYS} SELECT day, round(avg(total) OVER (ORDER BY day RANGE BETWEEN INTERVAL 8 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING), 4) AS trailing_mean FROM od"
SQL["lead_summary"] = "WITH e AS (SELECT event_type, event_id % 2 = 1 AS odd, (epoch(time_bucket(INTERVAL 30 MINUTE, ts)) + 172800 + event_id % 5 * 3600 - floor(epoch(ts))) / 3600 AS lead FROM events WHERE event_type IN ('view', 'click')) SELECT event_type, count(*) AS rows, round(min(lead), 6) AS min_lead, round(quantile_cont(lead, 0.5), 6) AS median_lead, round(max(lead), 6) AS max_lead, count(*) FILTER (odd) AS suspect FROM e GROUP BY 1"
SQL["worst_days"] = f"WITH {G} SELECT {_local('t')}::DATE AS day, count(*) FILTER (coalesce(price < 150 AND volume < 6, false)) AS n_defaulted FROM g GROUP BY 1 HAVING count(*) FILTER (coalesce(price < 150 AND volume < 6, false)) > 0 ORDER BY 2 DESC, 1 LIMIT 10"
SQL["vintage_build"] = f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS stamp, value, ts + (event_id % 4) * INTERVAL 12 HOUR AS tg FROM events WHERE event_type = 'view'),
r AS (SELECT *, {_local('tg')}::DATE AS d, {_period('tg')} AS n FROM e),
p AS (SELECT *, stamp < {_utc('d')} AS ok, CASE WHEN stamp < {_utc('d')} THEN stamp ELSE {_utc('d - 1 + INTERVAL 9 HOUR')} END AS published_at FROM r),
u AS (SELECT *, row_number() OVER (PARTITION BY d, n, published_at ORDER BY event_id DESC) AS k FROM p)
SELECT {_utc('d')} + (n - 1) * INTERVAL 30 MINUTE AS target_time, d AS settlement_date, n AS settlement_period, published_at, CASE WHEN ok THEN 'archive' ELSE 'schedule' END AS published_at_source, NOT ok AS published_at_suspect, value AS forecast
FROM u WHERE k = 1 AND d > (SELECT min(d) FROM r) AND d < (SELECT max(d) FROM r)"""
SQL["outside_grid"] = f"WITH {HH} SELECT t, price FROM hh WHERE {_local('t')}::DATE > (SELECT min({_local('t')}::DATE) FROM hh) + 9"
SQL["grid_with_data"] = f"WITH {HH}, d AS (SELECT DISTINCT {_local('t')}::DATE AS day FROM hh), q AS (SELECT day, {_utc('day')} + (i - 1) * INTERVAL 30 MINUTE AS target_time, i::INTEGER AS i FROM (SELECT day, unnest(range(1, {_periods('day')} + 1)) AS i FROM d)) SELECT q.target_time, day AS settlement_date, i AS settlement_period, volume FROM q LEFT JOIN hh ON hh.t = q.target_time"
SQL["matched_days"] = f"WITH {SCORED} SELECT d AS settlement_date, bool_and(actual IS NOT NULL AND naive_d2 IS NOT NULL AND mean_7d IS NOT NULL) AND count(*) = {_periods('d')} AS matched FROM sc GROUP BY d"
_CLEANED = [
    ("t", "t", "timestamp_ntz"), ("price", "round(price, 6)", "double"), ("price_defaulted", "defaulted", "boolean"), ("price_out_of_band", "oob", "boolean"), ("price_stuck", "stuck", "boolean"),
    ("price_interpolated", "interpolated", "boolean"), ("settlement_date", "settlement_date", "date"), ("settlement_period", "settlement_period", "int"), ("period_usable", "period_usable", "boolean"),
    ("day_complete", "day_complete", "boolean"), ("day_usable", "day_usable", "boolean"),
]
SQL["described_events"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS rows, count(*) FILTER ({x} IS NULL) AS nulls, min({x})::VARCHAR AS least, max({x})::VARCHAR AS greatest FROM cl" for c, x, k in _CLEANED
)

# The audit of suspect days: a frame of orders, its longest busy run of 1996, the windows, and draws of their days.
AUDITED = f"""ao AS (SELECT o_orderdate::DATE AS day, (o_orderkey % 48 + 1)::INTEGER AS period, round(o_totalprice * 100)::BIGINT AS c FROM orders),
ad AS (SELECT day, floor(sum(c) / count(*)) / 100.0 AS forecast, count(*) AS n FROM ao GROUP BY day),
af AS (
  SELECT ao.day, period, CASE WHEN period % 11 <> 0 THEN any_value(forecast) END AS forecast, floor(sum(c) / count(*)) / 100.0 AS actual, any_value(n) > (SELECT avg(n) FROM ad) AS suspect
  FROM ao JOIN ad ON ao.day = ad.day GROUP BY ao.day, period
),
ae AS (SELECT *, (forecast - actual) / 500000.0::DOUBLE AS e FROM af WHERE forecast IS NOT NULL),
ar AS (SELECT min(day) AS a, max(day) AS b, count(*) AS n FROM (SELECT day, day - row_number() OVER (ORDER BY day)::INTEGER AS g FROM (SELECT DISTINCT day FROM ae WHERE suspect AND year(day) = 1996)) GROUP BY g),
ab AS (SELECT * FROM ar ORDER BY n DESC, a LIMIT 1),
aw AS (
  SELECT ae.*, CASE WHEN s AND year(day) = 1996 THEN 'block' WHEN s AND year(day) IN (1995, 1997) THEN 'control ' || year(day) WHEN year(day) = 1996 AND NOT suspect THEN 'outside' END AS "window"
  FROM (SELECT ae.*, month(day) * 100 + day(day) BETWEEN month(a) * 100 + day(a) AND month(b) * 100 + day(b) AS s FROM ae, ab) ae
)"""
SQL["suspect_block"] = f"""WITH {AUDITED} SELECT count(*) AS rows, count(*) FILTER (day + (period - 1) * INTERVAL 30 MINUTE = {_utc("day")} + (period - 1) * INTERVAL 30 MINUTE AND period <= {_periods("day")}) AS starts_agree,
  count(*) FILTER (forecast IS NULL) AS dropped, any_value(a) AS first_day, any_value(b) AS last_day, any_value(ab.n) AS n_days FROM af, ab"""
SQL["suspect_block_windows"] = f"""WITH {AUDITED}, x AS (
  SELECT "window", count(DISTINCT day) AS days, count(*) AS periods, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, CASE WHEN stddev_pop(forecast) > 0 AND stddev_pop(actual) > 0 THEN corr(forecast, actual) END AS corr,
    avg(abs(e)) FILTER (period <= 16) AS mae_early, avg(abs(e)) FILTER (period >= 33) AS mae_late FROM aw WHERE "window" IS NOT NULL GROUP BY 1
) SELECT "window", days, periods, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("mae", "rmse", "bias", "corr", "mae_early", "mae_late"))}, round(CASE WHEN mae_early > 0 THEN mae_late / mae_early END, 6) AS growth FROM x"""
_SAMPLES = {"block": "\"window\" = 'block'", "controls": "\"window\" LIKE 'control %'", "control 1995": "\"window\" = 'control 1995'", "control 1997": "\"window\" = 'control 1997'"}
_DAILY = ", ".join(f"s{i} AS (SELECT day, avg(abs(e)) AS v FROM aw WHERE {w} GROUP BY day)" for i, w in enumerate(_SAMPLES.values()))
_DRAWN = ", ".join(_boot(f"b{i}", f"s{i}", ["v"], i + 1) for i in range(4))
SQL["suspect_block_ratios"] = f"WITH {AUDITED}, {_DAILY}, {_DRAWN}, " + f"""x AS (
  SELECT 'block / controls' AS pair, b0.v / b0.n / (b1.v / b1.n) AS r, (SELECT avg(v) FROM s0) / (SELECT avg(v) FROM s1) AS ratio FROM b0 JOIN b1 USING (rep)
  UNION ALL SELECT 'control 1995 / control 1997', b2.v / b2.n / (b3.v / b3.n), (SELECT avg(v) FROM s2) / (SELECT avg(v) FROM s3) FROM b2 JOIN b3 USING (rep)
), y AS (SELECT pair, any_value(ratio) AS ratio, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM x GROUP BY pair)
SELECT pair, round(ratio, 6) AS ratio, round(lo, 6) AS lo, round(hi, 6) AS hi,
  CASE WHEN pair = 'block / controls' THEN CASE WHEN lo >= 0.8 THEN 'GENUINE' WHEN hi < 0.7 THEN 'REGENERATED' ELSE 'INCONCLUSIVE' END END AS verdict FROM y"""
SQL["shared_days"] = """WITH o AS (SELECT o_orderdate::DATE AS day, o_totalprice AS p FROM orders), a AS (SELECT * FROM o WHERE p > 200000), b AS (SELECT * FROM o WHERE p < 100000),
x AS (SELECT DISTINCT day FROM a WHERE day NOT IN (SELECT day FROM b))
SELECT count(DISTINCT a.day) AS large_days, round(sum(p), 2) AS large_total, (SELECT count(DISTINCT day) FROM b WHERE day IN (SELECT day FROM a)) AS small_days,
  (SELECT round(sum(p), 2) FROM b WHERE day IN (SELECT day FROM a)) AS small_total, (SELECT count(*) FROM x) AS extra_days,
  (SELECT count(*) FROM x) = 1 AND (SELECT min(day) FROM x) = (SELECT min(day) FROM a) AS only_the_first
FROM a WHERE day IN (SELECT day FROM b)"""
SQL["spread_summary"] = f"""WITH {HH}, d AS (SELECT {_local("t")}::DATE AS day, price, row_number() OVER (PARTITION BY {_local("t")}::DATE ORDER BY price) AS u, row_number() OVER (PARTITION BY {_local("t")}::DATE ORDER BY price DESC) AS w FROM hh),
x AS (
  SELECT day, k, max(price) - min(price) AS range, avg(price) FILTER (w <= k) - avg(price) FILTER (u <= k) AS raw, avg(price) FILTER (w <= k) - avg(price) FILTER (u <= k) / 0.9 AS spread
  FROM d, (SELECT unnest([2, 4, 8]) AS k) GROUP BY 1, 2 HAVING count(*) >= 2 * k
) SELECT k::INTEGER AS k, count(*) AS days, round(avg(range), 6) AS mean_range, round(avg(raw), 6) AS mean_raw, round(avg(spread), 6) AS mean_spread, round(quantile_cont(spread, 0.5), 6) AS median_spread,
  count(*) FILTER (spread <= 0) AS days_not_positive, round(100 * avg(spread) / avg(range), 6) AS percent_of_range FROM x GROUP BY k"""
SQL["single_day"] = f"WITH {CLOCKED} SELECT settlement_date, (row_number() OVER (ORDER BY t) - 1)::INTEGER AS i, p AS price FROM gp WHERE settlement_date = DATE '2024-01-10'"
SQL["scenario_pivot"] = f"""WITH {CLOCKED}, s AS (SELECT energy::DOUBLE AS duration_h, rt, round(sum(-p * mw * 0.5), 4) AS revenue FROM cp GROUP BY 1, 2)
SELECT duration_h, max(revenue) FILTER (rt = 0.8) AS at_80, max(revenue) FILTER (rt = 0.9) AS at_90 FROM s GROUP BY 1"""
