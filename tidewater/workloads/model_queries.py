"""Forecasters, tuning and sweeps over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewater.forecast import ar, es, linear, ma, trees, trend
from tidewater.forecast.rollout import recursive_rollout
from tidewater.operators import ranking as r
from tidewater.operators.metrics import evaluate
from tidewater.operators.positions import SERIES, TS
from tidewater.plans import sweep, tuning
from tidewater.workloads import panels as p
from tidewater.workloads import sql
from tidewater.workloads.base import held_split_of, rounded
from tidewater.workloads.score_queries import _BASE, _MA_GRID, suppliers, tidy

QUERIES, ORACLES = {}, {}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def shown(forecasts, places=2):
    return rounded(forecasts.select(SERIES, "model_key", "variation", TS, "yhat"), places)


# Moving average

add("forecast_ma", lambda spark, sf: shown(ma.forecast_ma(suppliers(spark, sf)), 4),
    sql.query(*_BASE, sql.flat_forecasts(), select="SELECT series_id, model_key, variation, ts, round(yhat, 4) AS yhat FROM forecasts"))
add("trailing_mean", lambda spark, sf: rounded(ma.trailing_mean(held_split_of(p.event_readings(spark, sf)).where("is_train"), [5])),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT,
              select='SELECT series_id, 5 AS "window", round(avg(y), 4) AS mean FROM split WHERE is_train AND rn >= n_train - 5 GROUP BY ALL'))
_BEST_MA = """
best AS (SELECT series_id, w FROM candidates QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 9), w) = 1),
tuned AS (SELECT s.series_id, any_value(b.w) AS w, avg(y) AS yhat FROM split s JOIN best b ON s.series_id = b.series_id AND is_train AND rn >= n_train - b.w GROUP BY ALL)"""
add("tune_ma", lambda spark, sf: rounded(ma.tune_ma(suppliers(spark, sf))[1].select(SERIES, TS, "params", "yhat"), 2),
    sql.query(*_BASE, sql.HOLDOUT, _MA_GRID, _BEST_MA, select="""
SELECT s.series_id, s.ts, '{"window":' || w || '}' AS params, round(yhat, 2) AS yhat FROM split s JOIN tuned USING (series_id) WHERE NOT is_train"""))

# Autoregression: the fits are sums, the rollout a recursion, so SQL can follow all three variations

_AR_FITS = """
train AS (SELECT series_id, rn, n_train, y, y - lag(y) OVER s AS d, lag(y) OVER s AS y1 FROM split WHERE is_train WINDOW s AS (PARTITION BY series_id ORDER BY rn)),
lagged AS (SELECT *, lag(d) OVER s AS d1, lag(d, 2) OVER s AS d2 FROM train WINDOW s AS (PARTITION BY series_id ORDER BY rn)),
ar10 AS (SELECT series_id, regr_slope(y, y1) AS phi, regr_intercept(y, y1) AS c FROM lagged WHERE y1 IS NOT NULL GROUP BY ALL),
ar11 AS (SELECT series_id, sum(d * d1) / sum(d1 * d1) AS phi FROM lagged WHERE d1 IS NOT NULL GROUP BY ALL),
ar21s AS (SELECT series_id, sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d2 * d2) AS e, sum(d * d1) AS f, sum(d * d2) AS g FROM lagged WHERE d2 IS NOT NULL GROUP BY ALL),
ar21 AS (SELECT series_id, (f * e - g * b) / (a * e - b * b) AS p1, (a * g - b * f) / (a * e - b * b) AS p2 FROM ar21s),
ends AS (SELECT series_id, max_by(y, rn) AS y, max_by(d, rn) AS d, max_by(d1, rn) AS d1 FROM lagged GROUP BY ALL),
rolled AS (
  SELECT series_id, 0 AS k, e.y AS a, e.y AS b, e.d AS db, e.y AS c, e.d AS dc, e.d1 AS dc1 FROM ends e
  UNION ALL
  SELECT r.series_id, k + 1, x.c + x.phi * r.a, r.b + u.phi * r.db, u.phi * r.db,
         r.c + v.p1 * r.dc + v.p2 * r.dc1, v.p1 * r.dc + v.p2 * r.dc1, r.dc
  FROM rolled r JOIN ar10 x USING (series_id) JOIN ar11 u USING (series_id) JOIN ar21 v USING (series_id)
  WHERE k < (SELECT max(n - n_train) FROM split s WHERE s.series_id = r.series_id))"""
_AR_SQL = """
SELECT s.series_id, 'arima' AS model_key, v.variation, s.ts, round(CASE v.variation WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 2) AS yhat
FROM split s JOIN rolled r ON r.series_id = s.series_id AND r.k = s.rn - s.n_train + 1, (SELECT unnest([0, 1, 2])::INTEGER AS variation) v
WHERE NOT s.is_train"""


def recursive(*ctes, select):
    return sql.query(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


add("forecast_ar", lambda spark, sf: shown(ar.forecast_ar(suppliers(spark, sf))), recursive(*_BASE, _AR_FITS, select=_AR_SQL))
add("forecast_ar_readings", lambda spark, sf: shown(ar.forecast_ar(held_split_of(p.event_readings(spark, sf)), ar.PLAIN[:1])),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT, """
lagged AS (SELECT series_id, rn, y, lag(y) OVER (PARTITION BY series_id ORDER BY rn) AS y1 FROM split WHERE is_train),
fits AS (SELECT series_id, regr_slope(y, y1) AS phi, regr_intercept(y, y1) AS c, max_by(y, rn) AS last FROM lagged GROUP BY ALL)""",
              select="""
SELECT series_id, 'arima' AS model_key, 0 AS variation, ts, round(c / (1 - phi) + phi ** (rn - n_train + 1) * (last - c / (1 - phi)), 2) AS yhat
FROM split JOIN fits USING (series_id) WHERE NOT is_train"""))


def _rollout(spark, sf):
    """Damped continuation of every series: half of the last value, plus a tenth of the one before."""
    split = held_split_of(p.orders_daily(spark, sf))
    state = ar.last_values(split.where("is_train"), 2, "n_train")
    horizon = split.where("not is_train").groupBy(SERIES).agg(F.count(F.lit(1)).alias("horizon"))
    fits = state.join(horizon, SERIES).withColumns(
        {"coef": F.array(F.lit(0.5), F.lit(0.1)), "intercept": F.lit(10000.0)}
    )
    return rounded(recursive_rollout(fits, [SERIES], chunk=64), 2)


add("recursive_rollout", _rollout,
    recursive(p.ORDERS_DAILY, sql.features(), sql.SPLIT, """
ends AS (SELECT series_id, max(n - n_train) AS h, max_by(y, rn) AS y0, max_by(y, rn) FILTER (rn < n_train - 1) AS y1 FROM split WHERE is_train GROUP BY ALL),
rolled AS (SELECT series_id, h, 0::BIGINT AS step, y0, y1 FROM ends
  UNION ALL SELECT series_id, h, step + 1, 10000 + 0.5::DOUBLE * y0 + 0.1::DOUBLE * y1, y0 FROM rolled WHERE step < h)""",
              select="SELECT series_id, step, round(y0, 2) AS yhat FROM rolled WHERE step > 0"))
add("tune_ar", lambda spark, sf: rounded(ar.tune_ar(suppliers(spark, sf))[1].select(SERIES, TS, "params", "yhat")))
# Twice differenced, the three seasonal variations are regressions on one or two earlier differences.
_SEASONAL_FITS = """
train AS (SELECT series_id, rn, y, y - lag(y) OVER s - lag(y, 12) OVER s + lag(y, 13) OVER s AS w FROM split WHERE is_train WINDOW s AS (PARTITION BY series_id ORDER BY rn)),
lagged AS (SELECT *, lag(w) OVER s AS w1, lag(w, 2) OVER s AS w2, lag(w, 12) OVER s AS w12 FROM train WINDOW s AS (PARTITION BY series_id ORDER BY rn)),
one AS (SELECT series_id, sum(w * w1) / sum(w1 * w1) AS p1 FROM lagged WHERE w1 IS NOT NULL GROUP BY ALL),
two AS (
  SELECT series_id, sum(w1 * w1) AS a, sum(w1 * w2) AS b, sum(w2 * w2) AS c, sum(w * w1) AS d, sum(w * w2) AS e
  FROM lagged WHERE w2 IS NOT NULL GROUP BY ALL),
far AS (
  SELECT series_id, sum(w1 * w1) AS a, sum(w1 * w12) AS b, sum(w12 * w12) AS c, sum(w * w1) AS d, sum(w * w12) AS e
  FROM lagged WHERE w12 IS NOT NULL GROUP BY ALL),
fits AS (
  SELECT series_id, one.p1, (far.d * far.c - far.e * far.b) / (far.a * far.c - far.b * far.b) AS f1, (far.a * far.e - far.b * far.d) / (far.a * far.c - far.b * far.b) AS f12,
    (two.d * two.c - two.e * two.b) / (two.a * two.c - two.b * two.b) AS t1, (two.a * two.e - two.b * two.d) / (two.a * two.c - two.b * two.b) AS t2
  FROM one JOIN two USING (series_id) JOIN far USING (series_id)),
ends AS (SELECT series_id, max(n - n_train) AS h, list(y ORDER BY rn) AS l FROM split WHERE is_train AND rn >= n_train - 27 GROUP BY ALL),
rolled AS (
  SELECT series_id, h, 0 AS k, l AS x, l AS y, l AS z FROM ends
  UNION ALL
  SELECT r.series_id, h, k + 1,
    list_append(x, x[-1] + x[-12] - x[-13] + p1 * (x[-1] - x[-2] - x[-13] + x[-14])),
    list_append(y, y[-1] + y[-12] - y[-13] + f1 * (y[-1] - y[-2] - y[-13] + y[-14]) + f12 * (y[-12] - y[-13] - y[-24] + y[-25])),
    list_append(z, z[-1] + z[-12] - z[-13] + t1 * (z[-1] - z[-2] - z[-13] + z[-14]) + t2 * (z[-2] - z[-3] - z[-14] + z[-15]))
  FROM rolled r JOIN fits USING (series_id) WHERE k < h)"""
add("forecast_seasonal_ar", lambda spark, sf: shown(ar.forecast_seasonal_ar(suppliers(spark, sf))),
    recursive(*_BASE, _SEASONAL_FITS, select="""
SELECT s.series_id, 'sarima' AS model_key, v.variation, s.ts, round(CASE v.variation WHEN 0 THEN x[-1] WHEN 1 THEN r.y[-1] ELSE z[-1] END, 2) AS yhat
FROM split s JOIN rolled r ON r.series_id = s.series_id AND r.k = s.rn - s.n_train + 1, (SELECT unnest([0, 1, 2])::INTEGER AS variation) v WHERE NOT s.is_train"""))
# Moving-average terms: the residuals of a long autoregression, then a regression on lags of them.
_MOVING = [ar.order(0, 0, q=1), ar.order(0, 1, q=1), ar.order(1, 1, q=1)]


def _long_sql(name: str, column: str, lags: int, constant: bool) -> tuple[str, str, str]:
    """Design, sums and solution of the autoregression of ``column`` with this many lags."""
    terms = [*(["1.0"] if constant else []), *[f"lag({column}, {k}) OVER s" for k in range(1, lags + 1)], column]
    size = len(terms)
    rows = f"""
{name}_rows AS (
  SELECT series_id, rn, x FROM (
    SELECT series_id, rn, lag({column}, {lags}) OVER s AS oldest, [{", ".join(terms)}]::DOUBLE[] AS x
    FROM moves WINDOW s AS (PARTITION BY series_id ORDER BY rn))
  WHERE oldest IS NOT NULL)"""
    return rows, sql.gram(f"{name}_sums", f"{name}_rows", size), sql.solved(name, f"{name}_sums", size - 1)


def _errors_sql(name: str, column: str, constant: bool) -> tuple[str, ...]:
    """Residuals of the long autoregression with twelve lags, or with four where there are too few rows."""
    parts = [x for lags in ar.LONG_LAGS for x in _long_sql(f"{name}{lags}", column, lags, constant)]
    a, b = (f"{name}{lags}" for lags in ar.LONG_LAGS)
    enough = f"(SELECT series_id FROM {a}_sums GROUP BY series_id HAVING max(m) >= {ar.LONG_ROWS * (ar.LONG_LAGS[0] + 1)})"
    residual = "x[-1] - list_dot_product(x[1:len(coef)], coef)"
    return (*parts, f"""
{name}_errors AS (
  SELECT series_id, rn, {residual} AS e FROM {a}_rows JOIN {a} USING (series_id) WHERE series_id IN {enough}
  UNION ALL SELECT series_id, rn, {residual} FROM {b}_rows JOIN {b} USING (series_id) WHERE series_id NOT IN {enough}),
{name}_lagged AS (
  SELECT m.series_id, m.rn, m.z, m.d, lag(m.d) OVER s AS d1, coalesce(lag(e.e) OVER s, 0) AS e1, coalesce(e.e, 0) AS e
  FROM moves m LEFT JOIN {name}_errors e USING (series_id, rn) WINDOW s AS (PARTITION BY m.series_id ORDER BY m.rn))""")


_ARMA = (
    """
moves AS (
  SELECT series_id, rn, y - avg(y) OVER (PARTITION BY series_id) AS z, y - lag(y) OVER (PARTITION BY series_id ORDER BY rn) AS d FROM split WHERE is_train)""",
    *_errors_sql("plain", "z", True), *_errors_sql("moved", "d", False),
    """
a_rows AS (SELECT series_id, [1.0, e1, z]::DOUBLE[] AS x FROM plain_lagged),
b_rows AS (SELECT series_id, [e1, d]::DOUBLE[] AS x FROM moved_lagged WHERE d IS NOT NULL),
c_rows AS (SELECT series_id, [d1, e1, d]::DOUBLE[] AS x FROM moved_lagged WHERE d1 IS NOT NULL)""",
    sql.gram("a_sums", "a_rows", 3), sql.solved("a", "a_sums", 2), sql.gram("b_sums", "b_rows", 2), sql.solved("b", "b_sums", 1),
    sql.gram("c_sums", "c_rows", 3), sql.solved("c", "c_sums", 2), """
ends AS (
  SELECT p.series_id, max_by(p.e, p.rn) AS pe, max_by(m.e, m.rn) AS me, max_by(m.d, m.rn) AS d
  FROM plain_lagged p JOIN moved_lagged m USING (series_id, rn) GROUP BY ALL),
train AS (SELECT series_id, avg(y) AS mean, max_by(y, rn) AS y FROM split WHERE is_train GROUP BY ALL),
steps AS (SELECT series_id, ts, rn - n_train + 1 AS h FROM split WHERE NOT is_train)""",
)
add("forecast_arma", lambda spark, sf: shown(ar.forecast_ar(suppliers(spark, sf), _MOVING)),
    sql.query(*_BASE, *_ARMA, select="""
SELECT series_id, 'arima' AS model_key, v.variation, ts, round(CASE v.variation
    WHEN 0 THEN mean + a.coef[1] + CASE WHEN h = 1 THEN a.coef[2] * pe ELSE 0 END
    WHEN 1 THEN t.y + b.coef[1] * me
    ELSE t.y + (c.coef[1] * d + c.coef[2] * me) * (1 - c.coef[1] ** h) / (1 - c.coef[1]) END, 2) AS yhat
FROM steps JOIN train t USING (series_id) JOIN ends USING (series_id) JOIN a USING (series_id) JOIN b USING (series_id) JOIN c USING (series_id),
  (SELECT unnest([0, 1, 2])::INTEGER AS variation) v"""))
add("forecast_seasonal_arma", lambda spark, sf: shown(sweep.run_forecaster(suppliers(spark, sf), "sarima")))
# With no autoregressive part a seasonal difference alone repeats the last season.
add("forecast_seasonal_naive", lambda spark, sf: shown(ar.forecast_seasonal_ar(suppliers(spark, sf), [ar.order(0, 0, 0, 1)], 12), 4),
    sql.query(*_BASE, select="""
SELECT s.series_id, 'sarima' AS model_key, 0 AS variation, s.ts, round(t.y, 4) AS yhat
FROM split s JOIN split t ON t.series_id = s.series_id AND t.rn = s.n_train - 12 + (s.rn - s.n_train) % 12 WHERE NOT s.is_train"""))
add("tune_seasonal_ar", lambda spark, sf: rounded(ar.tune_seasonal_ar(held_split_of(p.returnflag_monthly(spark, sf)))[1].select(SERIES, TS, "params", "yhat")))

# Exponential smoothing

_ALPHAS = [0.1, 0.3, 0.5, 0.7, 0.9]
_SES = f"""
grid AS (SELECT unnest({_ALPHAS})::DOUBLE AS alpha),
smoothed AS (
  SELECT series_id, alpha, 0::BIGINT AS rn, n_train, y AS level, 0.0::DOUBLE AS sse FROM split, grid WHERE is_train AND rn = 0
  UNION ALL
  SELECT m.series_id, alpha, s.rn, m.n_train, alpha * s.y + (1 - alpha) * level, sse + (s.y - level) ** 2
  FROM smoothed m JOIN split s ON s.series_id = m.series_id AND s.rn = m.rn + 1 AND s.is_train),
best AS (SELECT series_id, level FROM smoothed WHERE rn = n_train - 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse) = 1)"""
add("forecast_es_simple",
    lambda spark, sf: shown(es.forecast_es(suppliers(spark, sf), [(None, None)], weights=[(a, 0.0, 0.0) for a in _ALPHAS])),
    recursive(*_BASE, _SES, select="SELECT series_id, 'es' AS model_key, 0 AS variation, ts, round(level, 2) AS yhat FROM split JOIN best USING (series_id) WHERE NOT is_train"))
_HOLT = [(0.3, 0.1), (0.5, 0.3), (0.8, 0.05)]
add("forecast_es_trend",
    lambda spark, sf: shown(es.forecast_es(suppliers(spark, sf), [("add", None)], weights=[(a, b, 0.0) for a, b in _HOLT])),
    recursive(*_BASE, f"""
grid AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _HOLT)}) AS t(alpha, beta)),
states AS (
  SELECT s.series_id, alpha, beta, -1::BIGINT AS rn, s.n_train, s.y AS level, t.y - s.y AS slope, 0.0::DOUBLE AS sse
  FROM split s JOIN split t ON t.series_id = s.series_id AND s.rn = 0 AND t.rn = 1, grid
  UNION ALL
  SELECT m.series_id, alpha, beta, s.rn, m.n_train, alpha * s.y + (1 - alpha) * (level + slope),
    beta * (alpha * s.y + (1 - alpha) * (level + slope) - level) + (1 - beta) * slope, sse + (s.y - level - slope) ** 2
  FROM states m JOIN split s ON s.series_id = m.series_id AND s.rn = m.rn + 1 AND s.is_train),
best AS (SELECT series_id, level, slope FROM states WHERE rn = n_train - 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse) = 1)""",
              select="SELECT series_id, 'es' AS model_key, 0 AS variation, ts, round(level + slope * (rn - n_train + 1), 2) AS yhat FROM split JOIN best USING (series_id) WHERE NOT is_train"))
add("forecast_es", lambda spark, sf: shown(es.forecast_es(suppliers(spark, sf))))
add("tune_es", lambda spark, sf: rounded(es.tune_es(held_split_of(p.returnflag_monthly(spark, sf)))[1].select(SERIES, TS, "params", "yhat")))

# Trend and seasonality

add("forecast_trend_seasonal", lambda spark, sf: shown(trend.forecast_trend_seasonal(held_split_of(p.orders_daily(spark, sf)))))
add("tune_trend_seasonal", lambda spark, sf: rounded(trend.tune_trend_seasonal(held_split_of(p.orders_daily(spark, sf)))[1].select(SERIES, TS, "params", "yhat")))

# Linear models

_ONE = ["lag_1"]
add("fit_linear_one_feature",
    lambda spark, sf: _line(held_split_of(p.event_readings(spark, sf))),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT,
              select="SELECT series_id, round(regr_slope(y, lag_1), 6) AS slope, round(regr_intercept(y, lag_1), 4) AS constant FROM split WHERE is_train GROUP BY ALL"))


def _line(split):
    fits = linear.fit_linear(split, [{"loss": "l2"}], _ONE)
    constant = F.col("y_mean") + F.col("y_std") * F.col("coef")[0] - F.col("coef")[1] * F.col("y_mean")
    return fits.select(SERIES, F.round(F.col("coef")[1], 6).alias("slope"), F.round(constant, 4).alias("constant"))


add("one_step_forecast",
    lambda spark, sf: shown(linear.forecast_linear(suppliers(spark, sf), [{"loss": "l2"}], _ONE)),
    sql.query(*_BASE, "fits AS (SELECT series_id, regr_slope(y, lag_1) AS b, regr_intercept(y, lag_1) AS a FROM split WHERE is_train GROUP BY ALL)",
              select="SELECT series_id, 'lr' AS model_key, 0 AS variation, ts, round(a + b * lag_1, 2) AS yhat FROM split JOIN fits USING (series_id) WHERE NOT is_train"))
_FOLD_LINE = """
sides AS (SELECT series_id, fold, avg(lag_1) AS mx, avg(y) AS my, covar_pop(y, lag_1) AS cxy, var_pop(lag_1) AS cxx, count(*) AS m FROM folds WHERE rn < val_start GROUP BY ALL),
lines AS (SELECT *, {slope} AS b FROM sides, (SELECT unnest([{alphas}])::DOUBLE AS alpha, unnest([0, 1, 2])::INTEGER AS candidate_no)),
scores AS (
  SELECT f.series_id, candidate_no, f.fold, sqrt(avg((y - my - b * (lag_1 - mx)) ** 2)) AS rmse
  FROM folds f JOIN lines l USING (series_id, fold) WHERE rn >= val_start GROUP BY ALL)"""
for _loss, _alphas, _slope in (
    ("l2", [0.0, 5e4, 5e6], "m * cxy / (m * cxx + alpha)"),
    ("l1", [0.1, 20.0, 100.0], "sign(cxy) * greatest(abs(cxy) - alpha, 0) / cxx"),
):
    add(f"linear_fold_scores_{_loss}",
        lambda spark, sf, loss=_loss, alphas=_alphas: rounded(linear.linear_candidates(
            held_split_of(p.event_readings(spark, sf)), loss, [{"alpha": a} for a in alphas], columns=_ONE).drop("params")),
        sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT, sql.FOLDS,
                  _FOLD_LINE.format(slope=_slope, alphas=", ".join(map(str, _alphas))),
                  select="SELECT series_id, candidate_no, fold, round(rmse, 4) AS rmse FROM scores"))
# All thirteen features: the sums of a design in units of the series, solved by elimination. The rolling mean is
# a sum of lags, so one pivot is nothing; the forecasts are the same whichever of the solutions is taken.
_DESIGN = """
scales AS (SELECT series_id, avg(y) AS mean, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS std FROM split WHERE is_train GROUP BY ALL),
designed AS (
  SELECT s.series_id, ts, rn, n_train, is_train, mean, std,
    [1.0, (lag_1 - mean) / std, (lag_2 - mean) / std, (lag_3 - mean) / std, (lag_4 - mean) / std, (lag_5 - mean) / std, (lag_6 - mean) / std,
     (lag_7 - mean) / std, (rolling_mean - mean) / std, rolling_std / std, dayofweek - 3, month - 6, quarter - 2, year - 2000, (y - mean) / std]::DOUBLE[] AS x
  FROM split s JOIN scales USING (series_id))"""
_PREDICTED = "mean + std * list_dot_product(x[1:14], coef)"
add("fit_linear_l2", lambda spark, sf: shown(linear.forecast_linear(held_split_of(p.supplier_monthly(spark, sf)), [{"loss": "l2"}]), 1),
    sql.query(*_BASE, _DESIGN, "fitted AS (SELECT * FROM designed WHERE is_train)", sql.gram("sums", "fitted", 15), sql.solved("fits", "sums", 14), select=f"""
SELECT series_id, 'lr' AS model_key, 0 AS variation, ts, round({_PREDICTED}, 1) AS yhat FROM designed JOIN fits USING (series_id) WHERE NOT is_train"""))
# Ridge weights act on raw coefficients, while the sums are in units of the series: they shrink by the squared unit, but for calendar columns.
_RIDGE = """
ridged AS MATERIALIZED (
  SELECT series_id, {key}, candidate_no, i, j, m, v + CASE WHEN i = j AND i > 1 THEN alpha * CASE WHEN i > 10 THEN 1 ELSE 1 / (std * std) END ELSE 0 END AS v
  FROM {sums} JOIN scales USING (series_id), (SELECT unnest([0.01, 0.1, 1, 10])::DOUBLE AS alpha, unnest([0, 1, 2, 3])::INTEGER AS candidate_no))"""
add("tune_linear", lambda spark, sf: rounded(linear.tune_linear(suppliers(spark, sf), "l2")[1].select(SERIES, TS, "params", "yhat"), 1),
    sql.query(*_BASE, _DESIGN, """
sides AS (
  SELECT d.*, f.fold, n_train - (3 - f.fold) * (n_train // 4) AS val_start, n_train // 4 AS val_size
  FROM designed d, (SELECT unnest([0, 1, 2])::INTEGER AS fold) f WHERE is_train AND n_train > 3),
before AS (SELECT series_id, fold, x FROM sides WHERE rn < val_start
  UNION ALL SELECT series_id, 3, x FROM designed WHERE is_train)""",
              sql.gram("sums", "before", 15, "series_id, fold"), _RIDGE.format(key="fold", sums="sums"),
              sql.solved("fits", "ridged", 14, ("series_id", "fold", "candidate_no")), f"""
scores AS (
  SELECT series_id, candidate_no, fold, any_value(std) * sqrt(avg((x[15] - list_dot_product(x[1:14], coef)) ** 2)) AS rmse
  FROM sides JOIN fits USING (series_id, fold) WHERE rn >= val_start AND rn < val_start + val_size GROUP BY ALL),
best AS (
  SELECT series_id, candidate_no FROM (SELECT series_id, candidate_no, avg(rmse) AS rmse FROM scores GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, candidate_no) = 1)""", select=f"""
SELECT series_id, ts, '{{"alpha": ' || ['0.01', '0.1', '1.0', '10.0'][candidate_no + 1] || '}}' AS params, round({_PREDICTED}, 1) AS yhat
FROM designed JOIN fits USING (series_id) JOIN best USING (series_id, candidate_no) WHERE fold = 3 AND NOT is_train"""))
for _name, _spec, _panel in (
    ("l1", {"loss": "l1", "alpha": 0.1}, p.supplier_monthly),
    ("huber", {"loss": "huber"}, p.supplier_monthly),
    ("quantile", {"loss": "quantile"}, p.supplier_monthly),
):
    add(f"fit_linear_{_name}", lambda spark, sf, spec=_spec, panel=_panel: shown(linear.forecast_linear(held_split_of(panel(spark, sf)), [spec])))
for _loss in ("huber", "quantile"):
    add(f"tune_linear_{_loss}", lambda spark, sf, loss=_loss: rounded(
        linear.tune_linear(held_split_of(p.returnflag_monthly(spark, sf)), loss)[1].select(SERIES, TS, "params", "yhat")))
add("tune_linear_l1", lambda spark, sf: rounded(linear.tune_linear(held_split_of(p.orders_daily(spark, sf)), "l1")[1].select(SERIES, TS, "params", "yhat")))

# Trees: one pooled model

add("fit_forest", lambda spark, sf: shown(trees.forecast_trees(suppliers(spark, sf), "rf", {"loss": "l2", "lags": 3})))
add("fit_boosted", lambda spark, sf: shown(trees.forecast_trees(suppliers(spark, sf), "xgb", {"loss": "l2", "lags": 3})))
# Losses of the other default variations, and quantile loss: no SQL, see the tests.
add("fit_forest_l1", lambda spark, sf: shown(trees.forecast_trees(suppliers(spark, sf), "rf", {"loss": "l1", "lags": 5})))
add("fit_boosted_huber", lambda spark, sf: shown(trees.forecast_trees(suppliers(spark, sf), "xgb", {"loss": "huber", "lags": 7})))
add("fit_boosted_quantile", lambda spark, sf: shown(trees.forecast_trees(suppliers(spark, sf), "xgb", {"loss": "quantile", "lags": 7})))
add("feature_importance", lambda spark, sf: trees.feature_importance(spark, trees.fit_trees(suppliers(spark, sf), "rf", params={"n_estimators": 20})))
_SMALL_BOOSTED = {"n_estimators": [10], "learning_rate": [0.1, 0.2], "max_depth": [3]}
add("tune_forest", lambda spark, sf: rounded(trees.tune_trees(suppliers(spark, sf), "rf")[1].select(SERIES, TS, "params", "yhat")))
add("tune_boosted", lambda spark, sf: rounded(trees.tune_trees(suppliers(spark, sf), "xgb", grid=_SMALL_BOOSTED)[1].select(SERIES, TS, "params", "yhat")))

# Sweeps, tuning of the best, user models

def _sweep(spark, sf):
    split = suppliers(spark, sf)
    return tidy(sweep.results(sweep.sweep(split), split))


add("model_sweep", _sweep)


def _tune_top(spark, sf):
    split = held_split_of(p.returnflag_monthly(spark, sf))
    base = sweep.sweep(split, ["ma", "arima", "lr"])
    ranked = sweep.comparison(sweep.results(base, split))
    return tuning.tune_top_models(split, ranked, 3), base, split


add("tune_top_models", lambda spark, sf: rounded(_tune_top(spark, sf)[0].select(SERIES, "model", TS, "yhat")))


def _with_tuned(spark, sf):
    tuned, base, split = _tune_top(spark, sf)
    keep = [SERIES, "model", "model_key", "variation", "run", TS, "y", "yhat"]
    both = tuning.union_tuned(base.select(*keep), tuned.select(*keep).withColumn("variation", F.lit(-1)))
    return tidy(r.rank_models(r.composite_score(evaluate(both, split))))


add("union_tuned", _with_tuned)


def drift(y: np.ndarray, horizon: int, spec: dict) -> np.ndarray:
    """A user model: the line through the first and the last training value."""
    slope = (y[-1] - y[0]) / max(len(y) - 1, 1)
    return y[-1] + spec["share"] * slope * np.arange(1, horizon + 1)


def _user_model(spark, sf):
    known = sweep.register_forecaster("drift", sweep.per_series_forecaster("drift", drift), [{"share": 1.0}, {"share": 0.5}])
    return shown(sweep.run_forecaster(suppliers(spark, sf), "drift", registry=known))


add("register_forecaster", _user_model,
    sql.query(*_BASE, "ends AS (SELECT series_id, min_by(y, rn) AS y0, max_by(y, rn) AS y1 FROM split WHERE is_train GROUP BY ALL)", select="""
SELECT series_id, 'drift' AS model_key, variation, ts,
  round(y1 + CASE variation WHEN 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * (y1 - y0) / (n_train - 1) * (rn - n_train + 1), 2) AS yhat
FROM split JOIN ends USING (series_id), (SELECT unnest([0, 1])::INTEGER AS variation) WHERE NOT is_train"""))


def flagship(spark, sf):
    """Models swept, scored, ranked and recommended for every supplier."""
    split = suppliers(spark, sf)
    table = sweep.comparison(sweep.results(sweep.sweep(split, ["ma", "arima", "es", "lr"]), split))
    return tidy(sweep.recommendation(table)).select(
        SERIES, "model", "family", "composite_score", "rmse", "mae", "r2", "mase", "mape", "margin", "judgment"
    )


add("recommendation", flagship)
