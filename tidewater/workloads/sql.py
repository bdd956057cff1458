"""SQL building blocks of the checks: each function returns one common table expression."""

from __future__ import annotations

LAGS = 7


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + select.strip()


def raw_features(lags: int = LAGS) -> str:
    lag_columns = ", ".join(f"lag(y, {k}) OVER s AS lag_{k}" for k in range(1, lags + 1))
    return f"""
raw_features AS (
  SELECT series_id, ts, y, {lag_columns},
    CASE WHEN count(y) OVER r = 3 THEN avg(y) OVER r END AS rolling_mean,
    CASE WHEN count(y) OVER r = 3 THEN stddev_samp(y) OVER r END AS rolling_std,
    CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(month(ts) AS INTEGER) AS month,
    CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year
  FROM panel
  WINDOW s AS (PARTITION BY series_id ORDER BY ts, y),
         r AS (PARTITION BY series_id ORDER BY ts, y ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


def features(lags: int = LAGS) -> str:
    return raw_features(lags) + f""",
features AS (SELECT * FROM raw_features WHERE lag_{lags} IS NOT NULL AND rolling_std IS NOT NULL)"""


SPLIT = """
counted AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, y) - 1 AS rn,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM features),
split AS (SELECT *, n * 4 // 5 AS n_train, rn < n * 4 // 5 AS is_train FROM counted)"""

HOLDOUT = """
sized AS (
  SELECT *, n_train - least(greatest(1, n_train // 5), n_train - 1) AS n_fit FROM split WHERE is_train),
holdout AS (SELECT *, CASE WHEN rn < n_fit THEN 'fit' ELSE 'val' END AS role FROM sized)"""

FOLDS = """
folds AS (
  SELECT s.*, f.fold, n_train - (3 - f.fold) * (n_train // 4) AS val_start, n_train // 4 AS val_size
  FROM split s, (SELECT unnest([0, 1, 2])::INTEGER AS fold) f
  WHERE is_train AND n_train > 3 AND rn < n_train - (3 - f.fold) * (n_train // 4) + n_train // 4)"""


def flat_forecasts(windows=(3, 5, 7), runs: int = 1) -> str:
    """Moving-average forecasts; run r uses windows one longer than run r - 1."""
    return f"""
specs AS (
  SELECT v.variation, r.run, v.w + r.run - 1 AS w, 'Moving Average (w=' || v.w || ')' AS model
  FROM (SELECT unnest([{", ".join(str(i) for i in range(len(windows)))}])::INTEGER AS variation,
               unnest([{", ".join(map(str, windows))}]) AS w) v,
       (SELECT unnest([{", ".join(str(i) for i in range(1, runs + 1))}])::INTEGER AS run) r),
tails AS (
  SELECT s.series_id, p.variation, p.run, p.model,
         CASE WHEN count(*) = any_value(p.w) THEN avg(s.y) END AS yhat
  FROM split s JOIN specs p ON s.is_train AND s.rn >= s.n_train - p.w GROUP BY ALL),
forecasts AS (
  SELECT s.series_id, 'ma' AS model_key, t.model, t.variation, t.run, s.ts, s.rn, s.n_train, s.y, t.yhat
  FROM split s JOIN tails t USING (series_id) WHERE NOT s.is_train)"""


METRICS = """
scales AS (
  SELECT series_id, avg(abs(d)) AS scale
  FROM (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY rn) AS d FROM split WHERE is_train)
  GROUP BY series_id),
means AS (
  SELECT series_id, model_key, variation, run, avg(y) AS ybar
  FROM forecasts WHERE yhat IS NOT NULL GROUP BY ALL),
sums AS (
  SELECT series_id, model_key, f.model, variation, run, count(*) AS n, avg((y - yhat) ** 2) AS mse,
         avg(abs(y - yhat)) AS mae, sum((y - yhat) ** 2) AS sse, sum((y - ybar) ** 2) AS sst,
         avg(CASE WHEN abs(y) >= 1e-10 THEN abs((y - yhat) / y) END) * 100 AS mape
  FROM forecasts f JOIN means m USING (series_id, model_key, variation, run)
  WHERE yhat IS NOT NULL GROUP BY ALL),
metrics AS (
  SELECT series_id, model_key, model, variation, run, mse, sqrt(mse) AS rmse, mae,
         CASE WHEN n < 2 THEN NULL WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END
              ELSE 1 - sse / sst END AS r2,
         CASE WHEN scale > 0 THEN mae / scale END AS mase, mape
  FROM sums LEFT JOIN scales USING (series_id))"""


def composite(source: str = "metrics", by: str = "series_id", name: str = "scored") -> str:
    def apart(c):
        lo, hi = f"min({c}) OVER g", f"max({c}) OVER g"
        return f"{hi} - {lo} > 1e-9 * greatest(abs({hi}), abs({lo}))"

    def low(c):
        return (f"CASE WHEN {apart(c)} "
                f"THEN 1 - ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) ELSE 1.0 END")

    return f"""
{name}_scores AS (
  SELECT *, {low("rmse")} AS s_rmse, {low("mae")} AS s_mae,
    CASE WHEN {apart("r2")}
         THEN (r2 - min(r2) OVER g) / (max(r2) OVER g - min(r2) OVER g)
         WHEN max(r2) OVER g >= 0 THEN 1.0 ELSE 0.0 END AS s_r2,
    CASE WHEN c_mase IS NULL THEN 0.5 ELSE {low("c_mase")} END AS s_mase,
    CASE WHEN c_mape IS NULL THEN 0.5 ELSE {low("c_mape")} END AS s_mape
  FROM (SELECT *, least(mase, 10.0) AS c_mase, least(mape, 200.0) AS c_mape FROM {source})
  WINDOW g AS (PARTITION BY {by})),
{name} AS (
  SELECT *, (coalesce(s_rmse, 0) + coalesce(s_mae, 0) + coalesce(s_r2, 0) + s_mase + s_mape)
    / ((s_rmse IS NOT NULL)::INT + (s_mae IS NOT NULL)::INT + (s_r2 IS NOT NULL)::INT + 2) AS composite_score
  FROM {name}_scores)"""


def ranked(source: str = "scored", by: str = "series_id", order: str = "model, model_key, variation, run") -> str:
    return f"""
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY round(composite_score, 9) DESC NULLS LAST, {order}) AS INTEGER) AS rank
  FROM {source})"""


def gram(name: str, source: str, size: int, keys: str = "series_id") -> str:
    """Sums of products of the columns of a design held as list ``x`` with ``size`` entries, the target last:
    a row per pair i, j up to the unknowns, and the target's products as column ``size``."""
    return f"""
{name} AS MATERIALIZED (
  SELECT {keys}, i, j, sum(x[i] * x[j]) AS v, count(*) AS m
  FROM {source}, (SELECT unnest(range(1, {size})) AS i), (SELECT unnest(range(1, {size} + 1)) AS j) GROUP BY ALL)"""


def solved(name: str, source: str, unknowns: int, keys: tuple = ("series_id",)) -> str:
    """Coefficients ``coef`` (a list) of the least-squares system in ``source`` (see :func:`gram`), by Gauss-Jordan
    elimination, one pivot after the other; a pivot of about nothing leaves its coefficient at zero."""
    steps, at = [], source
    using = ", ".join(keys)
    for k in range(1, unknowns + 1):
        steps.append(f"""
{name}_{k} AS MATERIALIZED (
  SELECT {", ".join("a." + c for c in keys)}, a.i, a.j,
    CASE WHEN abs(d.v) <= 1e-10 * o.v THEN CASE WHEN a.i = {k} THEN 0 ELSE a.v END
         WHEN a.i = {k} THEN a.v / d.v ELSE a.v - c.v * r.v / d.v END AS v
  FROM {at} a
  JOIN {at} r ON {" AND ".join(f"r.{x} = a.{x}" for x in keys)} AND r.i = {k} AND r.j = a.j
  JOIN {at} c ON {" AND ".join(f"c.{x} = a.{x}" for x in keys)} AND c.i = a.i AND c.j = {k}
  JOIN {at} d ON {" AND ".join(f"d.{x} = a.{x}" for x in keys)} AND d.i = {k} AND d.j = {k}
  JOIN {source} o ON {" AND ".join(f"o.{x} = a.{x}" for x in keys)} AND o.i = {k} AND o.j = {k})""")
        at = f"{name}_{k}"
    return ",".join(steps) + f""",
{name} AS MATERIALIZED (SELECT {using}, list(v ORDER BY i) AS coef FROM {at} WHERE j = {unknowns + 1} GROUP BY {using})"""
