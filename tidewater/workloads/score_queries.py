"""Metrics, ranking, names, configurations and report tables over flat forecasts of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import catalog, configs, names
from tidewater.forecast.ma import ma_candidates
from tidewater.operators import metrics as m
from tidewater.operators import ranking as r
from tidewater.operators import report, splits
from tidewater.operators.positions import SERIES, TS, Y
from tidewater.plans import sweep, tuning
from tidewater.session import scratch_path
from tidewater.sinks import results as sinks
from tidewater.workloads import panels as p
from tidewater.workloads import sql
from tidewater.workloads.base import flat_forecasts, flat_metrics, flat_ranked, held_split_of, rounded

QUERIES, ORACLES = {}, {}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def suppliers(spark, sf):
    return held_split_of(p.supplier_monthly(spark, sf))


_BASE = (p.SUPPLIER_MONTHLY, sql.features(), sql.SPLIT)


def flat(runs=1):
    return (*_BASE, sql.flat_forecasts(runs=runs), sql.METRICS)


_ID = "series_id, model_key, model, variation, run"
_METRICS = "round(mse, 2) AS mse, round(rmse, 4) AS rmse, round(mae, 2) AS mae, round(r2, 6) AS r2, round(mase, 6) AS mase, round(mape, 6) AS mape"


def tidy(df):
    """Money to cents or better, ratios to six decimals. Mean absolute errors are sums of cents over a
    small count, so at four decimals exact halves would round either way."""
    places = {"mse": 2, "rmse": 4, "mae": 2, "rmse_std": 4, "pinball": 2}
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places.get(c, 6)) for c in doubles})


# Metrics

add("forecast_metrics", lambda spark, sf: tidy(m.forecast_metrics(flat_forecasts(suppliers(spark, sf)))).drop("mape"),
    sql.query(*flat(), select=f"SELECT {_ID}, round(mse, 2) AS mse, round(rmse, 4) AS rmse, round(mae, 2) AS mae, round(r2, 6) AS r2 FROM metrics"))
add("mase", lambda spark, sf: tidy(flat_metrics(held_split_of(p.event_readings(spark, sf)))).select(SERIES, "variation", "mase"),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT, sql.flat_forecasts(), sql.METRICS,
              select="SELECT series_id, variation, round(mase, 6) AS mase FROM metrics"))
add("mape", lambda spark, sf: tidy(m.forecast_metrics(flat_forecasts(suppliers(spark, sf)))).select(SERIES, "variation", "mape"),
    sql.query(*flat(), select="SELECT series_id, variation, round(mape, 6) AS mape FROM metrics"))
add("nonzero_actuals",
    lambda spark, sf: flat_forecasts(held_split_of(p.event_readings(spark, sf)))
    .withColumn("used", m.percentage_error(F.col(Y) - 1, F.col("yhat")).isNotNull())
    .groupBy(SERIES, "variation").agg(F.count_if("used").alias("n_used"), F.count(F.lit(1)).alias("n_rows")),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT, sql.flat_forecasts(),
              select="SELECT series_id, variation, count(*) FILTER (abs(y - 1) >= 1e-10) AS n_used, count(*) AS n_rows FROM forecasts GROUP BY ALL"))
add("align_forecast", lambda spark, sf: _aligned(suppliers(spark, sf)),
    sql.query(*_BASE, sql.flat_forecasts(), select="SELECT series_id, ts, variation, round(y, 4) AS y, round(yhat, 4) AS yhat FROM forecasts"))


def _aligned(split):
    forecasts = flat_forecasts(split).select(SERIES, TS, "variation", "yhat")
    return rounded(m.align_forecast(split.where("not is_train"), forecasts)).select(SERIES, TS, "variation", Y, "yhat")


add("pinball_loss", lambda spark, sf: tidy(m.pinball_loss(flat_forecasts(suppliers(spark, sf)), [SERIES, "variation"], 0.9)),
    sql.query(*_BASE, sql.flat_forecasts(),
              select="SELECT series_id, variation, round(avg(greatest(0.9 * (y - yhat), (0.9 - 1) * (y - yhat))), 2) AS pinball FROM forecasts GROUP BY ALL"))
add("clip_metric",
    lambda spark, sf: tidy(flat_metrics(suppliers(spark, sf)).select(
        SERIES, "variation", r.clip_metric(F.col("mase") * 15, r.MASE_CAP).alias("mase"), r.clip_metric(F.col("mape") * 5, r.MAPE_CAP).alias("mape"))),
    sql.query(*flat(), select="SELECT series_id, variation, round(least(mase * 15, 10.0), 6) AS mase, round(least(mape * 5, 200.0), 6) AS mape FROM metrics"))
add("residuals",
    lambda spark, sf: rounded(m.residuals(flat_forecasts(held_split_of(p.event_readings(spark, sf))), [SERIES, "variation"], 5))
    .select(SERIES, "variation", "rn", "residual", "rolling_mean"),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT, sql.flat_forecasts(), select="""
SELECT series_id, variation, rn, round(yhat - y, 4) AS residual,
  CASE WHEN count(*) OVER w = 5 THEN round(avg(yhat - y) OVER w, 4) END AS rolling_mean
FROM forecasts WINDOW w AS (PARTITION BY series_id, variation ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""))

# Composite, ranks and aggregates over runs and variations

add("composite_score", lambda spark, sf: tidy(r.composite_score(flat_metrics(suppliers(spark, sf)), keep_scores=True)).drop(*m.METRICS),
    sql.query(*flat(), sql.composite(), select=f"SELECT {_ID}, round(s_rmse, 6) AS s_rmse, round(s_mae, 6) AS s_mae, round(s_r2, 6) AS s_r2, "
              "round(s_mase, 6) AS s_mase, round(s_mape, 6) AS s_mape, round(composite_score, 6) AS composite_score FROM scored"))
add("rank_models", lambda spark, sf: tidy(flat_ranked(suppliers(spark, sf))),
    sql.query(*flat(), sql.composite(), sql.ranked(), select=f"SELECT {_ID}, {_METRICS}, round(composite_score, 6) AS composite_score, rank FROM ranked"))
add("sort_ranked", lambda spark, sf: tidy(flat_ranked(held_split_of(p.orders_daily(spark, sf)))).select(SERIES, "model", "composite_score", "rank")
    .orderBy(SERIES, F.desc("composite_score"), "model"),
    sql.query(p.ORDERS_DAILY, sql.features(), sql.SPLIT, sql.flat_forecasts(), sql.METRICS, sql.composite(), sql.ranked(),
              select="SELECT series_id, model, round(composite_score, 6) AS composite_score, rank FROM ranked ORDER BY 1, 3 DESC, 2"))
add("top_k", lambda spark, sf: tidy(r.top_k(flat_ranked(suppliers(spark, sf)), 2)).select(SERIES, "model", "rmse", "rank"),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="SELECT series_id, model, round(rmse, 4) AS rmse, rank FROM ranked WHERE rank <= 2"))
add("lead_margin", lambda spark, sf: tidy(r.lead_margin(flat_ranked(suppliers(spark, sf)))).select(SERIES, "model", "margin"),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="""
SELECT series_id, model, round(margin, 6) AS margin FROM (
  SELECT *, composite_score - lead(composite_score) OVER (PARTITION BY series_id ORDER BY rank) AS margin FROM ranked) WHERE rank = 1"""))
add("score_back_to_rows",
    lambda spark, sf: _scores_back(flat_metrics(suppliers(spark, sf))),
    sql.query(*flat(), sql.composite(), select="SELECT series_id, model_key, variation, run, round(rmse, 4) AS rmse, round(composite_score, 6) AS composite_score FROM scored"))


def _scores_back(metrics):
    back = r.score_back_to_rows(metrics, r.composite_score(metrics))
    return tidy(back).select(SERIES, "model_key", "variation", "run", "rmse", "composite_score")


_AGGREGATED = """
aggregated AS (
  SELECT series_id, model, model_key, variation, avg(mse) AS mse, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2,
         avg(mase) AS mase, avg(mape) AS mape, CASE WHEN count(rmse) > 1 THEN stddev_pop(rmse) ELSE 0.0 END AS rmse_std
  FROM metrics GROUP BY ALL)"""
add("aggregate_runs", lambda spark, sf: tidy(r.aggregate_runs(flat_metrics(suppliers(spark, sf), 3))),
    sql.query(*flat(3), _AGGREGATED, select=f"SELECT series_id, model, model_key, variation, {_METRICS}, round(rmse_std, 4) AS rmse_std FROM aggregated"))
_RUN_SCORED = sql.composite(by="series_id, run", name="run_scored")
add("run_composite_lookup", lambda spark, sf: tidy(r.run_composite_lookup(flat_metrics(suppliers(spark, sf), 3))),
    sql.query(*flat(3), _RUN_SCORED, select="SELECT series_id, run, model, round(composite_score, 6) AS composite_score FROM run_scored"))
add("composite_std", lambda spark, sf: tidy(r.composite_std(flat_metrics(suppliers(spark, sf), 3))),
    sql.query(*flat(3), _RUN_SCORED, select="SELECT series_id, model, round(stddev_pop(composite_score), 6) AS composite_std FROM run_scored GROUP BY ALL"))
add("best_per_run", lambda spark, sf: tidy(sweep.attach_config(r.best_per_run(flat_metrics(suppliers(spark, sf), 3))))
    .select(SERIES, "run", "model", "rmse", "composite_score", "params"),
    sql.query(*flat(3), _RUN_SCORED, select="""
SELECT series_id, run, model, round(rmse, 4) AS rmse, round(composite_score, 6) AS composite_score,
  '{"window": ' || (3 + 2 * variation) || '}' AS params
FROM run_scored QUALIFY row_number() OVER (PARTITION BY series_id, run ORDER BY round(composite_score, 9) DESC, model) = 1"""))
add("mean_prediction", lambda spark, sf: rounded(r.mean_prediction(flat_forecasts(suppliers(spark, sf), 3))).select(SERIES, "variation", TS, "yhat"),
    sql.query(*_BASE, sql.flat_forecasts(runs=3), select="SELECT series_id, variation, ts, round(avg(yhat), 4) AS yhat FROM forecasts GROUP BY ALL"))
add("median_by_model", lambda spark, sf: tidy(r.median_by_model(r.composite_score(flat_metrics(suppliers(spark, sf))), "model_key")),
    sql.query(*flat(), sql.composite(), select="SELECT series_id, model_key, "
              + ", ".join(f"round(median({c}), { {'rmse': 4, 'mae': 2}.get(c, 6) }) AS {c}" for c in ("composite_score", "rmse", "mae", "r2", "mase", "mape"))
              + " FROM scored GROUP BY ALL"))
add("best_variation", lambda spark, sf: r.best_variation(r.composite_score(flat_metrics(suppliers(spark, sf))), "model_key"),
    sql.query(*flat(), sql.composite(), select="SELECT series_id, model_key, variation AS best_variation FROM scored "
              "QUALIFY row_number() OVER (PARTITION BY series_id, model_key ORDER BY round(composite_score, 9) DESC, variation) = 1"))
add("attach_family", lambda spark, sf: names.attach_family(flat_metrics(suppliers(spark, sf))).select(SERIES, "model", "family"),
    sql.query(*flat(), select="SELECT series_id, model, 'Statistical' AS family FROM metrics"))
add("best_by_family", lambda spark, sf: tidy(r.best_by_family(names.attach_family(flat_ranked(suppliers(spark, sf))))).select(SERIES, "family", "model"),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="SELECT series_id, 'Statistical' AS family, model FROM ranked WHERE rank = 1"))
add("attach_config", lambda spark, sf: sweep.attach_config(flat_metrics(suppliers(spark, sf))).select(SERIES, "model", "params"),
    sql.query(*flat(), select="SELECT series_id, model, '{\"window\": ' || (3 + 2 * variation) || '}' AS params FROM metrics"))

# Candidates and folds

_MA_GRID = """
windows AS (SELECT unnest(range(2, 30))::INTEGER AS w),
candidate_means AS (
  SELECT h.series_id, w, avg(y) AS c FROM holdout h JOIN windows ON rn < n_fit AND rn >= n_fit - w AND w < least(30, n_fit // 2) GROUP BY ALL),
candidates AS (
  SELECT series_id, w, w - 2 AS candidate_no, sqrt(avg((y - c) ** 2)) AS rmse
  FROM holdout JOIN candidate_means USING (series_id) WHERE role = 'val' GROUP BY ALL)"""
add("tuning_artifacts",
    lambda spark, sf: tidy(ma_candidates(suppliers(spark, sf))).select(SERIES, "candidate_no", "params", "rmse", "chosen"),
    sql.query(*_BASE, sql.HOLDOUT, _MA_GRID, select="""
SELECT series_id, CAST(candidate_no AS INTEGER) AS candidate_no, '{"window":' || w || '}' AS params, round(rmse, 4) AS rmse,
  abs(rmse - min(rmse) OVER (PARTITION BY series_id)) < 1e-9 AS chosen FROM candidates"""))
add("best_candidate",
    lambda spark, sf: tidy(r.best_candidate(ma_candidates(suppliers(spark, sf)), [SERIES])),
    sql.query(*_BASE, sql.HOLDOUT, _MA_GRID, select="""
SELECT series_id, CAST(candidate_no AS INTEGER) AS candidate_no, '{"window":' || w || '}' AS params, round(rmse, 4) AS rmse
FROM candidates QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 9), candidate_no) = 1"""))


def _fold_means(split):
    """The flat mean of the last w training rows of every fold, w = 3, 5, 7, as fold candidates."""
    folds = splits.expanding_folds(split)
    start = splits.fold_start(F.col("fold"))
    reach = F.filter(F.array(F.lit(3), F.lit(5), F.lit(7)), lambda w: w >= start - F.col("rn"))
    tails = folds.where((F.col("role") == "fit") & (F.col("rn") >= start - 7)).withColumn("w", F.explode(reach))
    means = tails.groupBy(SERIES, "fold", "w").agg(F.avg(Y).alias("yhat"))
    return folds.where("role = 'val'").join(means, [SERIES, "fold"])


_FOLD_MEANS = """
fold_means AS (
  SELECT series_id, fold, w, avg(y) AS c FROM folds, (SELECT unnest([3, 5, 7]) AS w) WHERE rn < val_start AND rn >= val_start - w GROUP BY ALL),
fold_rows AS (SELECT f.series_id, f.fold, f.ts, w, y, c FROM folds f JOIN fold_means USING (series_id, fold) WHERE rn >= val_start),
fold_scores AS (SELECT series_id, fold, w, sqrt(avg((y - c) ** 2)) AS rmse FROM fold_rows GROUP BY ALL)"""
_FOLDED = (p.ORDERS_DAILY, sql.features(), sql.SPLIT, sql.FOLDS, _FOLD_MEANS)
add("candidate_by_fold", lambda spark, sf: rounded(_fold_means(held_split_of(p.orders_daily(spark, sf)))).select(SERIES, "fold", TS, "w", "yhat"),
    sql.query(*_FOLDED, select="SELECT series_id, fold, ts, w, round(c, 4) AS yhat FROM fold_rows"))
add("fold_score", lambda spark, sf: rounded(m.fold_score(_fold_means(held_split_of(p.orders_daily(spark, sf))), [SERIES, "fold", "w"])),
    sql.query(*_FOLDED, select="SELECT series_id, fold, w, round(rmse, 4) AS rmse FROM fold_scores"))
for _method, _fn in (("mean", "avg"), ("median", "median")):
    add("aggregate_folds" + ("" if _method == "mean" else "_median"),
        lambda spark, sf, method=_method: rounded(m.aggregate_folds(
            m.fold_score(_fold_means(held_split_of(p.orders_daily(spark, sf))), [SERIES, "fold", "w"]), [SERIES, "w"], method)),
        sql.query(*_FOLDED, select=f"SELECT series_id, w, round({_fn}(rmse), 4) AS rmse FROM fold_scores GROUP BY ALL"))


def _grid(spark, sf):
    """Every window below half the fit rows of each series, in grid order, first ten kept."""
    sized = splits.holdout_split(suppliers(spark, sf)).groupBy(SERIES).agg(F.any_value("n_fit").alias("n_fit"))
    last = F.least(F.lit(30), F.expr("n_fit div 2")) - 1
    windows = F.slice(F.sequence(F.lit(2).cast("bigint"), last.cast("bigint")), 1, 10)
    return sized.select(SERIES, F.posexplode(windows).alias("candidate_no", "window"))


add("candidate_grid", _grid,
    sql.query(*_BASE, sql.HOLDOUT, select="""
SELECT DISTINCT series_id, CAST(w - 2 AS INTEGER) AS candidate_no, w AS "window" FROM holdout, (SELECT unnest(range(2, 30)) AS w)
WHERE w < least(30, n_fit // 2) AND w < 12"""))

# Tasks, models, losses

_TASKS = ["ma", "lr", "rf"]
_TASK_ROWS = ", ".join(
    f"('{k}', {o}, {i})" for o, k in enumerate(_TASKS) for i in range(len(catalog.VARIATIONS[k]))
)
_TASK_CTE = f"""
tasks(model_key, model_order, variation) AS (VALUES {_TASK_ROWS}),
grid AS (SELECT DISTINCT series_id, run, model_key, model_order, variation FROM split, tasks, (SELECT unnest([1, 2, 3]) AS run))"""
add("task_grid", lambda spark, sf: sweep.task_grid(suppliers(spark, sf), _TASKS, 3).select(SERIES, "run", "model_key", "model_order", "variation"),
    sql.query(*_BASE, _TASK_CTE, select="SELECT series_id, run, model_key, model_order, variation FROM grid"))
add("order_tasks",
    lambda spark, sf: sweep.task_grid(held_split_of(p.returnflag_monthly(spark, sf)), _TASKS, 3)
    .select(SERIES, "run", "model_key", "model_order", "variation").orderBy(SERIES, "run", "model_order", "variation"),
    sql.query(p.RETURNFLAG_MONTHLY, sql.features(), sql.SPLIT, _TASK_CTE,
              select="SELECT series_id, run, model_key, model_order, variation FROM grid ORDER BY 1, 2, 4, 5"))
add("select_models",
    lambda spark, sf: sweep.task_grid(suppliers(spark, sf), ["MA", "nope", "LR"], 1).select(SERIES, "model_key").distinct(),
    sql.query(*_BASE, select="SELECT DISTINCT series_id, unnest(['ma', 'lr']) AS model_key FROM split"))
add("select_losses",
    lambda spark, sf: tuning.select_losses(sweep.task_grid(suppliers(spark, sf), _TASKS, 1).select(SERIES, "model_key").distinct(), ["l1", "huber"])
    .select(SERIES, "model_key", "loss"),
    sql.query(*_BASE, select="""
SELECT DISTINCT series_id, model_key, loss FROM split, (VALUES ('ma', NULL), ('lr', 'l1'), ('lr', 'huber'), ('rf', 'l1')) AS x(model_key, loss)"""))
_NAMED = """
named AS (
  SELECT series_id, rank, CASE rank WHEN 1 THEN model WHEN 2 THEN 'Linear Regression (L1) (α=0.1)' ELSE 'SARIMA[1, 1, 0]x[0, 1, 0, 12] (Tuned)' END AS model
  FROM ranked)"""


def _named(spark, sf):
    ranked = flat_ranked(suppliers(spark, sf)).select(SERIES, "rank", "model")
    other = F.when(F.col("rank") == 2, "Linear Regression (L1) (α=0.1)").otherwise("SARIMA[1, 1, 0]x[0, 1, 0, 12] (Tuned)")
    return ranked.withColumn("model", F.when(F.col("rank") == 1, F.col("model")).otherwise(other))


add("parse_model_name",
    lambda spark, sf: _named(spark, sf).withColumn("_m", names.parse_model_name(F.col("model"))).select(SERIES, "model", "_m.model_key", "_m.loss"),
    sql.query(*flat(), sql.composite(), sql.ranked(), _NAMED, select="""
SELECT series_id, model, CASE rank WHEN 1 THEN 'ma' WHEN 2 THEN 'lr' ELSE 'sarima' END AS model_key, CASE rank WHEN 2 THEN 'l1' END AS loss FROM named"""))
add("tune_candidates", lambda spark, sf: tuning.tune_candidates(_named(spark, sf), 3),
    sql.query(*flat(), sql.composite(), sql.ranked(), _NAMED, select="""
SELECT series_id, CASE rank WHEN 1 THEN 'ma' ELSE 'lr' END AS model_key, CASE rank WHEN 2 THEN 'l1' END AS loss, rank FROM named WHERE rank < 3"""))
add("dedupe_models",
    lambda spark, sf: tuning.dedupe_models(flat_ranked(suppliers(spark, sf)).withColumn("loss", F.lit(None).cast("string"))).select(SERIES, "model_key", "model", "rank"),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="SELECT series_id, model_key, model, rank FROM ranked WHERE rank = 1"))
add("display_name",
    lambda spark, sf: _display_names(suppliers(spark, sf), spark),
    sql.query(*_BASE, select="""
SELECT DISTINCT series_id, unnest(['ARIMA(1, 0, 0)', 'ARIMA(1, 1, 0)', 'ARIMA(2, 1, 0)',
  'SARIMA(1, 1, 0)x(0, 1, 1, ' || s || ')', 'SARIMA(1, 1, 1)x(1, 1, 1, ' || s || ')', 'SARIMA(2, 1, 0)x(0, 1, 1, ' || s || ')',
  'Moving Average (w=3)', 'Moving Average (w=5)', 'Moving Average (w=7)',
  'Exponential Smoothing (trend=add, seasonal=add)', 'Exponential Smoothing (trend=add, seasonal=None)',
  'Exponential Smoothing (trend=mul, seasonal=mul)', 'Prophet', 'Random Forest (L2)', 'Random Forest (L1)',
  'Random Forest (L2) (n=200)', 'XGBoost (L2)', 'XGBoost (L1)', 'XGBoost (Huber)', 'Linear Regression (L2)',
  'Linear Regression (L1) (α=0.1)', 'Linear Regression (Huber)']) AS model
FROM (SELECT series_id, CASE WHEN n_train > 104 THEN 52 WHEN n_train > 24 THEN 12 ELSE 4 END AS s FROM split)"""))


def _display_names(split, spark):
    tasks = sweep.task_grid(split, list(catalog.VARIATIONS), 1)
    model = names.display_name("model_key", "params", splits.PERIOD_SQL)
    return tasks.select(SERIES, model.alias("model")).distinct()


add("format_report", lambda spark, sf: names.format_report(flat_ranked(suppliers(spark, sf)).withColumn("mae", F.round("mae", 2))),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="SELECT series_id, rank, model, "
              + ", ".join(f"coalesce(printf('%.{d}f', {'round(mae, 2)' if c == 'mae' else c}), '') AS {c}" for c, d in names.REPORT_DECIMALS.items()) + " FROM ranked"))
add("judgment_text",
    lambda spark, sf: names.judgment_text(names.attach_family(r.lead_margin(flat_ranked(suppliers(spark, sf))))).select(SERIES, "judgment"),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="""
SELECT series_id, concat_ws(' ', printf('Recommended model: %s (composite score: %.4f).', model, composite_score),
  'It achieves best overall balance across RMSE, MAE, R², MASE, and MAPE.',
  CASE WHEN r2 >= 0.7 THEN 'Strong explanatory power (R² ≥ 0.7).' WHEN r2 >= 0.5 THEN 'Moderate explanatory power (0.5 ≤ R² < 0.7).'
       WHEN r2 >= 0 THEN 'Low explanatory power (0 ≤ R² < 0.5); consider alternatives if interpretability matters.'
       ELSE 'Negative R² indicates model underperforms a constant mean; review data and features.' END,
  CASE WHEN mase < 1 THEN 'MASE < 1: outperforms a naïve baseline.'
       WHEN mase >= 1 THEN printf('MASE = %.2f: consider simpler baselines if parsimony is important.', mase) END,
  printf('Leads 2nd place by %.3f composite points.', margin), 'Model family: Statistical.') AS judgment
FROM (SELECT *, composite_score - lead(composite_score) OVER (PARTITION BY series_id ORDER BY rank) AS margin FROM ranked) WHERE rank = 1"""))
add("normalization_entry",
    lambda spark, sf: _normalization(suppliers(spark, sf)),
    sql.query(*_BASE, select="""
SELECT DISTINCT series_id, params, "type", scope, description, range_text FROM split, (VALUES
  ('none', '{}', 'none', NULL, NULL, NULL),
  ('none', '{"scaler": "minmax", "feature_range": [0, 1]}', 'MinMaxScaler', 'target', 'Scaler from variation: minmax', '0.0,1.0'),
  ('X', '{"scaler": "robust"}', 'RobustScaler', 'X', 'fitted on train', NULL),
  ('target', '{}', 'StandardScaler', 'target', 'fitted on train', NULL)) AS x(scaling, params, "type", scope, description, range_text)"""))


def _normalization(split):
    cases = [("none", "{}"), ("none", '{"scaler": "minmax", "feature_range": [0, 1]}'), ("X", '{"scaler": "robust"}'), ("target", "{}")]
    options = F.array(*[F.struct(F.lit(s).alias("scaling"), F.lit(j).alias("params")) for s, j in cases])
    rows = split.select(SERIES).distinct().withColumn("_o", F.explode(options)).select(SERIES, "_o.*")
    entry = configs.normalization_entry(F.col("scaling"), F.lit("fitted on train"), F.col("params"))
    return rows.withColumn("_e", entry).select(
        SERIES, "params", "_e.type", "_e.scope", "_e.description", F.array_join(F.col("_e.feature_range").cast("array<string>"), ",").alias("range_text")
    )


_SOURCE = {"file": "lineitem.parquet", "time_col": "l_shipdate", "data_col": "revenue"}


def _configs(split, spark):
    rows = sweep.task_grid(split, ["ma", "lr"], 1).withColumn(
        "model", names.display_name("model_key", "params", splits.PERIOD_SQL)
    )
    return configs.run_config(rows, splits.dataset_profile(split), _SOURCE)


def _flat_configs(spark, sf):
    chosen = {
        "": ("display_name", "tuned", "variation_spec", "hyperparameters", "hyperparameters_source", "selection_metric"),
        "setup.": ("data_file", "time_column", "data_column", "test_size", "lags", "lags_built", "rolling_window", "ma_window",
                   "n_runs", "total_samples", "training_samples", "testing_samples"),
        "normalization.": ("type", "scope", "description"),
    }
    columns = [F.col(f"config.{part}{c}").alias(c) for part, fields in chosen.items() for c in fields]
    return _configs(suppliers(spark, sf), spark).select(SERIES, "model_key", "variation", *columns)


add("run_config", _flat_configs,
    sql.query(*_BASE, select=f"""
SELECT series_id, model_key, variation, display_name, false AS tuned, variation_spec, hyperparameters, 'default_variation' AS hyperparameters_source,
  CAST(NULL AS VARCHAR) AS selection_metric, 'lineitem.parquet' AS data_file, 'l_shipdate' AS time_column, 'revenue' AS data_column,
  0.2::DOUBLE AS test_size, lags, 7 AS lags_built, 3 AS rolling_window, 5 AS ma_window, 3 AS n_runs, count(*) AS total_samples,
  count(*) FILTER (is_train) AS training_samples, count(*) FILTER (NOT is_train) AS testing_samples,
  CASE model_key WHEN 'lr' THEN 'StandardScaler' ELSE 'none' END AS "type", CASE model_key WHEN 'lr' THEN 'X_and_y' END AS scope,
  CASE model_key WHEN 'lr' THEN '{configs.PER_SERIES}' END AS description
FROM split, (VALUES
  ('ma', 0, 'Moving Average (w=3)', 7, '{{"window": 3}}', '{{"window": 3}}'),
  ('ma', 1, 'Moving Average (w=5)', 7, '{{"window": 5}}', '{{"window": 5}}'),
  ('ma', 2, 'Moving Average (w=7)', 7, '{{"window": 7}}', '{{"window": 7}}'),
  ('lr', 0, 'Linear Regression (L2)', 3, '{{"loss": "l2", "lags": 3}}', '{{"loss": "l2", "lags": 3}}'),
  ('lr', 1, 'Linear Regression (L1) (α=0.1)', 5, '{{"loss": "l1", "alpha": 0.1, "lags": 5}}', '{{"loss": "l1", "alpha": 0.1, "lags": 5}}'),
  ('lr', 2, 'Linear Regression (Huber)', 7, '{{"loss": "huber", "lags": 7}}', '{{"loss": "huber", "lags": 7}}'))
  AS x(model_key, variation, display_name, lags, variation_spec, hyperparameters)
GROUP BY ALL"""))

# Report tables

add("report_table", lambda spark, sf: report.report_table(flat_ranked(suppliers(spark, sf)).withColumn("mae", F.round("mae", 2)), 20),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="SELECT series_id, rank, model, "
              + ", ".join(f"round({c}, {2 if c == 'mae' else 4}) AS {c}" for c in ("composite_score", "rmse", "mae", "r2", "mase", "mape")) + " FROM ranked WHERE rank <= 20"))
add("chart_trellis", lambda spark, sf: _trellis(suppliers(spark, sf)),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="""
SELECT s.series_id, k.model_key, k.variation, s.ts, s.is_train, round(s.y, 4) AS y, k.rank, round(k.composite_score, 4) AS composite_score,
  round(k.rmse, 4) AS rmse, round(k.r2, 4) AS r2, round(f.yhat, 4) AS yhat
FROM split s JOIN ranked k USING (series_id)
LEFT JOIN forecasts f ON f.series_id = s.series_id AND f.ts = s.ts AND f.variation = k.variation WHERE rank <= 9"""))


def _trellis(split):
    forecasts = flat_forecasts(split)
    return rounded(report.chart_trellis(flat_ranked(split), forecasts, split))


add("chart_top3", lambda spark, sf: _top3(held_split_of(p.orders_daily(spark, sf))),
    sql.query(p.ORDERS_DAILY, sql.features(), sql.SPLIT, sql.flat_forecasts(), sql.METRICS, sql.composite(), sql.ranked(), select="""
SELECT l.series_id, l.ts, line, round("value", 4) AS "value",
  NOT s.is_train AND s.rn - s.n_train >= (s.n - s.n_train) // 2 - (s.n - s.n_train) // 4 AND s.rn - s.n_train < (s.n - s.n_train) // 2 + (s.n - s.n_train) // 4 AS zoom
FROM (SELECT series_id, ts, 'train' AS line, y AS "value" FROM split WHERE is_train AND rn >= floor(n_train * 0.85::DOUBLE)
      UNION ALL SELECT series_id, ts, 'test', y FROM split WHERE NOT is_train
      UNION ALL SELECT series_id, ts, 'rank ' || rank, yhat FROM forecasts JOIN ranked USING (series_id, variation) WHERE rank <= 3) l
JOIN split s ON s.series_id = l.series_id AND s.ts = l.ts"""))


def _top3(split):
    return rounded(report.chart_top3(flat_ranked(split), flat_forecasts(split), split))


add("chart_performance", lambda spark, sf: rounded(report.chart_performance(flat_ranked(suppliers(spark, sf))), 2),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="""
SELECT series_id, model, rank, rank <= 3 AS top3, metric, round("value", 2) AS "value",
  coalesce(CASE metric WHEN 'r2' THEN "value" < 0 WHEN 'mase' THEN "value" > 1 ELSE false END, false) AS warn
FROM (SELECT series_id, model, rank, unnest(['composite_score', 'rmse', 'mae', 'r2', 'mase', 'mape']) AS metric,
        unnest([composite_score, rmse, mae, r2, coalesce(mase, 10.0), least(mape, 200.0)]) AS "value" FROM ranked)"""))
add("chart_clip", lambda spark, sf: rounded(report.chart_performance(flat_ranked(held_split_of(p.event_readings(spark, sf))))
                                            .where("metric in ('mase', 'mape')")).select(SERIES, "model", "metric", "value"),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT, sql.flat_forecasts(), sql.METRICS, select="""
SELECT series_id, model, unnest(['mase', 'mape']) AS metric, round(unnest([coalesce(mase, 10.0), least(mape, 200.0)]), 4) AS "value" FROM metrics"""))
add("chart_radar", lambda spark, sf: rounded(report.chart_radar(flat_ranked(suppliers(spark, sf)), 2)),
    sql.query(*flat(), sql.composite(), sql.ranked(),
              "best AS (SELECT series_id, model_key, model, variation, run, rank, composite_score AS first_score, mse, rmse, mae, r2, mase, mape FROM ranked WHERE rank <= 2)",
              sql.composite("best", name="again"),
              select="SELECT series_id, model, rank, round(first_score, 4) AS composite_score, round(s_rmse, 4) AS s_rmse, round(s_mae, 4) AS s_mae, "
              "round(s_r2, 4) AS s_r2, round(s_mase, 4) AS s_mase, round(s_mape, 4) AS s_mape FROM again"))
add("chart_residuals", lambda spark, sf: _residual_chart(suppliers(spark, sf)),
    sql.query(*flat(), sql.composite(), sql.ranked(), select="""
SELECT series_id, model_key, variation, rank, ts, round(yhat - y, 4) AS residual,
  CASE WHEN count(*) OVER w = 5 THEN round(avg(yhat - y) OVER w, 4) END AS rolling_mean
FROM (SELECT f.*, k.rank FROM forecasts f JOIN ranked k USING (series_id, variation) WHERE k.rank <= 3)
WINDOW w AS (PARTITION BY series_id, variation ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""))


def _residual_chart(split):
    return rounded(report.chart_residuals(flat_ranked(split), flat_forecasts(split)))


# Sinks: write, read back, compare

_DATE = "2024-01-31"


def _comparison(spark, sf):
    path = scratch_path(spark, "comparison")
    sinks.write_comparison(tidy(flat_ranked(suppliers(spark, sf))), path, "lineitem", _DATE)
    back = spark.read.option("header", True).schema(
        "series_id string, rank int, model string, composite_score double, rmse double, mae double, r2 double, mase double, mape double, "
        "dataset string, run_date string"
    ).csv(path)
    return back


add("write_comparison", _comparison,
    sql.query(*flat(), sql.composite(), sql.ranked(),
              select=f"SELECT series_id, rank, model, round(composite_score, 6) AS composite_score, {_METRICS}, 'lineitem' AS dataset, '{_DATE}' AS run_date FROM ranked")
    .replace("round(mse, 2) AS mse, ", ""))


def _layout(spark, sf):
    return sinks.results_layout(flat_ranked(suppliers(spark, sf)).select(SERIES, "model", "rank"), "lineitem", _DATE)


add("results_layout", _layout,
    sql.query(*flat(), sql.composite(), sql.ranked(), select=f"SELECT series_id, model, rank, 'lineitem' AS dataset, '{_DATE}' AS run_date FROM ranked"))


def _written_configs(spark, sf):
    split = suppliers(spark, sf)
    path = scratch_path(spark, "configs")
    ranked = flat_ranked(split).withColumnRenamed("variation", "best_variation")
    sinks.write_configs(_configs(split, spark), ranked, path, "lineitem", _DATE)
    back = spark.read.json(path)
    return back.select(SERIES, F.col("rank").cast("int").alias("rank"), "model_key", "display_name", F.col("setup.training_samples").alias("training_samples"))


add("write_configs", _written_configs,
    sql.query(*flat(), sql.composite(), sql.ranked(), select="""
SELECT series_id, rank, model_key, model AS display_name, (SELECT count(*) FILTER (is_train) FROM split s WHERE s.series_id = ranked.series_id) AS training_samples FROM ranked"""))


def _written_summary(spark, sf):
    """Every result of every series as written and read back, with its dataset and the best of its first run."""
    split = suppliers(spark, sf)
    path = scratch_path(spark, "summary")
    metrics = flat_metrics(split, 3)
    ranked = flat_ranked(split)
    judged = names.judgment_text(names.attach_family(r.lead_margin(ranked)))
    settings = {
        "params": catalog.params_of(), "hyperparameters": configs.hyperparameters(),
        "hyperparameters_source": F.lit("default_variation"),
    }
    rows = sinks.summary(splits.dataset_profile(split), judged, ranked.withColumns(settings), r.best_per_run(metrics),
                         source=_SOURCE)
    sinks.write_summary(rows, path, "lineitem", _DATE)
    back = spark.read.json(path).withColumn("_r", F.explode("results"))
    return tidy(back.select(
        SERIES, "data.file", "data.training_samples", F.size("best_per_run").alias("n_runs"),
        F.col("best_per_run")[0]["best_model"].alias("first_run_best"), F.col("_r.rank").cast("int").alias("rank"),
        "_r.model", *[F.col(f"_r.{c}") for c in ("composite_score", "rmse", "mae", "r2", "mase", "mape")],
        "_r.variation_spec", "_r.hyperparameters", "_r.hyperparameters_source",
    ))


add("write_summary", _written_summary,
    sql.query(*flat(3), "first_run AS (SELECT * FROM metrics WHERE run = 1)", sql.composite("first_run"), sql.ranked(), _RUN_SCORED, select=f"""
SELECT series_id, 'lineitem.parquet' AS file, training_samples, n_runs, first_run_best, rank, model, round(composite_score, 4) AS composite_score,
  {_METRICS}, '{{"window": ' || (3 + 2 * variation) || '}}' AS variation_spec, '{{"window": ' || (3 + 2 * variation) || '}}' AS hyperparameters,
  'default_variation' AS hyperparameters_source
FROM ranked
JOIN (SELECT series_id, count(*) FILTER (is_train) AS training_samples FROM split GROUP BY ALL) USING (series_id)
JOIN (SELECT series_id, CAST(count(DISTINCT run) AS INTEGER) AS n_runs FROM run_scored GROUP BY ALL) USING (series_id)
JOIN (SELECT series_id, arg_min(model, (-round(composite_score, 9), model)) AS first_run_best FROM run_scored WHERE run = 1 GROUP BY ALL) USING (series_id)"""
).replace("round(mse, 2) AS mse, ", ""))


def _written_candidates(spark, sf):
    path = scratch_path(spark, "candidates")
    sinks.write_candidates(tidy(ma_candidates(suppliers(spark, sf))), path)
    return spark.read.parquet(path).select(SERIES, "model_key", "candidate_no", "rmse")


add("write_candidates", _written_candidates,
    sql.query(*_BASE, sql.HOLDOUT, _MA_GRID, select="SELECT series_id, 'ma' AS model_key, CAST(candidate_no AS INTEGER) AS candidate_no, round(rmse, 4) AS rmse FROM candidates"))
add("validation_summary",
    lambda spark, sf: tidy(sinks.validation_summary(ma_candidates(suppliers(spark, sf)))).withColumn("validation_score", F.round("validation_score", 4)),
    sql.query(*_BASE, sql.HOLDOUT, _MA_GRID, select="""
SELECT series_id, 'ma' AS model_key, '{"window":' || w || '}' AS best_params, round(rmse, 4) AS validation_score, 'rmse' AS selection_metric,
  true AS refit_on_full_train
FROM candidates QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 9), candidate_no) = 1"""))

__all__ = ["ORACLES", "QUERIES"]
