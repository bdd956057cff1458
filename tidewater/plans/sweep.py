"""Run every model in three variations, score, rank and recommend."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast import ar, es, linear, ma, trees, trend
from tidewater.forecast.common import HORIZON, forecast_rows, test_rows
from tidewater.functions import catalog
from tidewater.functions.names import attach_family, display_name, judgment_text
from tidewater.operators import ranking
from tidewater.operators.metrics import evaluate
from tidewater.operators.positions import SERIES, TS, Y, one_row_per_date
from tidewater.operators.splits import PERIOD_SQL

# The extension point: model key -> function(split, specs) returning forecast rows, where specs are
# the variations to run.
Forecaster = Callable[[DataFrame, list[dict]], DataFrame]
# Models of a sweep, and variations of a tree model, that are fitted at the same time.
PARALLEL_FITS = 3


@dataclass(frozen=True)
class Registry:
    """The models a sweep can run and their variations. Adding a model gives a new registry."""

    forecasters: Mapping[str, Forecaster]
    variations: Mapping[str, list[dict]]


def register_forecaster(model_key: str, forecaster: Forecaster, variations: list[dict], registry: Registry | None = None) -> Registry:
    """The registry (default: the models built here) with one more model, or with one replaced."""
    known = registry or BUILT_IN
    return Registry({**known.forecasters, model_key: forecaster}, {**known.variations, model_key: variations})


def per_series_forecaster(model_key: str, predict: Callable) -> Forecaster:
    """Wrap ``predict(train_y, horizon, spec) -> values`` (NumPy) into a forecaster.

    Every series is one group, so this takes panels of dates only, where the calendar bounds a series.
    """

    def forecaster(split: DataFrame, specs: list[dict]) -> DataFrame:
        if not one_row_per_date(split):
            raise ValueError("a per-series forecaster needs a panel with one row per series and date")

        def run(pdf):
            pdf = pdf.sort_values("rn")
            train, test = pdf[pdf["is_train"]], pdf[~pdf["is_train"]]
            out = [
                test.assign(variation=i, yhat=predict(train[Y].to_numpy(), len(test), spec))
                for i, spec in enumerate(specs)
            ]
            return pd.concat(out)[[SERIES, "variation", TS, "rn", "n_train", Y, "yhat"]]

        rows = split.select(SERIES, TS, "rn", "n_train", Y, "is_train")
        time_type = rows.schema[TS].dataType.simpleString()
        schema = f"{SERIES} string, variation int, {TS} {time_type}, rn long, n_train long, {Y} double, yhat double"
        made = rows.groupBy(SERIES).applyInPandas(run, schema)
        return forecast_rows(made, model_key, F.col("yhat"), HORIZON)

    return forecaster


def failed_fit(split: DataFrame, model_key: str, variation: int, error: str) -> DataFrame:
    """The test rows without a forecast, and why."""
    rows = test_rows(split).withColumn("variation", F.lit(variation))
    return forecast_rows(rows, model_key, F.lit(None).cast("double")).withColumn("error", F.lit(error))


def union_forecasts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _at_once(run: Callable, *items) -> list:
    """``run`` for all items a few at a time, in their order: fits are chains of small jobs, which leave cores idle."""
    with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:
        return list(pool.map(run, *items))


def _orders(specs):
    """The orders as named: (p, d, q), and (P, D, Q) where there is a season."""
    out = []
    for s in specs:
        (p, d, q), (P, D, Q) = s["order"], s.get("seasonal_order", [0, 0, 0])[:3]
        out.append(ar.order(p, d, P, D, q, Q))
    return out


def _trees(model_key):
    def forecaster(split, specs):
        def fitted(i, spec):
            try:
                return trees.forecast_trees(split, model_key, spec, i)
            except ValueError as reason:  # a loss MLlib does not offer
                return failed_fit(split, model_key, i, str(reason))

        return union_forecasts(_at_once(fitted, range(len(specs)), specs))

    return forecaster


BUILT_IN = Registry(
    {
        "ma": lambda split, specs: ma.forecast_ma(split, [s["window"] for s in specs]),
        "arima": lambda split, specs: ar.forecast_ar(split, _orders(specs)),
        "sarima": lambda split, specs: ar.forecast_seasonal_ar(split, _orders(specs)),
        "es": lambda split, specs: es.forecast_es(split, [(s["trend"], s["seasonal"]) for s in specs]),
        "prophet": trend.forecast_trend_seasonal,
        "lr": linear.forecast_linear,
        "rf": _trees("rf"),
        "xgb": _trees("xgb"),
    },
    catalog.VARIATIONS,
)


def select_models(requested: list[str] | None = None, registry: Registry = BUILT_IN) -> list[str]:
    """The requested models that exist, lower-cased, in request order; None or "all" is every model.

    Names that don't exist are warned about; if none is left, that is an error.
    """
    if requested is None or "all" in requested:
        return list(registry.forecasters)
    names = [m.lower() for m in requested]
    unknown = [m for m in names if m not in registry.forecasters]
    message = f"unknown models: {', '.join(unknown)}; known are {', '.join(registry.forecasters)}"
    if len(unknown) == len(names):
        raise ValueError(message)
    if unknown:
        warnings.warn(message, stacklevel=2)
    return [m for m in names if m in registry.forecasters]


def run_forecaster(split: DataFrame, model_key: str, specs: list[dict] | None = None, registry: Registry = BUILT_IN) -> DataFrame:
    return registry.forecasters[model_key](split, specs or registry.variations[model_key])


def task_grid(split: DataFrame, models: list[str] | None = None, n_runs: int = 1, registry: Registry = BUILT_IN) -> DataFrame:
    """One row per series, run, model and variation, in the order models were asked for."""
    names = select_models(models, registry)
    tasks = [
        (m, order, i, json.dumps(spec)) for order, m in enumerate(names) for i, spec in enumerate(registry.variations[m])
    ]
    literal = F.array(
        *[
            F.struct(F.lit(m).alias("model_key"), F.lit(o).alias("model_order"), F.lit(i).alias("variation"), F.lit(p).alias("params"))
            for m, o, i, p in tasks
        ]
    )
    series = split.groupBy(SERIES).agg(F.count_if("is_train").alias("n_train"))
    return (
        series.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))
        .withColumn("_t", F.explode(literal))
        .select(SERIES, "n_train", "run", "_t.*")
    )


def name_forecasts(forecasts: DataFrame, split: DataFrame, registry: Registry = BUILT_IN) -> DataFrame:
    """Add params (JSON of the variation) and the display name."""
    if "n_train" not in forecasts.columns:
        forecasts = forecasts.join(split.groupBy(SERIES).agg(F.max("n_train").alias("n_train")), SERIES)
    named = forecasts.withColumn("params", catalog.params_of(registry.variations))
    return named.withColumn("model", display_name("model_key", "params", PERIOD_SQL)).drop("n_train")


def sweep(split: DataFrame, models: list[str] | None = None, n_runs: int = 1, registry: Registry = BUILT_IN) -> DataFrame:
    """Forecast rows of all models and variations; a failed variation has rows without forecast and an
    ``error``. The models here are deterministic, so further runs repeat the first; user models may
    differ from run to run."""
    forecasts = union_forecasts(_at_once(lambda m: run_forecaster(split, m, None, registry), select_models(models, registry)))
    if "error" not in forecasts.columns:
        forecasts = forecasts.withColumn("error", F.lit(None).cast("string"))
    runs = F.explode(F.sequence(F.lit(1), F.lit(n_runs)))
    return name_forecasts(forecasts.withColumn("run", runs), split, registry)


def results(forecasts: DataFrame, split: DataFrame) -> DataFrame:
    """One row per series, model and variation: metrics averaged over runs, their deviation, composite, rank.

    A variation that failed, or whose forecast misses rows, has an ``error`` and neither score nor rank.
    """
    merged = ranking.aggregate_runs(evaluate(forecasts, split, failed=True), with_composite_std=True)
    fitted = F.col("error").isNull()
    scored = ranking.composite_score(merged).withColumns(
        {c: F.when(fitted, F.col(c)) for c in ("composite_score", "composite_std", "rmse_std")}
    )
    return ranking.rank_models(scored).withColumn("rank", F.when(fitted, F.col("rank")))


def comparison(scored: DataFrame) -> DataFrame:
    """One row per series and model name that was fitted: medians over variations, best variation, rank."""
    fitted = scored.where(F.col("error").isNull()) if "error" in scored.columns else scored
    return attach_family(ranking.rank_models(ranking.merge_variations(fitted)))


def recommendation(table: DataFrame) -> DataFrame:
    """The best model per series and why. The medians are scored again, so the named best can differ
    from the first row of the comparison; both ranks are kept."""
    rescored = ranking.rank_models(ranking.composite_score(table.withColumnRenamed("rank", "comparison_rank")))
    return judgment_text(ranking.lead_margin(rescored))


def attach_config(rows: DataFrame, registry: Registry = BUILT_IN) -> DataFrame:
    """Parameters of the variation by key; an empty object where there are none."""
    return rows.withColumn("params", catalog.params_of(registry.variations))
