"""Choosing what to tune, tuning it on training rows only, and appending the results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.forecast import ar, es, linear, ma, trees, trend
from tidewater.functions import catalog
from tidewater.functions.names import parse_model_name, tuned_name
from tidewater.operators.positions import SERIES
from tidewater.session import cut_lineage

# Model key -> function(split, loss) returning (candidates, forecasts with params).
TUNERS = {
    "ma": lambda split, loss: ma.tune_ma(split),
    "arima": lambda split, loss: ar.tune_ar(split),
    "sarima": lambda split, loss: ar.tune_seasonal_ar(split),
    "es": lambda split, loss: es.tune_es(split),
    "prophet": lambda split, loss: trend.tune_trend_seasonal(split),
    "lr": lambda split, loss: linear.tune_linear(split, loss or "l2"),
    "rf": lambda split, loss: trees.tune_trees(split, "rf", loss or "l2")[:2],
    "xgb": lambda split, loss: trees.tune_trees(split, "xgb", loss or "l2")[:2],
}


def losses_for(model_key: str, requested: list[str] | None = None) -> list[str | None]:
    """Supported and requested losses; a model without losses gives one None."""
    if model_key not in catalog.LOSSES_BY_MODEL:
        return [None]
    return [x for x in catalog.LOSSES_BY_MODEL[model_key] if requested is None or x in requested]


def select_losses(rows: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Every row once per loss to try: supported and requested; one NULL where a model has no losses."""
    table = catalog.loss_table(rows.sparkSession)
    joined = rows.join(F.broadcast(table), "model_key", "left")
    if requested is None:
        return joined
    return joined.where(F.col("loss").isNull() | F.col("loss").isin(requested))


def tune_candidates(ranked: DataFrame, n: int) -> DataFrame:
    """Distinct (model_key, loss) of the first n ranked rows that are known and not tuned yet."""
    parsed = ranked.where((F.col("rank") <= n) & ~F.lower("model").contains("tuned"))
    named = parsed.withColumn("_m", parse_model_name(F.col("model")))
    known = named.where(F.col("_m.model_key").isin(list(catalog.DISPLAY_NAMES)))
    return known.groupBy(SERIES, F.col("_m.model_key").alias("model_key"), F.col("_m.loss").alias("loss")).agg(
        F.min("rank").alias("rank")
    )


def dedupe_models(rows: DataFrame) -> DataFrame:
    """The best-ranked row per series, model key and loss."""
    w = Window.partitionBy(SERIES, "model_key", "loss").orderBy("rank")
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def tune_models(split: DataFrame, chosen: list[tuple[str, str | None]]) -> tuple[DataFrame, DataFrame]:
    """(candidates, forecasts) of the given (model_key, loss) pairs, named and with their params."""
    candidates, forecasts = [], []
    for model_key, loss in chosen:
        c, f = TUNERS[model_key](split, loss)
        candidates.append(
            c.groupBy(SERIES, "candidate_no", "params").agg(F.avg("rmse").alias("rmse")).withColumns(
                {"model_key": F.lit(model_key), "loss": F.lit(loss).cast("string")}
            )
        )
        name = tuned_name("model_key", "params", f"'{loss}'" if loss else "''")
        forecasts.append(f.withColumns({"run": F.lit(1), "model": name}))
    return reduce(DataFrame.unionByName, candidates), reduce(DataFrame.unionByName, forecasts)


def tune_top_models(split: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """Tuned forecasts of the models ranked in the first n of each series.

    Every pair of model and loss that some series ranks there is tuned for the series that rank it: the
    pairs are at most as many as there are tuners and losses. Models without a tuner stay untuned.
    """
    # A few rows per series that every pair is matched with: computed once.
    wanted = cut_lineage(tune_candidates(ranked, n).select(SERIES, "model_key", "loss"))
    pairs = wanted.where(F.col("model_key").isin(list(TUNERS))).select("model_key", "loss").distinct().collect()
    parts = []
    for model_key, loss in sorted((tuple(x) for x in pairs), key=str):
        asked = wanted.where((F.col("model_key") == model_key) & F.col("loss").eqNullSafe(F.lit(loss)))
        _, forecasts = tune_models(split.join(asked, SERIES, "left_semi"), [(model_key, loss)])
        parts.append(forecasts)
    return reduce(DataFrame.unionByName, parts or [tune_models(split.where(F.lit(False)), [("ma", None)])[1]])


def union_tuned(base: DataFrame, tuned: DataFrame) -> DataFrame:
    return base.unionByName(tuned, allowMissingColumns=True)
