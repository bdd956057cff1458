"""Forecasts that miss rows get no score, and sinks keep what other runs wrote."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidewater.operators import metrics
from tidewater.sinks import results


def partial(spark):
    rows = [("whole", k, float(k), k + 1.0) for k in range(3)] + [("part", 0, 0.0, 0.0), ("part", 1, 1.0, None), ("part", 2, 2.0, float("nan"))]
    rows += [("gap", 0, 0.0, 1.0), ("gap", 1, None, None), ("gap", 2, 2.0, 3.0)]
    return spark.createDataFrame(
        [("a", m, dt.date(2024, 1, 1 + k), y, yhat) for m, k, y, yhat in rows], "series_id string, model string, ts date, y double, yhat double"
    )


def test_partial_forecasts_are_not_scored(spark):
    scored = {r["model"]: r["rmse"] for r in metrics.forecast_metrics(partial(spark)).collect()}
    assert scored == {"whole": 1.0, "gap": 1.0}
    folds = {r["model"]: r["rmse"] for r in metrics.fold_score(partial(spark), ["model"]).collect()}
    assert folds["part"] == math.inf and folds["whole"] == folds["gap"] == 1.0
    pinball = {r["model"]: r["pinball"] for r in metrics.pinball_loss(partial(spark), ["model"]).collect()}
    assert pinball["part"] is None and pinball["whole"] == 0.5


def test_sinks_keep_other_datasets_dates_and_models(spark, tmp_path):
    ranked = spark.createDataFrame([("a", 1, "M", "ma", 0)], "series_id string, rank int, Model string, model_key string, best_variation int")
    place = str(tmp_path / "rows")
    for dataset, day in (("one", "2024-01-01"), ("two", "2024-01-01"), ("one", "2024-01-02"), ("one", "2024-01-02")):
        results.write_summary(ranked, place, dataset, day)
    kept = spark.read.json(place)
    assert sorted((r["dataset"], str(r["run_date"])) for r in kept.collect()) == [
        ("one", "2024-01-01"), ("one", "2024-01-02"), ("two", "2024-01-01"),
    ]
    candidates = spark.createDataFrame([("a", "ma", 1.0), ("a", "es", 2.0)], "series_id string, model_key string, rmse double")
    models = str(tmp_path / "candidates")
    results.write_candidates(candidates.filter("model_key = 'ma'"), models)
    results.write_candidates(candidates.filter("model_key = 'es'"), models)
    assert {r["model_key"] for r in spark.read.parquet(models).collect()} == {"ma", "es"}


def test_ranked_model_without_configuration_stays(spark, tmp_path):
    ranked = spark.createDataFrame([("a", 1, "ma", 0), ("a", 2, "es", 1)], "series_id string, rank int, model_key string, best_variation int")
    configs = spark.createDataFrame([("a", "ma", 0)], "series_id string, model_key string, variation int").withColumn("config", F.struct(F.lit(3).alias("window")))
    place = str(tmp_path / "configs")
    results.write_configs(configs=configs, ranked=ranked, path=place, dataset="one", run_date="2024-01-01")
    assert {r["rank"]: r["window"] for r in spark.read.json(place).collect()} == {1: 3, 2: None}
