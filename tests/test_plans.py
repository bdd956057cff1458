import threading

import numpy as np
import pytest
from conftest import panel_frame, series
from pyspark.sql import functions as F

from tidewater.functions import catalog
from tidewater.operators.features import feature_table
from tidewater.operators.splits import chrono_split
from tidewater.plans import sweep, tuning


@pytest.fixture(scope="module")
def split(spark):
    data = {"a": series(120, 1), "b": series(130, 2, "season")}
    return chrono_split(feature_table(panel_frame(spark, data))).persist()


@pytest.fixture(scope="module")
def swept(split):
    return sweep.sweep(split, ["MA", "arima", "lr", "unknown"], 2).persist()


def test_selection():
    with pytest.warns(UserWarning, match="nope"):
        assert sweep.select_models(["MA", "nope"]) == ["ma"]
    with pytest.raises(ValueError, match="known are ma"):
        sweep.select_models(["nope"])
    assert set(sweep.select_models(["all"])) >= set(catalog.VARIATIONS)
    assert sweep.select_models() == sweep.select_models(["all"])
    assert tuning.losses_for("ma") == [None] and tuning.losses_for("rf", ["huber", "l1"]) == ["l1"]


def test_sweep_scores_every_variation_once(split, swept):
    table = sweep.results(swept, split).toPandas()
    assert len(table) == 2 * 9
    assert (table.rmse_std == 0).all() and (table.composite_std.abs() < 1e-12).all()
    for _, g in table.groupby("series_id"):
        assert sorted(g["rank"]) == list(range(1, 10))
        assert g.sort_values("rank").composite_score.is_monotonic_decreasing
    assert {"Moving Average (w=5)", "ARIMA(2, 1, 0)", "Linear Regression (L1) (α=0.1)"} <= set(table.model)


def test_comparison_and_recommendation(split, swept):
    table = sweep.comparison(sweep.results(swept, split))
    best = sweep.recommendation(table).toPandas()
    assert set(best.series_id) == {"a", "b"} and best.judgment.str.startswith("Recommended model: ").all()
    assert set(table.toPandas().family) == {"Statistical", "ML"}


def test_tuning_the_best(split, swept):
    ranked = sweep.comparison(sweep.results(swept, split))
    wanted = tuning.tune_candidates(ranked, 2).toPandas()
    tuned = tuning.tune_top_models(split, ranked, 2)
    got = tuned.select("series_id", "model_key", "model").distinct().toPandas()
    assert len(got) == len(wanted) and got.model.str.contains("Tuned").all()
    again = tuning.union_tuned(swept, tuned)
    assert again.count() == swept.count() + tuned.count()


def test_tuned_names_are_not_tuned_again(spark):
    ranked = spark.createDataFrame(
        [("s", 1, "ARIMA(1, 0, 0) (Tuned)"), ("s", 2, "Random Forest (L2)"), ("s", 3, "Random Forest (L2) (n=200)"), ("s", 4, "Odd")],
        "series_id string, rank int, model string",
    )
    got = tuning.tune_candidates(ranked, 4).collect()
    assert [(x.model_key, x.loss, x["rank"]) for x in got] == [("rf", "l2", 2)]


def test_user_model_joins_the_sweep(split):
    forecaster = sweep.per_series_forecaster("naive", lambda y, h, spec: np.full(h, y[-1] * spec["k"]))
    known = sweep.register_forecaster("naive", forecaster, [{"k": 1.0}, {"k": 2.0}])
    table = sweep.results(sweep.sweep(split, ["naive", "ma"], registry=known), split)
    assert table.where("model_key = 'naive' and rmse > 0").count() == 4
    with pytest.raises(ValueError):
        sweep.run_forecaster(split.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "naive", registry=known)
    assert "naive" not in sweep.select_models() and "naive" not in catalog.VARIATIONS


def test_failed_fits_stay_as_rows_without_rank(split):
    def half(y, h, spec):
        out = np.full(h, y[-1])
        out[spec["from"] :] = np.nan
        return out

    def absent(split, specs):
        return sweep.union_forecasts([sweep.failed_fit(split, "absent", i, "no such loss") for i in range(len(specs))])

    known = sweep.register_forecaster("half", sweep.per_series_forecaster("half", half), [{"from": 1}, {"from": 10_000}])
    known = sweep.register_forecaster("absent", absent, [{}], known)
    scored = sweep.results(sweep.sweep(split, ["half", "absent", "ma"], 2, known), split).persist()
    rows = {(x.model_key, x.variation): x for x in scored.where("series_id = 'a'").collect()}
    assert len(rows) == 6
    assert rows["absent", 0].error == "no such loss" and rows["half", 0].error == "the forecast misses rows"
    for x in (rows["absent", 0], rows["half", 0]):
        assert x["rank"] is None and x.rmse is None and x.composite_score is None
    assert sorted(x["rank"] for x in rows.values() if x.error is None) == [1, 2, 3, 4]
    assert "absent" not in sweep.comparison(scored).toPandas().model_key.tolist()


def test_tuning_without_known_models_gives_no_rows(spark, split):
    ranked = spark.createDataFrame([("a", 1, "Odd")], "series_id string, rank int, model string")
    assert tuning.tune_top_models(split, ranked, 3).count() == 0


def test_task_grid_order(split):
    tasks = sweep.task_grid(split, ["lr", "ma"], 2).where("series_id = 'a'")
    rows = tasks.orderBy("run", "model_order", "variation").collect()
    assert [(x.run, x.model_key, x.variation) for x in rows[:4]] == [(1, "lr", 0), (1, "lr", 1), (1, "lr", 2), (1, "ma", 0)]
    assert len(rows) == 12


def test_tree_variations_are_fitted_at_once(split, monkeypatch):
    meet = threading.Barrier(3, timeout=30)

    def fit(split, model_key, spec, variation):
        meet.wait()  # broken unless all three are there
        if variation == 1:
            raise ValueError("no such loss")
        return sweep.failed_fit(split, model_key, variation, "none")

    monkeypatch.setattr(sweep.trees, "forecast_trees", fit)
    made = sweep.run_forecaster(split, "rf")
    errors = {(r["variation"], r["error"]) for r in made.select("variation", "error").distinct().collect()}
    assert errors == {(0, "none"), (1, "no such loss"), (2, "none")}
