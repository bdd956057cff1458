import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions import catalog
from tidewater.functions.calendar import calendar_factor, date_parts, holiday_factor
from tidewater.functions.configs import run_config
from tidewater.sinks import results as sinks
from tidewater.sources.series import load_series, require_columns, rollup_daily, series_panel, spark_time_format


def test_csv_json_parquet_and_unknown(spark, tmp_path):
    csv = tmp_path / "x.csv"
    csv.write_text("day,sales,other\n2018-01-02,5,a\n2018-01-01,3,b\n")
    got = load_series(spark, str(csv), "day", "sales").orderBy("ts").collect()
    assert [(r.series_id, r.ts, r.y) for r in got] == [
        ("all", dt.datetime(2018, 1, 1), 3.0), ("all", dt.datetime(2018, 1, 2), 5.0)]
    doc = tmp_path / "x.json"
    doc.write_text(json.dumps([{"day": "03/02/2018", "sales": 1.5}, {"day": "01/02/2018", "sales": 2.5}], indent=1))
    got = load_series(spark, str(doc), "day", "sales", "%d/%m/%Y").orderBy("ts").collect()
    assert [(r.ts, r.y) for r in got] == [(dt.datetime(2018, 2, 1), 2.5), (dt.datetime(2018, 2, 3), 1.5)]
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([("s", dt.datetime(2020, 1, 1), float("nan"))], "k string, t timestamp_ntz, v double").write.parquet(path)
    assert load_series(spark, path, "t", "v", series_cols=["k"]).first().y is None
    with pytest.raises(ValueError, match="Unsupported file format"):
        load_series(spark, "x.doc", "a", "b")


def test_missing_columns_and_bad_dates(spark, tmp_path):
    df = spark.createDataFrame([("2020-13-01", 1.0)], "t string, v double")
    with pytest.raises(ValueError, match="Time column"):
        require_columns(df, "x", "v")
    with pytest.raises(ValueError, match="Data column"):
        require_columns(df, "t", "x")
    path = tmp_path / "bad.csv"
    path.write_text("t,v\n2020-13-01,1\n")
    with pytest.raises(Exception):
        load_series(spark, str(path), "t", "v", schema="t string, v double").collect()
    assert spark_time_format("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


@pytest.mark.parametrize("form", [
    "%d %b %Y %I:%M %p", "%B %d, %Y at %H.%M", "%Y/%j %H:%M:%S", "%y%m%dT%H%M%S.%f", "%Y-%m-%d o'clock %H:%M", "[%Y] 100%% %m #%d %H:%M",
])
def test_time_directives_read_what_strftime_writes(spark, form):
    moments = [dt.datetime(2021, 3, 9, 0, 5), dt.datetime(1999 + 4, 12, 31, 12, 59), dt.datetime(2024, 2, 29, 23, 0)]
    df = spark.createDataFrame([(m.strftime(form), float(i)) for i, m in enumerate(moments)], "t string, v double")
    got = {r.y: r.ts for r in series_panel(df, "t", "v", date_format=form).collect()}
    assert [got[i] for i in range(3)] == moments


def test_unknown_directives_are_named():
    for form in ("%Y-%m-%d %z", "%A %Y", "%Y%"):
        with pytest.raises(ValueError, match="not supported"):
            spark_time_format(form)


def test_csv_without_a_schema_keeps_keys_as_written(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("code,year,v\n007,2020,1e3\n007,2021,\n7,2020,-2\n")
    panel = load_series(spark, str(path), "year", "v", "%Y", series_cols=["code"])
    got = [(r.series_id, r.ts.year, r.y) for r in panel.orderBy("series_id", "ts").collect()]
    assert got == [("007", 2020, 1000.0), ("007", 2021, None), ("7", 2020, -2.0)]


def test_rollup_daily(spark):
    rows = [("a", dt.datetime(2018, 1, 1, h), 1.0 + h, float(h)) for h in range(24)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, e double, temp double")
    row = rollup_daily(df, ["k"], "t", F.col("e"), F.col("temp")).first()
    assert (row.ts, row.y, row.covariate) == (dt.date(2018, 1, 1), 300.0, 11.5)


def test_calendar_factors_are_estimated_per_series(spark):
    hours = [dt.datetime(2018, 1, 1) + dt.timedelta(hours=6 * i) for i in range(4 * 35)]
    rows = [("a", h, 3.0 if h.hour == 12 else 1.0) for h in hours] + [("b", hours[0], None), ("b", hours[1], float("nan"))]
    rows += [("c", hours[0], 1.0), ("c", hours[1], -1.0)]
    panel = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    got = calendar_factor(panel).collect()
    assert len(got) == len(rows) and "_means" not in got[0]
    for r in got:
        if r.series_id == "a":
            assert abs(r.hour_factor - (2.0 if r.ts.hour == 12 else 2 / 3)) < 1e-9
            assert abs(r.weekday_factor - 1) < 1e-9 and abs(r.weekend_factor - 1) < 1e-9
        else:  # no value is known, or the mean is zero
            assert r.hour_factor is None and r.month_factor is None


def test_date_parts_have_both_cycles(spark):
    rows = [("a", dt.datetime(2018, 12, 31, 12), 1.0), ("a", dt.datetime(2019, 1, 1, 0), 1.0)]
    b, a = date_parts(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")).orderBy(F.desc("ts")).collect()
    assert (a.hour, a.day, a.dayofyear) == (12, 31, 365) and (b.hour, b.day, b.dayofyear) == (0, 1, 1)
    assert abs(a.yearly_cycle) < 1e-9 and abs(a.daily_cycle - 5) < 1e-9 and abs(b.daily_cycle + 5) < 1e-9


def test_holiday_factors_are_estimated_per_series(spark):
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(730)]
    special = {dt.date(2018, 11, 23): 50.0, dt.date(2019, 11, 29): 30.0, dt.date(2018, 5, 28): 5.0, dt.date(2019, 5, 27): 5.0}
    rows = [("a", d, special.get(d, 10.0)) for d in days] + [("b", days[0], 4.0)]
    got = {(r.series_id, r.ts): r.holiday_factor for r in holiday_factor(
        spark.createDataFrame(rows, "series_id string, ts date, y double")).collect()}
    assert got["a", dt.date(2018, 11, 23)] == got["a", dt.date(2019, 11, 29)] == 4.0
    assert got["a", dt.date(2019, 5, 27)] == 0.5 and got["a", dt.date(2018, 12, 25)] == 1.0
    assert got["a", dt.date(2018, 11, 30)] == 1.0 and got["a", dt.date(2018, 5, 21)] == 1.0
    assert got["b", days[0]] is None  # no ordinary day to compare with


def test_comparison_and_summary_files(spark, tmp_path):
    ranked = spark.createDataFrame(
        [("a", 1, "ma", "M1", 0, 0.9, 1.0, 0.5, 0.1, None, float("inf"))],
        "series_id string, rank int, model_key string, model string, variation int, composite_score double, rmse double, mae double, r2 double, mase double, mape double",
    )
    path = str(tmp_path / "cmp")
    sinks.write_comparison(ranked, path, "sales", "2024-05-06")
    files = list((tmp_path / "cmp" / "dataset=sales" / "run_date=2024-05-06").glob("*.csv"))
    assert files[0].read_text().splitlines()[0] == "series_id,rank,model,composite_score,rmse,mae,r2,mase,mape"
    profile = spark.createDataFrame([("a", 10, 8, 2)], "series_id string, total_samples long, training_samples long, testing_samples long")
    judged = ranked.select("series_id", F.lit("good").alias("judgment"))
    row = sinks.summary(profile, judged, ranked).first()
    assert row.best_judgment == "good" and row.results[0].mape is None and row.dataset.training_samples == 8


def test_configurations_tell_tuned_from_default(spark):
    rows = spark.createDataFrame(
        [("a", "lr", 1, "LR", '{"loss": "l1", "alpha": 0.1, "lags": 5}', None), ("a", "xgb", 2, "XGB", '{"loss": "huber", "lags": 7}', False),
         ("a", "arima", 0, "ARIMA", '{"order": [2, 1, 1]}', True), ("a", "mine", 0, "Mine", '{"n_steps": 4, "scaler": " MinMax ", "feature_range": [0, 1]}', False)],
        "series_id string, model_key string, variation int, model string, params string, tuned boolean",
    )
    profile = spark.createDataFrame([("a", 10, 8, 2)], "series_id string, total_samples long, training_samples long, testing_samples long")
    source = {"file": "f.csv", "time_col": "t", "data_col": "v"}
    variations = {**catalog.VARIATIONS, "mine": [{"n_steps": 4, "scaler": " MinMax ", "feature_range": [0, 1]}]}
    got = {r.model_key: r.config for r in run_config(rows, profile, source, variations).collect()}
    assert got["lr"].normalization[:2] == ("StandardScaler", "X_and_y") and not got["lr"].tuned and got["lr"].setup.lags == 5
    assert json.loads(got["xgb"].hyperparameters) == {"loss": "huber", "lags": 7} and got["xgb"].selection_metric is None
    tuned = got["arima"]
    assert tuned.tuned and tuned.selection_metric == "rmse" and json.loads(tuned.hyperparameters) == {"order": [2, 1, 1]}
    assert tuned.hyperparameters_source == "validation" and tuned.normalization.type == "none" and tuned.time_steps is None
    assert got["mine"].time_steps.n_steps == 4 and got["mine"].shape_and_reshaping.input_shape == ["4", "n_features"]
    assert tuple(got["mine"].normalization) == ("MinMaxScaler", "target", "Scaler from variation: minmax", [0.0, 1.0])


def test_summary_carries_parameters_and_source(spark):
    ranked = spark.createDataFrame(
        [("a", 1, "M1", 0.9, 1.0, 0.5, 0.1, None, float("inf"), '{"w": 1}', "default_variation", 0.25)],
        "series_id string, rank int, model string, composite_score double, rmse double, mae double, r2 double, mase double, mape double, params string, hyperparameters_source string, rmse_std double",
    )
    profile = spark.createDataFrame([("a", 10, 8, 2), ("b", 5, 4, 1)], "series_id string, total_samples long, training_samples long, testing_samples long")
    tuned = spark.createDataFrame([("a", "M1 (Tuned)", '{"w": 2}')], "series_id string, model string, params string")
    judged = ranked.select("series_id", F.lit("good").alias("judgment"))
    a, b = sinks.summary(profile, judged, ranked, tuned=tuned, source={"file": "f.csv", "time_col": "t", "data_col": "v"}).orderBy("series_id").collect()
    assert a.dataset.file == "f.csv" and a.results[0].variation_spec == '{"w": 1}' and a.results[0].rmse_std == 0.25
    assert a.parameter_selection.metric == "rmse" and a.tuned_best_params == {"M1 (Tuned)": '{"w": 2}'}
    assert b.results is None and b.parameter_selection is None and b.dataset.time_column == "t"
