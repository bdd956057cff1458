import datetime as dt
import math

import numpy as np
import pytest
from conftest import by_series, panel_frame, series, stamped_frame
from pyspark.sql import functions as F

from tidewater.functions import names
from tidewater.operators import metrics as m
from tidewater.operators import ranking as r
from tidewater.operators.report import chart_performance, chart_radar
from tidewater.operators.splits import chrono_split

METRIC_ROW = (
    "series_id string, model string, model_key string, variation int, run int, mse double, rmse double, mae double, "
    "r2 double, mase double, mape double"
)


def metric_rows(spark, rows):
    """rows: (model, rmse, mae, r2, mase, mape[, run])"""
    full = [("s", x[0], x[0], 0, x[6] if len(x) > 6 else 1, None if x[1] is None else x[1] ** 2, *x[1:6]) for x in rows]
    return spark.createDataFrame(full, METRIC_ROW)


def composite_reference(rows):
    """The scoring rules on plain numbers, None for missing."""
    cols = list(zip(*[x[1:6] for x in rows]))

    def low(values, neutral):
        have = [v for v in values if v is not None]
        out = []
        for v in values:
            if v is None and neutral:
                out.append(0.5)
            elif not have or max(have) == min(have):
                out.append(1.0)
            else:
                out.append(None if v is None else 1 - (v - min(have)) / (max(have) - min(have)))
        return out

    def capped(values, cap):
        return [None if v is None or math.isinf(v) or math.isnan(v) else min(v, cap) for v in values]

    have = [v for v in cols[2] if v is not None]
    if have and max(have) > min(have):
        r2 = [None if v is None else (v - min(have)) / (max(have) - min(have)) for v in cols[2]]
    else:
        r2 = [1.0 if have and max(have) >= 0 else 0.0] * len(rows)
    scores = [low(cols[0], False), low(cols[1], False), r2, low(capped(cols[3], 10), True), low(capped(cols[4], 200), True)]
    return {x[0]: np.mean([s[i] for s in scores if s[i] is not None]) for i, x in enumerate(rows)}


CASES = {
    "plain": [("a", 1.0, 1.0, 0.9, 0.5, 10.0), ("b", 2.0, 3.0, 0.1, 1.5, 50.0), ("c", 1.5, 1.2, 0.4, 0.7, 20.0)],
    "one model": [("a", 1.0, 1.0, -0.2, 0.5, 10.0)],
    "one good model": [("a", 1.0, 1.0, 0.2, None, None)],
    "equal negative r2": [("a", 1.0, 1.0, -0.5, 1.0, 5.0), ("b", 2.0, 2.0, -0.5, 2.0, 6.0)],
    "missing mase": [("a", 1.0, 1.0, 0.5, None, 5.0), ("b", 2.0, 2.0, 0.4, 1.0, 7.0), ("c", 3.0, 2.5, 0.1, 2.0, 9.0)],
    "capped": [("a", 1.0, 1.0, 0.5, 50.0, math.inf), ("b", 2.0, 2.0, 0.4, 1.0, 500.0), ("c", 3.0, 2.5, 0.1, 2.0, 9.0)],
    "all missing": [("a", 1.0, 1.0, None, None, None), ("b", 2.0, 2.0, None, None, None)],
    "missing rmse": [("a", None, 1.0, 0.5, 1.0, 5.0), ("b", 2.0, 2.0, 0.4, 2.0, 6.0), ("c", 3.0, 2.0, 0.3, 2.0, 6.0)],
}


@pytest.mark.parametrize("case", CASES)
def test_composite_rules(spark, case):
    rows = CASES[case]
    scored = r.composite_score(metric_rows(spark, rows)).collect()
    want = composite_reference(rows)
    for row in scored:
        assert row.composite_score == pytest.approx(want[row.model], abs=1e-12)
        assert 0 <= row.composite_score <= 1


def test_nan_is_missing(spark):
    nan = float("nan")
    a = r.composite_score(metric_rows(spark, [("a", 1.0, 1.0, nan, nan, nan), ("b", 2.0, 2.0, 0.5, 1.0, 5.0)])).collect()
    b = r.composite_score(metric_rows(spark, [("a", 1.0, 1.0, None, None, None), ("b", 2.0, 2.0, 0.5, 1.0, 5.0)])).collect()
    assert [x.composite_score for x in a] == [x.composite_score for x in b]


@pytest.mark.parametrize("frame", [panel_frame, stamped_frame])
def test_metrics_match_numpy(spark, frame):
    y = series(100, 8)
    split = chrono_split(frame(spark, {"a": y, "flat": [5.0] * 50, "zero": [0.0] * 50}))
    forecasts = split.where("not is_train").withColumns(
        {"yhat": F.col("y") * 1.1 + 1, "model": F.lit("m"), "model_key": F.lit("m"), "variation": F.lit(0), "run": F.lit(1)}
    )
    got = {x.series_id: x for x in m.evaluate(forecasts, split).collect()}
    test, train = y[80:], y[:80]
    e = test - (test * 1.1 + 1)
    a = got["a"]
    assert a.mse == pytest.approx(np.mean(e**2)) and a.rmse == pytest.approx(np.sqrt(np.mean(e**2)))
    assert a.r2 == pytest.approx(1 - np.sum(e**2) / np.sum((test - test.mean()) ** 2))
    assert a.mase == pytest.approx(np.mean(abs(e)) / np.mean(abs(np.diff(train))))
    assert a.mape == pytest.approx(np.mean(abs(e / test)) * 100)
    assert got["flat"].mase is None and got["flat"].r2 == 0.0
    assert got["zero"].mape is None


def test_fold_scores(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.0), (3.0, 2.9)], "y double, yhat double").withColumn("k", F.lit(1))
    assert m.fold_score(df, ["k"]).first().rmse == pytest.approx(math.sqrt(0.02 / 3))
    empty = df.withColumn("yhat", F.lit(None).cast("double"))
    assert m.fold_score(empty, ["k"]).first().rmse == math.inf
    scores = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0)], "k int, rmse double")
    assert m.aggregate_folds(scores, ["k"]).first().rmse == 3.0
    assert m.aggregate_folds(scores, ["k"], "median").first().rmse == 2.0


def test_runs_are_averaged(spark):
    rows = [("a", 1.0, 1.0, 0.5, 1.0, 5.0, 1), ("a", 3.0, 2.0, 0.3, None, 6.0, 2), ("b", 2.0, 2.0, 0.4, 2.0, 7.0, 1)]
    got = {x.model: x for x in r.aggregate_runs(metric_rows(spark, rows), with_composite_std=True).collect()}
    assert got["a"].rmse == 2.0 and got["a"].rmse_std == 1.0 and got["a"].mase == 1.0
    assert got["b"].rmse_std == 0.0 and got["b"].composite_std == 0.0
    lookup = {x.model: x.composite_std for x in r.composite_std(metric_rows(spark, rows)).collect()}
    assert lookup["a"] == pytest.approx(got["a"].composite_std)


def test_best_candidate_takes_the_first_of_equals_and_skips_missing(spark):
    rows = [("s", 0, "p0", None), ("s", 1, "p1", 2.0), ("s", 2, "p2", 2.0), ("s", 3, "p3", float("nan"))]
    c = spark.createDataFrame(rows, "series_id string, candidate_no int, params string, rmse double")
    best = r.best_candidate(c, ["series_id"]).first()
    assert (best.candidate_no, best.params, best.rmse) == (1, "p1", 2.0)
    chosen = {x.candidate_no: x.chosen for x in r.mark_chosen(c, ["series_id"]).collect()}
    assert chosen == {0: False, 1: True, 2: True, 3: False}


def test_residuals_need_a_full_centred_frame(spark):
    split = chrono_split(stamped_frame(spark, {"a": range(60)}))
    forecasts = split.where("not is_train").withColumns({"yhat": F.col("y") + F.col("rn"), "variation": F.lit(0)})
    got = by_series(m.residuals(forecasts, ["series_id", "variation"]))["a"]
    assert got.rolling_mean.isna().sum() == 4 and got.residual.iloc[0] == 48.0
    assert got.rolling_mean.iloc[2] == pytest.approx(50.0)


NAMES = {
    "XGBoost (L2)": ("xgb", "l2"),
    "ARIMA(1, 0, 0)": ("arima", None),
    "SARIMA[1,1,0]x[0,1,1,12] (Tuned)": ("sarima", None),
    "SARIMA(1, 1, 0)x(0, 1, 1, 12)": ("sarima", None),
    "SVR (C=1.0, rbf)": ("svr", None),
    "Random Forest (L2) (n=200)": ("rf", "l2"),
    "Linear Regression (L1) (α=0.1)": ("lr", "l1"),
    "CNN-1D (Huber)": ("cnn1d", "huber"),
    "Moving Average (w=3, Tuned)": ("ma", None),
    "LSTM-feat (Quantile) (Tuned)": ("lstm_feat", "quantile"),
    "Prophet": ("prophet", None),
}


def test_parse_model_name(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "model string")
    got = {x.model: tuple(x.p) for x in df.withColumn("p", names.parse_model_name(F.col("model"))).collect()}
    assert got == NAMES


def test_report_text_and_judgment(spark):
    rows = [("a", 1.0, 1.0, 0.75, 0.8, 5.0), ("b", 2.0, 2.0, 0.4, None, math.inf)]
    ranked = r.rank_models(r.composite_score(metric_rows(spark, rows)))
    text = {x["rank"]: x for x in names.format_report(ranked).collect()}
    assert text[1].rmse == "1.0000" and text[2].mape == "" and text[2].mase == ""
    judged = names.judgment_text(names.attach_family(r.lead_margin(ranked))).first().judgment
    assert judged.startswith("Recommended model: a (composite score: 1.0000). It achieves")
    assert "Strong explanatory power" in judged and "MASE < 1" in judged and judged.endswith("Model family: Other.")
    bars = {(x.model, x.metric): x for x in chart_performance(ranked).collect()}
    assert bars[("b", "mase")].value == 10.0 and bars[("b", "mape")].value is None
    assert {x.model: x.s_mase for x in chart_radar(ranked).collect()} == {"a": 1.0, "b": 0.5}


def test_alone_there_is_no_margin(spark):
    ranked = r.rank_models(r.composite_score(metric_rows(spark, [("a", 1.0, 1.0, -1.0, 2.0, 5.0)])))
    row = names.judgment_text(r.lead_margin(ranked).withColumn("family", F.lit(None).cast("string"))).first()
    assert row.margin is None and "Leads" not in row.judgment and "MASE = 2.00" in row.judgment


def test_dates_and_times_share_results(spark, dated_split, stamped_split):
    assert dated_split.count() == stamped_split.count()
    assert isinstance(dated_split.first().ts, dt.date)
