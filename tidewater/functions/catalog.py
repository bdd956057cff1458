"""Default setup, model variations, metadata, losses and families."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default setup and tuning policy.
DEFAULT_SETUP = {
    "test_size": 0.2,
    "lags": 7,
    "rolling_window": 3,
    "ma_window": 5,
    "n_runs": 3,
}

# Three variations per model.
VARIATIONS = {
    "arima": [{"order": [1, 0, 0]}, {"order": [1, 1, 0]}, {"order": [2, 1, 0]}],
    "sarima": [
        {"order": [1, 1, 0], "seasonal_order": [0, 1, 1, 12]},
        {"order": [1, 1, 1], "seasonal_order": [1, 1, 1, 12]},
        {"order": [2, 1, 0], "seasonal_order": [0, 1, 1, 12]},
    ],
    "ma": [{"window": 3}, {"window": 5}, {"window": 7}],
    "es": [
        {"trend": "add", "seasonal": "add"},
        {"trend": "add", "seasonal": None},
        {"trend": "mul", "seasonal": "mul"},
    ],
    "prophet": [
        {"changepoint_prior_scale": 0.01, "seasonality_prior_scale": 0.1, "seasonality_mode": "additive"},
        {"changepoint_prior_scale": 0.1, "seasonality_prior_scale": 1.0, "seasonality_mode": "multiplicative"},
        {"changepoint_prior_scale": 0.5, "seasonality_prior_scale": 10.0, "seasonality_mode": "additive"},
    ],
    "rf": [
        {"loss": "l2", "lags": 3},
        {"loss": "l1", "lags": 5},
        {"loss": "l2", "n_estimators": 200, "lags": 7},
    ],
    "xgb": [{"loss": "l2", "lags": 3}, {"loss": "l1", "lags": 5}, {"loss": "huber", "lags": 7}],
    "lr": [
        {"loss": "l2", "lags": 3},
        {"loss": "l1", "alpha": 0.1, "lags": 5},
        {"loss": "huber", "lags": 7},
    ],
}

# Parameters of the models that are built, before any variation.
DEFAULT_HYPERPARAMETERS = {
    "arima": {"order": [5, 1, 0]},
    "sarima": {"order": [1, 1, 1], "seasonal_order": [1, 1, 1, 12]},
    "ma": {"window": 3},
    "es": {"trend": "add", "seasonal": "add", "seasonal_periods": 12},
    "prophet": {},
    "rf": {"loss": "l2"},
    "xgb": {"loss": "l2"},
    "lr": {"loss": "l2"},
}

# Display names, families, losses.
DISPLAY_NAMES = {
    "arima": "ARIMA",
    "sarima": "SARIMA",
    "ma": "Moving Average",
    "es": "Exponential Smoothing",
    "prophet": "Prophet",
    "rf": "Random Forest",
    "svr": "SVR",
    "xgb": "XGBoost",
    "lr": "Linear Regression",
    "rnn": "RNN",
    "lstm": "LSTM",
    "mlp": "MLP",
    "lstm_feat": "LSTM-feat",
    "rnn_feat": "RNN-feat",
    "cnn1d": "CNN-1D",
}
FAMILIES = {
    "arima": "Statistical", "sarima": "Statistical", "ma": "Statistical", "es": "Statistical",
    "prophet": "Statistical",
    "rf": "ML", "svr": "ML", "xgb": "ML", "lr": "ML",
    "rnn": "DL", "lstm": "DL", "mlp": "DL", "lstm_feat": "DL", "rnn_feat": "DL", "cnn1d": "DL",
}
LOSSES = ["l1", "l2", "huber", "quantile"]
LOSS_DISPLAY = {"l1": "L1", "l2": "L2", "huber": "Huber", "quantile": "Quantile"}
LOSSES_BY_MODEL = {
    "lr": ["l1", "l2", "huber", "quantile"],
    "mlp": ["l1", "l2", "huber", "quantile"],
    "lstm_feat": ["l1", "l2", "huber", "quantile"],
    "rnn_feat": ["l1", "l2", "huber", "quantile"],
    "cnn1d": ["l1", "l2", "huber", "quantile"],
    "rnn": ["l1", "l2", "huber", "quantile"],
    "lstm": ["l1", "l2", "huber", "quantile"],
    "xgb": ["l1", "l2", "huber", "quantile"],
    "rf": ["l1", "l2"],
}
# Columns of a report.
REPORT_COLUMNS = ["model", "composite_score", "rmse", "mae", "r2", "mase", "mape"]


def params_of(variations: Mapping[str, list[dict]] = VARIATIONS, model_key: str = "model_key", variation: str = "variation") -> Column:
    """Parameters (JSON) of a model's variation; an empty object where there are none."""
    known = {f"{k}/{i}": json.dumps(spec) for k, specs in variations.items() for i, spec in enumerate(specs)}
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", model_key, variation)), F.lit("{}"))


def loss_table(spark: SparkSession) -> DataFrame:
    """One row per model and supported loss."""
    rows = ", ".join(f"('{k}', '{loss}')" for k, losses in LOSSES_BY_MODEL.items() for loss in losses)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model_key, loss)")
