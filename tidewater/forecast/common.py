"""Shapes shared by all forecasters.

Every forecaster takes a split (features + rn, n, n_train, is_train) and returns long rows:
series_id, model_key, variation, ts, rn, n_train, y, yhat, forecast_mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.metrics import finite
from tidewater.operators.positions import SERIES, TS, Y

HORIZON, ONE_STEP = "whole_horizon", "one_step"
FORECAST_COLUMNS = [SERIES, "model_key", "variation", TS, "rn", "n_train", Y, "yhat", "forecast_mode"]


def test_rows(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_train")).select(SERIES, TS, "rn", "n_train", Y)


def forecast_rows(rows: DataFrame, model_key: str, yhat: Column, mode: str = HORIZON) -> DataFrame:
    """Rows that already hold the fitted parameters next to the test rows, in the common shape."""
    return rows.select(
        SERIES,
        F.lit(model_key).alias("model_key"),
        F.col("variation").cast("int").alias("variation"),
        TS,
        "rn",
        "n_train",
        Y,
        finite(yhat).alias("yhat"),
        F.lit(mode).alias("forecast_mode"),
    )


def train_scale(split: DataFrame) -> DataFrame:
    """Mean and population deviation (1 if zero) of the training values, to condition the solves."""
    spread = F.stddev_pop(Y)
    return split.where("is_train").groupBy(SERIES).agg(
        F.avg(Y).alias("y_mean"), F.when(spread > 0, spread).otherwise(1.0).alias("y_std")
    )
