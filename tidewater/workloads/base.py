"""Frames that several queries start from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.ma import forecast_ma
from tidewater.operators.features import feature_table
from tidewater.operators.metrics import evaluate
from tidewater.operators.ranking import composite_score, rank_models
from tidewater.operators.splits import chrono_split
from tidewater.plans.sweep import name_forecasts


def split_of(panel: DataFrame, lags: int = 7) -> DataFrame:
    return chrono_split(feature_table(panel, lags))


def held_split_of(panel: DataFrame, lags: int = 7) -> DataFrame:
    """A split that several branches of one query read: kept in memory, or on disk where it does not fit."""
    return split_of(panel, lags).persist()


def rounded(df: DataFrame, places: int = 4, only: list[str] | None = None) -> DataFrame:
    """Round every double, so that sums taken in another order compare equal."""
    doubles = only or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in doubles})


def flat_forecasts(split: DataFrame, runs: int = 1) -> DataFrame:
    """Moving averages of 3, 5 and 7 rows; every further run takes windows one row longer."""
    parts = [
        forecast_ma(split, [w + r for w in (3, 5, 7)]).withColumn("run", F.lit(r + 1)) for r in range(runs)
    ]
    named = name_forecasts(reduce(DataFrame.unionByName, parts), split)
    return named.drop("params", "forecast_mode")


def flat_metrics(split: DataFrame, runs: int = 1) -> DataFrame:
    return evaluate(flat_forecasts(split, runs), split)


def flat_ranked(split: DataFrame, runs: int = 1) -> DataFrame:
    return rank_models(composite_score(flat_metrics(split, runs)))
