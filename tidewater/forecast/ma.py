"""Moving average: a flat forecast at the mean of the last w training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.common import forecast_rows, test_rows
from tidewater.operators.positions import SERIES, Y
from tidewater.operators.ranking import best_candidate, mark_chosen
from tidewater.operators.splits import holdout_split

LONGEST = 30


def trailing_mean(split: DataFrame, windows: list[int], upto: str = "n_train") -> DataFrame:
    """(series_id, window, mean) of the last rows before position ``upto``; NULL if there are too few.

    Only the last max(windows) rows of a series take part, each counted once per window it is in.
    """
    back = F.col(upto) - F.col("rn")
    reach = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= back)
    tail = split.where((back >= 1) & (back <= max(windows))).withColumn("window", F.explode(reach))
    mean = F.when(F.count(Y) == F.col("window"), F.avg(Y))
    return tail.groupBy(SERIES, "window").agg(mean.alias("mean"))


def forecast_ma(split: DataFrame, windows: list[int] | None = None) -> DataFrame:
    """One variation per window."""
    windows = windows or [3, 5, 7]
    number = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("window")) - 1
    means = trailing_mean(split, windows).withColumn("variation", number)
    return forecast_rows(test_rows(split).join(means, SERIES), "ma", F.col("mean"))


def ma_candidates(split: DataFrame, val_frac: float = 0.2) -> DataFrame:
    """Holdout RMSE of every window from 2 up to, not including, min(30, fit rows div 2).

    A flat forecast c has squared error var(y) + (mean(y) - c)^2, so the holdout is read once,
    whatever the number of windows.
    """
    rows = holdout_split(split, val_frac)
    fit = rows.where("role = 'fit'")
    limit = fit.groupBy(SERIES).agg(F.least(F.lit(LONGEST), F.expr("any_value(n_fit) div 2")).alias("_limit"))
    means = trailing_mean(fit, list(range(2, LONGEST)), "n_fit")
    val = rows.where("role = 'val'").groupBy(SERIES).agg(F.avg(Y).alias("_mean"), F.var_pop(Y).alias("_var"))
    scored = means.join(limit, SERIES).where(F.col("window") < F.col("_limit")).join(val, SERIES)
    gap = F.col("_mean") - F.col("mean")
    candidates = scored.select(
        SERIES,
        F.lit("ma").alias("model_key"),
        (F.col("window") - 2).alias("candidate_no"),
        F.to_json(F.struct("window")).alias("params"),
        F.sqrt(F.col("_var") + gap * gap).alias("rmse"),
    )
    return mark_chosen(candidates, [SERIES])


def tune_ma(split: DataFrame, val_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(candidates, forecasts of the best window fitted on all training rows)."""
    candidates = ma_candidates(split, val_frac)
    best = best_candidate(candidates, [SERIES]).select(
        SERIES, "params", F.get_json_object("params", "$.window").cast("int").alias("window")
    )
    means = trailing_mean(split, list(range(2, LONGEST))).join(best, [SERIES, "window"])
    rows = test_rows(split).join(means.withColumn("variation", F.lit(0)), SERIES)
    forecasts = forecast_rows(rows, "ma", F.col("mean")).join(best.select(SERIES, "params"), SERIES)
    return candidates, forecasts
