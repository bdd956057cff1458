"""Forecast error metrics. NaN and infinity never survive a boundary: missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.features import naive_diff
from tidewater.operators.positions import SERIES, TS, Y

METRICS = ["mse", "rmse", "mae", "r2", "mase", "mape"]
FORECAST_KEYS = [SERIES, "model", "model_key", "variation", "run"]
ZERO = 1e-10


def no_nan(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def finite(value: Column) -> Column:
    """NULL for NaN and for plus or minus infinity."""
    value = no_nan(value)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def align_forecast(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Match forecasts (without y) to actuals on series and time."""
    return actuals.select(SERIES, TS, Y).join(forecasts.drop(Y), [SERIES, TS])


def percentage_error(y: Column, yhat: Column) -> Column:
    """|error / actual| in percent, missing where the actual is (almost) zero."""
    return F.when(F.abs(y) >= ZERO, F.abs((y - yhat) / y) * 100)


def r2_from_sums(n: Column, sse: Column, sst: Column) -> Column:
    constant = F.when(sse == 0, 1.0).otherwise(0.0)
    return F.when(n >= 2, F.when(sst == 0, constant).otherwise(1 - sse / sst))


def forecast_metrics(forecasts: DataFrame, keys: list[str] | None = None, failed: bool = False) -> DataFrame:
    """mse, rmse, mae, r2 and mape per key in one pass.

    Rows without an actual value are not scored. A forecast that misses any of the others is a failed
    fit: its key gets no metrics, so it cannot win a ranking on the rows it has. With ``failed`` its key
    stays, without metrics, and column ``error`` says why (NULL for a complete forecast).
    """
    keys = keys or [c for c in FORECAST_KEYS if c in forecasts.columns]
    y, yhat = no_nan(F.col(Y)), no_nan(F.col("yhat"))
    err = y - yhat
    reason = F.max("error") if "error" in forecasts.columns else F.lit(None).cast("string")
    sums = (
        forecasts.where(y.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(yhat).alias("_n"),
            F.avg(err * err).alias("mse"),
            F.avg(F.abs(err)).alias("mae"),
            F.var_pop(y).alias("_var"),
            F.avg(percentage_error(y, yhat)).alias("mape"),
            reason.alias("_reason"),
        )
    )
    n, whole = F.col("_n"), F.col("_n") == F.col("_rows")
    values = {
        "mse": F.col("mse"),
        "rmse": F.sqrt("mse"),
        "mae": F.col("mae"),
        "r2": r2_from_sums(n, F.col("mse") * n, F.col("_var") * n),
        "mape": F.col("mape"),
    }
    if not failed:
        return sums.where(whole).select(*keys, *[v.alias(c) for c, v in values.items()])
    error = F.when(~whole, F.coalesce("_reason", F.lit("the forecast misses rows")))
    return sums.select(*keys, error.alias("error"), *[F.when(whole, v).alias(c) for c, v in values.items()])


def naive_scale(split: DataFrame) -> DataFrame:
    """Mean absolute first difference of the training values of every series."""
    diffs = naive_diff(split.where("is_train").select(SERIES, TS, Y, "rn"))
    return diffs.groupBy(SERIES).agg(F.avg(F.abs("diff")).alias("naive_scale"))


def add_mase(metrics: DataFrame, scale: DataFrame) -> DataFrame:
    """mae over the naive scale; missing when the scale is zero or there is at most one train row."""
    joined = metrics.join(scale, SERIES, "left")
    return joined.withColumn(
        "mase", F.when(F.col("naive_scale") > 0, F.col("mae") / F.col("naive_scale"))
    ).drop("naive_scale")


def evaluate(forecasts: DataFrame, split: DataFrame, keys: list[str] | None = None, failed: bool = False) -> DataFrame:
    """All six metrics per series, model, variation and run; ``failed`` keeps failed fits, with their error."""
    scored = add_mase(forecast_metrics(forecasts, keys, failed), naive_scale(split))
    return scored.select(*[c for c in scored.columns if c not in METRICS], *METRICS)


def _complete() -> Column:
    """Every row of the group that has an actual value has a forecast."""
    y, yhat = no_nan(F.col(Y)), no_nan(F.col("yhat"))
    return F.count(F.when(y.isNotNull(), yhat)) == F.count(y)


def pinball_loss(forecasts: DataFrame, keys: list[str], quantile: float = 0.5) -> DataFrame:
    """Mean of max(q * error, (q - 1) * error); NULL for a forecast that misses rows."""
    err = F.col(Y) - F.col("yhat")
    return forecasts.groupBy(*keys).agg(
        F.when(_complete(), F.avg(F.greatest(quantile * err, (quantile - 1) * err))).alias("pinball")
    )


def fold_score(validation: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE per key; plus infinity when nothing could be scored or a forecast is missing."""
    err = F.col(Y) - F.col("yhat")
    return validation.groupBy(*keys).agg(
        F.coalesce(F.when(_complete(), F.sqrt(F.avg(err * err))), F.lit(float("inf"))).alias("rmse")
    )


def aggregate_folds(scores: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
    """Mean or median RMSE over folds; plus infinity when there are none."""
    folded = F.median("rmse") if method == "median" else F.avg("rmse")
    return scores.groupBy(*keys).agg(F.coalesce(folded, F.lit(float("inf"))).alias("rmse"))


def residuals(forecasts: DataFrame, keys: list[str], window_rows: int = 5) -> DataFrame:
    """Predicted minus actual, with a centred rolling mean over full frames only.

    ``keys`` identifies one forecast, starting with the series; ``rn`` must be present.
    """
    from tidewater.operators.positions import over_neighbours

    half = window_rows // 2
    # One forecast of one series is its own ordered run of rows.
    runs = forecasts.withColumn("residual", F.col("yhat") - F.col(Y)).withColumns(
        {"_sid": F.col(SERIES), SERIES: F.to_json(F.struct(*keys))}
    )

    def build(rows, w):
        frame = w.rowsBetween(-half, half)
        mean = F.avg("residual").over(frame)
        return rows.withColumn("rolling_mean", F.when(F.count("residual").over(frame) == window_rows, mean))

    return over_neighbours(runs, build, behind=half, ahead=half).withColumn(SERIES, F.col("_sid")).drop("_sid")
