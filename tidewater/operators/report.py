"""Tables behind the report and its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.catalog import REPORT_COLUMNS
from tidewater.operators.metrics import finite, residuals
from tidewater.operators.positions import SERIES, TS, Y
from tidewater.operators.ranking import MAPE_CAP, MASE_CAP, clip_metric, score_columns, top_k
from tidewater.operators.splits import mid_slice, train_tail

FORECAST_ID = ["model_key", "variation"]


def report_table(ranked: DataFrame, k: int = 20) -> DataFrame:
    """The first k rows of every series, metrics rounded to four decimals."""
    columns = [c for c in REPORT_COLUMNS if c in ranked.columns]
    return top_k(ranked, k).select(
        SERIES, "rank", *[F.round(c, 4).alias(c) if c != "model" else F.col(c) for c in columns]
    )


def _ranked_forecasts(ranked: DataFrame, forecasts: DataFrame, k: int) -> DataFrame:
    best = top_k(ranked, k).select(SERIES, *FORECAST_ID, "rank")
    return forecasts.join(best, [SERIES, *FORECAST_ID])


def chart_trellis(ranked: DataFrame, forecasts: DataFrame, split: DataFrame, k: int = 9) -> DataFrame:
    """Train and test actuals with the forecast of every top model, and the panel titles' metrics."""
    best = top_k(ranked, k).select(SERIES, *FORECAST_ID, "rank", "composite_score", "rmse", "r2")
    panels = split.select(SERIES, TS, "is_train", Y).join(best, SERIES)
    predicted = forecasts.select(SERIES, *FORECAST_ID, TS, "yhat")
    return panels.join(predicted, [SERIES, *FORECAST_ID, TS], "left")


def chart_top3(ranked: DataFrame, forecasts: DataFrame, split: DataFrame) -> DataFrame:
    """Training tail, test actuals and the top three forecasts; zoom marks the middle of the test."""
    tail = train_tail(split).select(SERIES, TS, F.lit("train").alias("line"), F.col(Y).alias("value"))
    actual = split.where(~F.col("is_train")).select(SERIES, TS, F.lit("test").alias("line"), F.col(Y).alias("value"))
    best = _ranked_forecasts(ranked, forecasts, 3).select(
        SERIES, TS, F.concat(F.lit("rank "), "rank").alias("line"), F.col("yhat").alias("value")
    )
    zoom = mid_slice(split).select(SERIES, TS, F.lit(True).alias("zoom"))
    lines = tail.unionByName(actual).unionByName(best)
    return lines.join(zoom, [SERIES, TS], "left").withColumn("zoom", F.coalesce("zoom", F.lit(False)))


def chart_performance(ranked: DataFrame) -> DataFrame:
    """One bar per model and metric: shown value, top-three flag and warning flag (r2 < 0, mase > 1)."""
    mase = F.coalesce(finite(F.col("mase")), F.lit(MASE_CAP))
    bars = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.alias("value"), warn.alias("warn"))
            for name, value, warn in (
                ("composite_score", F.col("composite_score"), F.lit(False)),
                ("rmse", F.col("rmse"), F.lit(False)),
                ("mae", F.col("mae"), F.lit(False)),
                ("r2", F.col("r2"), F.coalesce(F.col("r2") < 0, F.lit(False))),
                ("mase", mase, mase > 1),
                ("mape", clip_metric(F.col("mape"), MAPE_CAP), F.lit(False)),
            )
        ]
    )
    return ranked.select(
        SERIES, "model", "rank", (F.col("rank") <= 3).alias("top3"), F.explode(bars).alias("_b")
    ).select(SERIES, "model", "rank", "top3", "_b.metric", "_b.value", "_b.warn")


def chart_radar(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Scores normalised again within the first k models of a series."""
    scored = score_columns(top_k(ranked, k), [SERIES])
    return scored.select(SERIES, "model", "rank", "composite_score", "s_rmse", "s_mae", "s_r2", "s_mase", "s_mape")


def chart_residuals(ranked: DataFrame, forecasts: DataFrame, k: int = 3, window_rows: int = 5) -> DataFrame:
    """Residuals of the top models with a centred rolling mean."""
    best = _ranked_forecasts(ranked, forecasts, k)
    return residuals(best, [SERIES, *FORECAST_ID], window_rows).select(
        SERIES, *FORECAST_ID, "rank", TS, "residual", "rolling_mean"
    )
