"""Piecewise-linear trend plus Fourier seasonality, fitted with Gaussian priors.

The fit needs only the cross products of a design matrix, added up over all tasks; all prior scales
of a grid are then solved from the same sums. Multiplicative seasonality is an additive fit of log y.
"""

from __future__ import annotations

import json
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.forecast.common import HORIZON, forecast_rows
from tidewater.forecast.gram import cross_products, partial_sums, square
from tidewater.functions.catalog import VARIATIONS as CATALOG
from tidewater.operators.positions import SERIES, TS, Y, over_neighbours
from tidewater.operators.ranking import best_candidate, mark_chosen
from tidewater.operators.splits import holdout_split
from tidewater.session import spread

# Changepoints, Fourier orders, prior scale of the base trend, the tuning grid.
CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
YEARLY, WEEKLY, DAILY = (365.25, 10), (7.0, 3), (1.0, 4)
BASE_SCALE = 5.0
VARIATIONS = CATALOG["prophet"]
GRID = [
    {"changepoint_prior_scale": c, "seasonality_prior_scale": s, "seasonality_mode": m}
    for c, s, m in product([0.001, 0.01, 0.1, 0.5], [0.01, 0.1, 1.0, 10.0], ["additive", "multiplicative"])
]
WIDTH = 2 + CHANGEPOINTS + 2 * (YEARLY[1] + WEEKLY[1] + DAILY[1])
FRAME_COLUMNS = ["t0", "t_span", "y_scale", "log_shift", "yearly", "weekly", "daily"]


def days(ts):
    """Days since 1970 as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000.0


def time_frames(train: DataFrame) -> DataFrame:
    """Per series: time range, y scale, and which seasonalities its length and spacing allow."""
    gaps = over_neighbours(
        train.select(SERIES, TS, "rn", Y, days(F.col(TS)).alias("day")),
        lambda rows, w: rows.withColumn("gap", F.col("day") - F.lag("day").over(w)),
        behind=1,
    )
    span, gap = F.max("day") - F.min("day"), F.min("gap")
    size = F.max(F.abs(Y))
    return gaps.groupBy(SERIES).agg(
        F.min("day").alias("t0"),
        F.when(span > 0, span).otherwise(1.0).alias("t_span"),
        F.when(size > 0, size).otherwise(1.0).alias("y_scale"),
        F.when(F.min(Y) > 0, F.avg(F.log(F.when(F.col(Y) > 0, F.col(Y))))).alias("log_shift"),
        (span >= 730).alias("yearly"),
        ((span >= 14) & (gap < 7)).alias("weekly"),
        ((span >= 2) & (gap < 1)).alias("daily"),
    )


def design(day: np.ndarray, frame) -> np.ndarray:
    """Trend, changepoint hinges and Fourier terms; disabled seasonalities are zero columns."""
    t = (day - frame.t0) / frame.t_span
    knots = CHANGEPOINT_RANGE * np.arange(1, CHANGEPOINTS + 1) / CHANGEPOINTS
    parts = [np.ones((len(t), 1)), t[:, None], np.clip(t[:, None] - knots, 0.0, None)]
    for (length, order), on in ((YEARLY, frame.yearly), (WEEKLY, frame.weekly), (DAILY, frame.daily)):
        angle = 2 * np.pi * day[:, None] * np.arange(1, order + 1) / length
        parts.append(np.hstack([np.sin(angle), np.cos(angle)]) * float(on))
    return np.hstack(parts)


def targets(y: np.ndarray, frame) -> np.ndarray:
    """[y / scale, log y - shift] (zero where the series is not positive)."""
    logged = np.zeros(len(y)) if pd.isna(frame.log_shift) else np.log(y) - frame.log_shift
    return np.column_stack([y / frame.y_scale, logged])


def prior_weights(params: dict) -> np.ndarray:
    scales = np.full(WIDTH, float(params["seasonality_prior_scale"]))
    scales[:2] = BASE_SCALE
    scales[2 : 2 + CHANGEPOINTS] = params["changepoint_prior_scale"]
    return 1.0 / scales**2


def solve(gram: np.ndarray, params: dict, rounds: int = 8) -> np.ndarray:
    """Posterior mode; the noise variance is re-estimated from the residuals a few times."""
    target = WIDTH + (params["seasonality_mode"] == "multiplicative")
    a, b, yy, n = gram[:WIDTH, :WIDTH], gram[:WIDTH, target], gram[target, target], gram[0, 0]
    prior, variance = prior_weights(params), max(yy / n, 1e-12) * 0.1
    coef = np.zeros(WIDTH)
    for _ in range(rounds):
        coef = np.linalg.solve(a + variance * np.diag(prior), b)
        variance = max(float(yy - 2 * coef @ b + coef @ a @ coef) / n, 1e-12)
    return coef


def trend_fits(train: DataFrame, grid: list[dict]) -> DataFrame:
    """(series_id, frame columns, coefs): one coefficient array per grid entry (NULL if impossible)."""
    frames = time_frames(train)
    keys = [SERIES, *FRAME_COLUMNS]
    rows = train.select(SERIES, days(F.col(TS)).alias("day"), Y).join(frames, SERIES)
    def payload(pdf):
        frame = next(pdf.iloc[:1].itertuples(index=False))
        x = np.hstack([design(pdf["day"].to_numpy(), frame), targets(pdf[Y].to_numpy(dtype=float), frame)])
        return cross_products(x)

    grams = partial_sums(rows, [SERIES], payload).join(frames, SERIES)
    schema = T.StructType([grams.schema[k] for k in keys] + [T.StructField("coefs", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for pdf in batches:
            coefs = []
            for flat, shift in zip(pdf["gram"], pdf["log_shift"]):
                gram = square(flat, WIDTH + 2)
                coefs.append(
                    [
                        None if p["seasonality_mode"] == "multiplicative" and pd.isna(shift) else solve(gram, p).tolist()
                        for p in grid
                    ]
                )
            yield pdf[keys].assign(coefs=coefs)

    return spread(grams, SERIES).mapInPandas(run, schema)


# Rows per array when rows meet a grid of coefficients, so that the coefficients travel once per block.
ROW_BLOCK = 4096


class _Frame:
    def __init__(self, t0, t_span, y_scale, log_shift, yearly, weekly, daily):
        self.t0, self.t_span, self.y_scale, self.log_shift = t0, t_span, y_scale, log_shift
        self.yearly, self.weekly, self.daily = yearly, weekly, daily


def predict_trend(rows: DataFrame, fits: DataFrame, grid: list[dict], extra: list[str]) -> DataFrame:
    """One row per input row and grid entry: series_id, variation, extra columns, yhat."""

    @F.pandas_udf("array<array<double>>")
    def fitted(day: pd.Series, t0: pd.Series, t_span: pd.Series, y_scale: pd.Series, log_shift: pd.Series,
               yearly: pd.Series, weekly: pd.Series, daily: pd.Series, coefs: pd.Series) -> pd.Series:
        out = []
        for d, c, *frame in zip(day, coefs, t0, t_span, y_scale, log_shift, yearly, weekly, daily):
            frame = _Frame(*frame)
            x = design(np.asarray(d, dtype=float), frame)
            out.append([None if coef is None else _on_scale(x @ np.asarray(coef, dtype=float), frame, p)
                        for coef, p in zip(c, grid)])
        return pd.Series(out)

    packed = (
        rows.select(SERIES, F.floor(F.col("rn") / ROW_BLOCK).alias("_block"), days(F.col(TS)).alias("day"), *extra)
        .groupBy(SERIES, "_block")
        .agg(F.collect_list(F.struct("day", *extra)).alias("_rows"))
        .join(fits, SERIES)
    )
    day = F.transform("_rows", lambda r: r["day"])
    made = packed.select(SERIES, "_rows", fitted(day, *FRAME_COLUMNS, "coefs").alias("_fitted"))
    per_entry = made.select(SERIES, "_rows", F.posexplode("_fitted").alias("variation", "_yhat"))
    zipped = per_entry.where("_yhat is not null").select(
        SERIES, "variation", F.explode(F.arrays_zip("_rows", "_yhat")).alias("_z")
    )
    return zipped.select(
        SERIES, "variation", *[F.col(f"_z._rows.{c}").alias(c) for c in extra], F.col("_z._yhat").alias("yhat")
    )


def _on_scale(fitted: np.ndarray, frame, params: dict) -> list[float]:
    if params["seasonality_mode"] == "multiplicative":
        return np.exp(fitted + frame.log_shift).tolist()
    return (fitted * frame.y_scale).tolist()


def forecast_trend_seasonal(split: DataFrame, grid: list[dict] | None = None) -> DataFrame:
    grid = grid or VARIATIONS
    fits = trend_fits(split.where("is_train"), grid)
    rows = predict_trend(split.where(~F.col("is_train")), fits, grid, [TS, "rn", "n_train", Y])
    return forecast_rows(rows, "prophet", F.col("yhat"), HORIZON)


def trend_candidates(split: DataFrame, grid: list[dict] | None = None, val_frac: float = 0.2) -> DataFrame:
    grid = grid or GRID
    held = holdout_split(split, val_frac)
    fits = trend_fits(held.where("role = 'fit'"), grid)
    rows = predict_trend(held.where("role = 'val'"), fits, grid, ["rn", Y])
    err = F.col(Y) - F.col("yhat")
    names = F.array(*[F.lit(json.dumps(p)) for p in grid])
    scored = rows.groupBy(SERIES, "variation").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    return mark_chosen(
        scored.select(
            SERIES, F.lit("prophet").alias("model_key"), F.col("variation").alias("candidate_no"),
            names[F.col("variation")].alias("params"), "rmse",
        ),
        [SERIES],
    )


def tune_trend_seasonal(split: DataFrame, grid: list[dict] | None = None, val_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    grid = grid or GRID
    candidates = trend_candidates(split, grid, val_frac)
    best = best_candidate(candidates, [SERIES]).select(SERIES, F.col("candidate_no").alias("variation"), "params")
    forecasts = forecast_trend_seasonal(split, grid).join(best, [SERIES, "variation"])
    return candidates, forecasts.withColumn("variation", F.lit(0))


__all__ = ["GRID", "VARIATIONS", "forecast_trend_seasonal", "trend_candidates", "tune_trend_seasonal"]
