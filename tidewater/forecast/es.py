"""Exponential smoothing with additive, multiplicative or no trend and seasonality.

The smoothing weights come from a grid, and the point with the smallest one-step squared error wins. Combinations
of additive parts are affine in the state and run as a scan over blocks (:mod:`smoothing_maps`). Multiplicative
parts are not: there all grid points of a series are carried side by side through one ordered pass, and
a series of timestamps is worked off block by block, every block of all series in parallel, with the small
states handed on between the passes.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.ar import with_period
from tidewater.forecast.common import forecast_rows, test_rows
from tidewater.forecast.smoothing_maps import additive_states, in_slices
from tidewater.operators.positions import BLOCK_ROWS, SERIES, Y, one_row_per_date
from tidewater.operators.ranking import best_candidate, mark_chosen
from tidewater.session import cut_lineage, spread

# The three variations and the nine tuning combinations.
VARIATIONS = [("add", "add"), ("add", None), ("mul", "mul")]
COMBINATIONS = list(product(("add", "mul", None), ("add", "mul", None)))

LEVEL_WEIGHTS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
TREND_WEIGHTS = [0.01, 0.05, 0.1, 0.3]
SEASON_WEIGHTS = [0.01, 0.1, 0.3, 0.6]


def weight_grid(trend: str | None, seasonal: str | None) -> np.ndarray:
    """Columns: level, trend and season weight; an absent component has weight zero."""
    return np.array(
        list(product(LEVEL_WEIGHTS, TREND_WEIGHTS if trend else [0.0], SEASON_WEIGHTS if seasonal else [0.0]))
    ).T


def start_state(y: np.ndarray, trend: str | None, seasonal: str | None, period: int) -> tuple | None:
    """(level, trend, season) from the first two seasons, or None where the model cannot be fitted."""
    if "mul" in (trend, seasonal) and np.any(y <= 0):
        return None
    if seasonal is None:
        if len(y) < (2 if trend else 1):
            return None
        slope = 0.0 if not trend else (y[1] - y[0] if trend == "add" else y[1] / y[0])
        return y[0], slope, np.zeros(0)
    if len(y) < 2 * period:
        return None
    first, second = y[:period], y[period : 2 * period]
    level = first.mean()
    if trend == "add":
        slope = (second.mean() - level) / period
    else:
        slope = (second.mean() / level) ** (1.0 / period) if trend else 0.0
    return level, slope, first - level if seasonal == "add" else first / level


def smooth(y, at, level, slope, season, sse, weights, trend, seasonal):
    """Carry the states of all grid points through the values y, the first of which is row ``at``."""
    alpha, beta, gamma = weights
    period = season.shape[1]
    for t, value in enumerate(y, start=at):
        base = level + slope if trend == "add" else level * slope if trend == "mul" else level
        if seasonal:
            s = season[:, t % period]
            expected = base + s if seasonal == "add" else base * s
            adjusted = value - s if seasonal == "add" else value / s
        else:
            expected, adjusted = base, value
        sse = sse + (value - expected) ** 2
        new = alpha * adjusted + (1 - alpha) * base
        if trend:
            step = new - level if trend == "add" else new / level
            slope = beta * step + (1 - beta) * slope
        if seasonal:
            own = value - base if seasonal == "add" else value / base
            season[:, t % period] = gamma * own + (1 - gamma) * s
        level = new
    return level, slope, season, sse


STATE_SCHEMA = (
    f"{SERIES} string, variation int, period int, seen long, level array<double>, slope array<double>, "
    "season array<double>, sse array<double>"
)
STATE_COLUMNS = [SERIES, "variation", "period", "seen", "level", "slope", "season", "sse"]


def _grids(combos, weights):
    return [weight_grid(*c) if weights is None else np.asarray(weights, dtype=float).T for c in combos]


def _advance(state, y, combos, grids):
    """State rows after the values y."""
    out = []
    for row in state:
        sid, v, period, seen, level, slope, season, sse = row
        trend, seasonal = combos[v]
        if "mul" in (trend, seasonal) and np.any(y <= 0):
            sse = [float("nan")] * len(level)
        level, slope, season, sse = smooth(
            y, seen, np.asarray(level, dtype=float), np.asarray(slope, dtype=float),
            np.array(season, dtype=float).reshape(len(level), -1), np.asarray(sse, dtype=float), grids[v], trend, seasonal,
        )
        out.append((sid, v, period, seen + len(y), level.tolist(), slope.tolist(), season.ravel().tolist(), sse.tolist()))
    return out


def _begin(sid, y, period, combos, grids):
    out = []
    for v, (trend, seasonal) in enumerate(combos):
        first = start_state(y, trend, seasonal, period)
        if first is None:
            continue
        points = grids[v].shape[1]
        level, slope, season = first
        out.append(
            (sid, v, period, 0, [level] * points, [slope] * points, np.tile(season, points).tolist(), [0.0] * points)
        )
    return out


FIT_SCHEMA = (
    f"{SERIES} string, variation int, period int, level double, slope double, season array<double>, "
    "sse double, point int"
)


def smoothing_states(train: DataFrame, combos: list, weights=None, block_rows: int = BLOCK_ROWS, best_only: bool = False) -> DataFrame:
    """Final states of all grid points per series and combination, or fits of the best point of each.

    ``train`` holds series_id, rn, y and period. Start values come from the first block.
    """
    grids = _grids(combos, weights)
    block = F.floor(F.col("rn") / block_rows).alias("_block")
    rows = spread(train.select(SERIES, "rn", Y, "period", block), SERIES)

    def first_block(pdf):
        with np.errstate(all="ignore"):
            y = pdf.sort_values("rn")[Y].to_numpy(dtype=float)
            begun = _begin(pdf[SERIES].iloc[0], y, int(pdf["period"].iloc[0]), combos, grids)
            return pd.DataFrame(_advance(begun, y, combos, grids), columns=STATE_COLUMNS)

    def later_block(state, pdf):
        if pdf.empty or state.empty:
            return state
        with np.errstate(all="ignore"):
            y = pdf.sort_values("rn")[Y].to_numpy(dtype=float)
            return pd.DataFrame(_advance(list(state.itertuples(index=False)), y, combos, grids), columns=STATE_COLUMNS)

    if one_row_per_date(train):
        if best_only:  # states of whole grids do not leave the group
            return rows.groupBy(SERIES).applyInPandas(lambda pdf: _best_points(first_block(pdf)), FIT_SCHEMA)
        return rows.groupBy(SERIES).applyInPandas(first_block, STATE_SCHEMA)
    state = rows.where("_block = 0").groupBy(SERIES).applyInPandas(first_block, STATE_SCHEMA)
    last = rows.agg(F.max("_block")).first()[0] or 0
    for block in range(1, int(last) + 1):
        part = rows.where(F.col("_block") == block)
        state = cut_lineage(state).groupBy(SERIES).cogroup(part.groupBy(SERIES)).applyInPandas(later_block, STATE_SCHEMA)
    if best_only:
        return state.mapInPandas(lambda batches: map(_best_points, in_slices(batches)), FIT_SCHEMA)
    return state


def _best_points(states: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in states.itertuples(index=False):
        sse = np.asarray(row.sse, dtype=float)
        if not np.isfinite(sse).any():
            continue
        best = int(np.nanargmin(np.where(np.isfinite(sse), sse, np.nan)))
        season = np.asarray(row.season, dtype=float).reshape(len(sse), -1)[best]
        out.append((row.series_id, row.variation, row.period, row.level[best], row.slope[best], season.tolist(), sse[best], best))
    return pd.DataFrame(out, columns=[SERIES, "variation", "period", "level", "slope", "season", "sse", "point"])


def fit_smoothing(train: DataFrame, combos: list, weights=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(series_id, variation, period, level, slope, season, sse) of the best grid point."""
    grids = dict(enumerate(_grids(combos, weights)))
    additive = {v: c for v, c in enumerate(combos) if "mul" not in c}
    others = [v for v in range(len(combos)) if v not in additive]
    parts = []
    if additive:
        parts.append(additive_states(train, additive, {v: grids[v] for v in additive}, start_state, block_rows))
    if others:
        named = F.element_at(F.array(*[F.lit(v) for v in others]), F.col("variation") + 1)
        stepwise = smoothing_states(train, [combos[v] for v in others], weights, block_rows, best_only=True)
        parts.append(stepwise.withColumn("variation", named))
    return reduce(DataFrame.unionByName, parts)


def smoothing_forecast(rows: DataFrame, combos: list):
    """Forecast column for rows joined with fits: level, trend carried forward, season by position."""
    step = (F.col("rn") - F.col("n_train") + 1).cast("double")
    trends = F.array(*[F.lit(t or "none") for t, _ in combos])[F.col("variation")]
    seasons = F.array(*[F.lit(s or "none") for _, s in combos])[F.col("variation")]
    base = (
        F.when(trends == "add", F.col("level") + step * F.col("slope"))
        .when(trends == "mul", F.col("level") * F.pow("slope", step))
        .otherwise(F.col("level"))
    )
    season = F.get("season", (F.col("rn") % F.col("period")).cast("int"))
    return F.when(seasons == "add", base + season).when(seasons == "mul", base * season).otherwise(base)


def forecast_es(
    split: DataFrame, combos: list | None = None, period: int | None = None, weights=None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    combos = combos or VARIATIONS
    train = with_period(split, period).where("is_train")
    fits = fit_smoothing(train, combos, weights, block_rows)
    rows = test_rows(split).join(fits, SERIES)
    return forecast_rows(rows, "es", smoothing_forecast(rows, combos))


def es_candidates(split: DataFrame, period: int | None = None, val_frac: float = 0.2, weights=None) -> DataFrame:
    """Holdout RMSE of the nine combinations; seasonal ones need two periods of fit rows."""
    val = F.least(F.greatest(F.lit(1), F.floor(F.col("n_train") * F.lit(val_frac))), F.col("n_train") - 1)
    fit_split = (
        with_period(split, period)
        .where("is_train")
        .withColumn("n_train", (F.col("n_train") - val).cast("bigint"))
        .withColumn("is_train", F.col("rn") < F.col("n_train"))
    )
    forecasts = forecast_es(fit_split, COMBINATIONS, period, weights)
    err = F.col(Y) - F.col("yhat")
    names = F.array(*[F.lit(json.dumps({"trend": t, "seasonal": s})) for t, s in COMBINATIONS])
    scored = forecasts.groupBy(SERIES, "variation").agg(
        F.when(F.count("yhat") == F.count(Y), F.sqrt(F.avg(err * err))).alias("rmse")
    )
    return mark_chosen(
        scored.select(
            SERIES, F.lit("es").alias("model_key"), F.col("variation").alias("candidate_no"),
            names[F.col("variation")].alias("params"), "rmse",
        ),
        [SERIES],
    )


def tune_es(split: DataFrame, period: int | None = None, val_frac: float = 0.2, weights=None) -> tuple[DataFrame, DataFrame]:
    """(candidates, forecasts of the best combination fitted on all training rows)."""
    candidates = es_candidates(split, period, val_frac, weights)
    best = best_candidate(candidates, [SERIES]).select(SERIES, F.col("candidate_no").alias("variation"), "params")
    forecasts = forecast_es(split, COMBINATIONS, period, weights).join(best, [SERIES, "variation"])
    return candidates, forecasts.withColumn("variation", F.lit(0))
