"""Recursive rollout of a linear recursion: every forecast feeds the next one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import spread

# Steps per rolled-out piece; the state at the start of a piece is a matrix power away.
CHUNK = 1024


def step_matrix(coef: np.ndarray, intercept: float, theta: np.ndarray) -> np.ndarray:
    """One step of the recursion on (last values, last residuals, 1); later residuals are zero."""
    width, moving = len(coef), len(theta)
    step = np.zeros((width + moving + 1, width + moving + 1))
    if width:
        step[0] = [*coef, *theta, intercept]
        step[np.arange(1, width), np.arange(width - 1)] = 1.0
    if moving:
        step[np.arange(width + 1, width + moving), np.arange(width, width + moving - 1)] = 1.0
    step[-1, -1] = 1.0
    return step


def state_after(coef, intercept, state, theta, shocks, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last values and residuals ``start`` steps on: a matrix power away."""
    if not start:
        return state, shocks
    power = np.linalg.matrix_power(step_matrix(coef, intercept, theta), start)
    moved = power @ np.concatenate([state, shocks, [1.0]])
    return moved[: len(state)], moved[len(state) : -1]


def roll_many(pieces: list[tuple]) -> list[np.ndarray]:
    """Forecasts of many recursions side by side: one array operation a step, whatever their number.

    A piece is (coef, intercept, state, theta, shocks, start, steps): forecasts start+1 .. start+steps of
    y_t = intercept + sum_j coef[j] * y_(t-1-j) + sum_j theta[j] * e_(t-1-j), with the last values and residuals
    newest first and residuals after the last one zero.
    """
    width = max((len(p[0]) for p in pieces), default=0)
    moving = max((len(p[3]) for p in pieces), default=0)
    longest = max((p[6] for p in pieces), default=0)
    coefs, thetas = np.zeros((len(pieces), width)), np.zeros((len(pieces), moving))
    # values oldest first, so that the forecasts follow the last of them
    values, errors = np.zeros((len(pieces), width + longest)), np.zeros((len(pieces), moving + longest))
    intercepts = np.array([p[1] for p in pieces], dtype=float)
    for i, (coef, intercept, state, theta, shocks, start, _) in enumerate(pieces):
        coef, theta = np.asarray(coef, dtype=float), np.asarray(theta, dtype=float)
        recent = np.asarray(state, dtype=float)[: len(coef)]
        late = np.zeros(len(theta))
        late[: len(shocks)] = np.asarray(shocks, dtype=float)[: len(theta)]
        recent, late = state_after(coef, intercept, recent, theta, late, start)
        coefs[i, width - len(coef) :], thetas[i, moving - len(theta) :] = coef[::-1], theta[::-1]
        values[i, width - len(coef) : width], errors[i, moving - len(theta) : moving] = recent[::-1], late[::-1]
    for h in range(longest):
        known = np.einsum("ij,ij->i", coefs, values[:, h : h + width]) + intercepts
        values[:, width + h] = known + np.einsum("ij,ij->i", thetas, errors[:, h : h + moving])
    return [values[i, width : width + p[6]] for i, p in enumerate(pieces)]


def roll(coef: np.ndarray, intercept: float, state: np.ndarray, start: int, steps: int, theta=(), shocks=()) -> np.ndarray:
    """One recursion of :func:`roll_many`."""
    return roll_many([(coef, intercept, state, theta, shocks, start, steps)])[0]


def recursive_rollout(fits: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Forecast rows (keys, step from 1, yhat) for fits with coef, intercept, state and horizon, and theta and
    shocks where they have moving-average terms.

    A long horizon is cut into pieces that different tasks roll out independently.
    """
    schema = T.StructType(
        [fits.schema[k] for k in keys]
        + [T.StructField("_start", T.LongType()), T.StructField("_yhat", T.ArrayType(T.DoubleType()))]
    )

    moving = "theta" in fits.columns

    def run(batches):
        for pdf in batches:
            terms = list(zip(pdf["theta"], pdf["shocks"])) if moving else [((), ())] * len(pdf)
            pieces = [
                (c, i, s, theta, shocks, int(at), int(min(chunk, h - at)))
                for c, i, s, (theta, shocks), at, h in zip(pdf["coef"], pdf["intercept"], pdf["state"], terms, pdf["_start"], pdf["horizon"])
            ]
            out = pdf[[*keys, "_start"]].copy()
            with np.errstate(all="ignore"):  # an explosive fit overflows; its forecast is missing
                out["_yhat"] = [v.tolist() for v in roll_many(pieces)]
            yield out

    starts = F.sequence(F.lit(0).cast("bigint"), F.col("horizon").cast("bigint") - 1, F.lit(chunk).cast("bigint"))
    pieces = fits.where("horizon > 0").select(
        *keys, "coef", "intercept", "state", *(["theta", "shocks"] if moving else []), "horizon", F.explode(starts).alias("_start")
    )
    rolled = spread(pieces, *keys, "_start").mapInPandas(run, schema)
    return rolled.select(*keys, "_start", F.posexplode("_yhat").alias("_i", "yhat")).select(
        *keys, (F.col("_start") + F.col("_i") + 1).alias("step"), "yhat"
    )
