"""Linear models on lag, rolling and calendar features, one fit per series.

Squared and absolute-penalty losses are solved from one pass of cross products per series (and per
fold segment when tuning). Huber and quantile losses re-weight the rows: a series of dates fits in
one task and is iterated there; series of timestamps are iterated as Spark jobs, each pass adding up
weighted cross products over all tasks.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.common import ONE_STEP, forecast_rows, train_scale
from tidewater.forecast.gram import (
    STACK_ROWS, centred, cross_products, flat_directions, group_starts, partial_sums, solve_again, solve_many, solve_sym, square, stacks,
)
from tidewater.operators.features import CALENDAR, feature_names
from tidewater.operators.positions import SERIES, TS, Y, one_row_per_date
from tidewater.operators.ranking import best_candidate, mark_chosen
from tidewater.operators.splits import fold_start
from tidewater.session import cut_lineage, spread

# Shifts that keep calendar columns small; a shift changes no prediction.
CALENDAR_SHIFT = {"dayofweek": 3, "month": 6, "quarter": 2, "year": 2000}
# Huber's epsilon and ridge weight, the default lasso weight, the grids.
EPSILON, HUBER_RIDGE, LASSO_ALPHA = 1.35, 1e-4, 0.01
GRIDS = {
    "l2": [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0)],
    "l1": [{"alpha": a} for a in (0.001, 0.01, 0.1, 1.0)],
    "huber": [{"epsilon": e} for e in (1.0, 1.35, 2.0)],
    "quantile": [{"quantile": 0.5}],
}
VARIATIONS = [{"loss": "l2", "lags": 3}, {"loss": "l1", "alpha": 0.1, "lags": 5}, {"loss": "huber", "lags": 7}]
# A re-weighted fit has converged when its mean loss, in deviations of y, is proven to be this close to the least one.
# It goes on until its coefficients settle too, but not beyond the least number of passes that counts as enough once
# proven; a fit without the proof gets as many as there are, fewer where a pass is a Spark job.
TOLERANCE, SETTLED = 1e-4, 1e-6
ENOUGH_PASSES, MAX_PASSES, MAX_JOBS = 40, 2000, 120


def standardised(split: DataFrame, columns: list[str]) -> DataFrame:
    """``x``: features with y-like columns in units of the series' training mean and deviation; ``z``: y."""
    return in_units(split.join(train_scale(split), SERIES), columns)


def in_units(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """:func:`standardised` for rows that hold the mean and deviation of their series; further columns are kept."""
    mean, std = F.col("y_mean"), F.col("y_std")

    def unit(c):
        if c in CALENDAR:
            return (F.col(c) - CALENDAR_SHIFT[c]).cast("double")
        return F.col(c) / std if c == "rolling_std" else (F.col(c) - mean) / std

    return rows.select(
        SERIES, TS, "rn", "n_train", "is_train", Y, "y_mean", "y_std", *more,
        F.array(*[unit(c) for c in columns]).alias("x"),
        ((F.col(Y) - mean) / std).alias("z"),
    )


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    """[1, features, target] of a batch of standardised rows."""
    x = np.array(pdf["x"].tolist(), dtype=float)
    return np.column_stack([np.ones(len(pdf)), x, pdf["z"].to_numpy(dtype=float)])


def used_columns(spec: dict, columns: list[str]) -> list[int]:
    lags = spec.get("lags") or len(columns)
    return [i for i, c in enumerate(columns) if not c.startswith("lag_") or int(c[4:]) <= lags]


def raw_weight(columns: list[str], std: float) -> np.ndarray:
    """Raw coefficient = weight * standardised coefficient."""
    return np.array([std if c in CALENDAR else 1.0 for c in columns])


def ridge(gram, use, alpha, weight) -> np.ndarray:
    n, means, c = centred(gram)
    k = len(means) - 1
    full = np.zeros(k + 1)
    a = c[np.ix_(use, use)] + alpha * np.diag(weight[use] ** 2)
    full[[u + 1 for u in use]] = solve_sym(a, c[use, k])
    full[0] = means[k] - means[:k] @ full[1:]
    return full


def ridges(m: np.ndarray, use: list[int]) -> np.ndarray:
    """:func:`ridge` without a penalty, of a stack of rows filled up with zeros."""
    m = np.where(np.isnan(m).any(axis=2)[..., None], 0.0, m)
    gram = m.transpose(0, 2, 1) @ m
    means = gram[:, 0, 1:] / gram[:, :1, 0]
    c = gram[:, 1:, 1:] - gram[:, :1, :1] * (means[:, :, None] * means[:, None, :])
    full = np.zeros((len(m), m.shape[2] - 1))
    full[:, [u + 1 for u in use]] = solve_many(c[:, use][:, :, use], c[:, use, -1])
    full[:, 0] = means[:, -1] - np.sum(means[:, :-1] * full[:, 1:], axis=1)
    return full


def lasso(a: np.ndarray, b: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Minimiser of w'aw / 2 - b'w + threshold'|w| by growing a set of signed non-zero coefficients.

    The most violated coefficient joins the set, the set is solved exactly, and a coefficient that
    would change sign on the way leaves it again.
    """
    scale = np.sqrt(np.clip(np.diag(a), 0.0, None))
    usable = scale > 1e-9
    scale[~usable] = 1.0
    a, b, threshold = a / np.outer(scale, scale), b / scale, threshold / scale
    w, signs = np.zeros(len(b)), np.zeros(len(b))
    for _ in range(20 * len(b)):
        slope = b - a @ w
        violation = np.where((signs == 0) & usable, np.abs(slope) - threshold, -np.inf)
        worst = int(np.argmax(violation))
        if violation[worst] <= 1e-11:
            break
        signs[worst] = np.sign(slope[worst])
        while signs.any():
            on = np.flatnonzero(signs)
            values, vectors = np.linalg.eigh(a[np.ix_(on, on)])
            pull = vectors.T @ (b[on] - threshold[on] * signs[on] - a[on] @ w)
            flat = values < 1e-12 * len(on)
            endless = flat & (np.abs(pull) > 1e-13)
            if endless.any():
                move = vectors[:, endless] @ pull[endless] * 1e15
            else:
                move = vectors[:, ~flat] @ (pull[~flat] / values[~flat])
            target = w[on] + move
            crossing = target * signs[on] < 0
            if not crossing.any():
                w[on] = target
                break
            shares = np.where(crossing, w[on] / np.where(crossing, w[on] - target, 1.0), np.inf)
            first = int(np.argmin(shares))
            w[on] = w[on] + shares[first] * move
            w[on[first]] = signs[on[first]] = 0.0
    return w / scale


def lasso_fits(grams: list, use: list[int], alphas: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients (constant first) of lasso problems given by their cross products."""
    fits = []
    for gram, alpha, weight in zip(grams, alphas, weights):
        n, means, c = centred(gram)
        k = len(means) - 1
        full = np.zeros(k + 1)
        full[[u + 1 for u in use]] = lasso(c[np.ix_(use, use)] / n, c[use, k] / n, alpha * weight[use])
        full[0] = means[k] - means[:k] @ full[1:]
        fits.append(full)
    return np.array(fits)


def solve_closed(grams: list, spec: dict, columns: list[str], stds: np.ndarray) -> np.ndarray:
    """Plain or ridge least squares, or lasso, of many groups. Penalties are meant for y in its own units."""
    use = used_columns(spec, columns)
    weights = np.stack([raw_weight(columns, s) for s in stds])
    if spec["loss"] == "l1":
        alpha = LASSO_ALPHA if spec.get("alpha") is None else spec["alpha"]
        return lasso_fits(grams, use, alpha / stds**2, weights)
    alpha = spec.get("alpha") or 0.0
    return np.stack([ridge(g, use, alpha / s**2, w) for g, s, w in zip(grams, stds, weights)])


# Re-weighted losses: one pass = weights from the last coefficients, then cross products.


def weighted_sums(m: np.ndarray, coef: np.ndarray, sigma: float, delta: float, spec: dict) -> np.ndarray:
    """[weighted cross products, column sums, rows, outliers, squared inlier residuals], flat."""
    r = m[:, -1] - m[:, :-1] @ coef
    size = np.abs(r)
    if spec["loss"] == "huber":
        inlier = size <= spec["epsilon"] * sigma
        w = np.where(inlier, 1.0, spec["epsilon"] * sigma / np.maximum(size, 1e-300))
    else:
        inlier = np.ones(len(r), dtype=bool)
        w = 1.0 / (size + delta)
    tail = [len(r), np.sum(~inlier), np.sum(r[inlier] ** 2)]
    return np.concatenate([((m * w[:, None]).T @ m).ravel(), m[:, :-1].sum(axis=0), tail])


def reweighted_step(sums, spec: dict, use: list[int], weight, std, coef, sigma) -> tuple[np.ndarray, float]:
    """Next (coefficients, sigma) from one pass of weighted sums."""
    k = len(coef)
    gram = square(sums[: (k + 1) ** 2], k + 1)
    totals, (n, outliers, inlier_sq) = sums[(k + 1) ** 2 : (k + 1) ** 2 + k], sums[-3:]
    keep = [0, *[u + 1 for u in use]]
    a, b = gram[np.ix_(keep, keep)].copy(), gram[keep, k].copy()
    if spec["loss"] == "huber":
        penalty = HUBER_RIDGE / std * sigma * weight[use] ** 2
        a[np.arange(1, len(keep)), np.arange(1, len(keep))] += penalty
        free = n - outliers * spec["epsilon"] ** 2
        if free > 0 and inlier_sq > 0:
            sigma = float(np.sqrt(inlier_sq / free))
    else:
        b += (2 * spec["quantile"] - 1) * totals[keep]
    new = np.zeros(k)
    new[keep] = solve_sym(a, b)
    return new, sigma


def best_scale(r: np.ndarray, epsilon: float) -> float:
    """The sigma that goes with these residuals: their squares in units of it, cut at epsilon squared, average one."""
    size = np.sort(np.abs(r))
    inliers = np.arange(1, len(r) + 1)
    free = len(r) - (len(r) - inliers) * epsilon**2
    scale = np.sqrt(np.cumsum(size**2) / np.where(free > 0, free, np.nan))
    fits = (size <= epsilon * scale) & (np.append(size[1:], np.inf) > epsilon * scale)
    return float(scale[fits][0]) if fits.any() else 0.0


# How far a fit is from the least loss. A multiplier per row, within the bounds that the loss sets and balanced over
# every feature, bounds the least loss from below; the weights of a pass give balanced multipliers for the
# coefficients that they lead to, and dividing by the largest excess brings them within bounds.


def dual_sums(m: np.ndarray, coef: np.ndarray, sigma: float, before: tuple, spec: dict) -> tuple[np.ndarray, float]:
    """([loss, loss at sigma zero, multipliers times y, their squares, their sums over each feature], largest excess).

    ``before`` holds the (coefficients, sigma, smoothing) whose weights led to ``coef``.
    """
    x, y = m[:, :-1], m[:, -1]
    r, old = y - x @ coef, np.abs(y - x @ before[0])
    if spec["loss"] == "huber":
        eps = spec["epsilon"]
        w = np.where(old <= eps * before[1], 1.0, eps * before[1] / np.maximum(old, 1e-300))
        a, z = 2 * w * r / before[1], np.abs(r) / sigma
        excess = np.abs(a) / (2 * eps)
        loss = np.sum(sigma + sigma * np.where(z <= eps, z**2, 2 * eps * z - eps**2))
        flat = 2 * eps * np.sum(np.abs(r))
    else:
        q = spec["quantile"]
        a = (r / (old + before[2]) + 2 * q - 1) / 2
        excess = np.maximum(a / q, a / (q - 1))
        loss = flat = np.sum(np.maximum(q * r, (q - 1) * r))
    return np.concatenate([[loss, flat, a @ y, a @ a], x.T @ a]), float(np.max(excess, initial=0.0))


def proven_gap(sums, excess: float, n: float, coef, spec: dict, use: list[int], weight, std) -> float:
    """A proven bound on the mean loss above the least possible one, penalties included."""
    loss, flat, fitted, squares = sums[:4]
    keep, penalty, expected = [0, *[u + 1 for u in use]], 0.0, np.zeros(len(use) + 1)
    if spec["loss"] == "huber":
        pull = HUBER_RIDGE / std * weight[use] ** 2 * coef[keep[1:]]
        penalty, expected[1:] = float(pull @ coef[keep[1:]]), 2 * pull
        excess = max(excess, np.sqrt(squares / (4 * n)))
    loss = min(loss, flat) + penalty
    if not np.isfinite(loss):
        return np.inf
    least = 0.0  # no loss is below zero
    if excess > 0 and np.max(np.abs(sums[4:][keep] - expected)) <= 1e-8 * n:
        least = max(least, fitted / excess - penalty / excess**2)
    return max(loss - least, 0.0) / n


def with_defaults(spec: dict) -> dict:
    # Epsilon 1 would make every residual an outlier of the concomitant scale; it must exceed 1.
    out = {"epsilon": EPSILON, "quantile": 0.5, "upto": None, **spec}
    return {**out, "epsilon": max(out["epsilon"], 1.0001)}


def smoothing(i: int) -> float:
    """Rounding of the absolute value in pass i, in deviations of y: shrinks to a ten-thousandth."""
    return max(0.1 * 0.7**i, 1e-4)


def best_scales(r: np.ndarray, real: np.ndarray, epsilon: float) -> np.ndarray:
    """:func:`best_scale` of many series, one a line; ``real`` tells rows from filling."""
    n = real.sum(axis=1)[:, None]
    size = np.sort(np.where(real, np.abs(r), np.inf), axis=1)
    inliers = np.arange(1, size.shape[1] + 1)
    free = n - (n - inliers) * epsilon**2
    squares = np.cumsum(np.where(inliers <= n, size, 0.0) ** 2, axis=1)
    scale = np.sqrt(squares / np.where(free > 0, free, np.nan))
    above = np.append(size[:, 1:], np.full((len(size), 1), np.inf), axis=1)
    fits = (size <= epsilon * scale) & (above > epsilon * scale) & (inliers <= n)
    first = np.argmax(fits, axis=1)[:, None]
    return np.where(fits.any(axis=1), np.take_along_axis(scale, first, 1)[:, 0], 0.0)


def _bounded(x, y, real, n, coef, sigma, w, old_sigma, spec: dict, keep: list[int], pull_weight) -> np.ndarray:
    """:func:`proven_gap` of many series from their rows; ``w`` are the weights that led to ``coef``."""
    r = y - (x @ coef[..., None])[..., 0]
    penalty, expected = np.zeros(len(y)), np.zeros((len(y), len(keep)))
    if spec["loss"] == "huber":
        eps = spec["epsilon"]
        a, z = 2 * w * r / old_sigma[:, None], np.abs(r) / sigma[:, None]
        excess = np.abs(a) / (2 * eps)
        each = sigma[:, None] + sigma[:, None] * np.where(z <= eps, z**2, 2 * eps * z - eps**2)
        loss, flat = np.sum(np.where(real, each, 0.0), axis=1), 2 * eps * np.sum(np.abs(r), axis=1)
        pull = pull_weight * coef[:, keep[1:]]
        penalty, expected[:, 1:] = np.sum(pull * coef[:, keep[1:]], axis=1), 2 * pull
    else:
        q = spec["quantile"]
        a = np.where(real, (r * w + 2 * q - 1) / 2, 0.0)
        excess = np.maximum(a / q, a / (q - 1))
        loss = flat = np.sum(np.maximum(q * r, (q - 1) * r), axis=1)
    excess = np.max(excess, axis=1, initial=0.0)
    if spec["loss"] == "huber":
        excess = np.maximum(excess, np.sqrt(np.sum(a * a, axis=1) / (4 * n)))
    loss = np.minimum(loss, flat) + penalty
    balance = np.max(np.abs((x.transpose(0, 2, 1) @ a[..., None])[..., 0][:, keep] - expected), axis=1)
    inside = (excess > 0) & (balance <= 1e-8 * n)
    excess = np.where(inside, excess, 1.0)
    least = np.where(inside, np.maximum(np.sum(a * y, axis=1) / excess - penalty / excess**2, 0.0), 0.0)
    return np.where(np.isfinite(loss), np.maximum(loss - least, 0.0) / n, np.inf)


def _weights(x, y, coef, sigma, i: int, spec: dict) -> np.ndarray:
    """Weights of pass ``i``, from the coefficients and scales of the pass before."""
    size = np.abs(y - (x @ coef[..., None])[..., 0])
    if spec["loss"] == "huber":
        edge = spec["epsilon"] * sigma[:, None]
        return np.where(size <= edge, 1.0, edge / np.maximum(size, 1e-300))
    return 1.0 / (size + smoothing(i))


def iterate_side_by_side(m: np.ndarray, real: np.ndarray, spec: dict, columns: list[str], stds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the rows of many series (a stack of matrices, filled up with zeros where ``real`` is not set),
    and the proven gaps of their mean losses. Every pass takes the series that have not converged."""
    use, k = used_columns(spec, columns), m.shape[2] - 1
    keep, diagonal = [0, *[u + 1 for u in use]], np.arange(1, len(use) + 1)
    weight = np.stack([raw_weight(columns, s) for s in stds])
    coef = ridges(m, use)
    errors = m[..., -1] - (m[..., :-1] @ coef[..., None])[..., 0]
    sigma = np.std(errors, axis=1, where=real)
    sigma = np.where(sigma == 0, 1.0, sigma)
    best, gaps = coef.copy(), np.full(len(m), np.inf)
    at, n, totals = np.arange(len(m)), real.sum(axis=1), m[..., :-1].sum(axis=1)
    pull_weight = HUBER_RIDGE / stds[:, None] * weight[:, use] ** 2
    flat, passes = None, []
    for i in range(MAX_PASSES):
        x, y, before, old_sigma = m[..., :-1], m[..., -1], coef, sigma
        w = _weights(x, y, coef, sigma, i, spec)
        gram = (m * w[..., None]).transpose(0, 2, 1) @ m
        a, b = gram[:, keep][:, :, keep], gram[:, keep, k]
        if spec["loss"] == "huber":
            a[:, diagonal, diagonal] += pull_weight * sigma[:, None]
        else:
            b = b + (2 * spec["quantile"] - 1) * totals[:, keep]
        flat = flat_directions(a) if flat is None else flat
        coef = np.zeros(coef.shape)
        coef[:, keep] = solve_again(a, b, *flat)
        if spec["loss"] == "huber":
            sigma = np.maximum(best_scales(y - (x @ coef[..., None])[..., 0], real, spec["epsilon"]), smoothing(i))
        passes.append((i, before, old_sigma, coef, sigma))
        # Looked at as often as where it takes a job, so that both stop at the same coefficients.
        if i % 5 == 4 or i == MAX_PASSES - 1:
            # Once proven, the last one counts: the passes before matter only to series that this one proves nothing for.
            now = _bounded(x, y, real, n, coef, sigma, w, old_sigma, spec, keep, pull_weight)
            open_ = np.flatnonzero(~(now <= TOLERANCE))
            if len(open_):
                rows, inside, count, pull = x[open_], real[open_], n[open_], pull_weight[open_]
                for j, *state in passes[:-1]:
                    first, first_sigma, then, then_sigma = (v[open_] for v in state)
                    then_w = _weights(rows, y[open_], first, first_sigma, j, spec)
                    gap = _bounded(rows, y[open_], inside, count, then, then_sigma, then_w, first_sigma, spec, keep, pull)
                    proven = gap <= np.maximum(gaps[at[open_]], TOLERANCE)
                    best[at[open_[proven]]], gaps[at[open_[proven]]] = then[proven], gap[proven]
            proven = now <= np.maximum(gaps[at], TOLERANCE)
            best[at[proven]], gaps[at[proven]] = coef[proven], now[proven]
            passes = []
            moved = np.max(np.abs(coef - before), axis=1)
            goes_on = (gaps[at] > TOLERANCE) | (~(moved < SETTLED) & (i + 1 < ENOUGH_PASSES))
            if not goes_on.any():
                break
            if not goes_on.all():
                m, real, coef, sigma, n, totals, pull_weight, at = (v[goes_on] for v in (m, real, coef, sigma, n, totals, pull_weight, at))
                flat = tuple(v[goes_on] for v in flat)
    return best, gaps


def iterate_locally(m: np.ndarray, spec: dict, columns: list[str], std: float) -> tuple[np.ndarray, float]:
    """Coefficients of the rows of one series, and the proven gap of their mean loss."""
    coefs, gaps = iterate_side_by_side(m[None], np.ones((1, len(m)), dtype=bool), spec, columns, np.array([std]))
    return coefs[0], float(gaps[0])


def whole_series(batches, rows: int = STACK_ROWS):
    """Batches of rows sorted by series, cut anew so that none ends inside a series."""
    held, n = [], 0
    for pdf in batches:
        held, n = [*held, pdf], n + len(pdf)
        if n >= rows:
            joined = pd.concat(held, ignore_index=True)
            last = int(group_starts(joined[SERIES])[-1])
            if last:
                yield joined.iloc[:last]
            held, n = [joined.iloc[last:]], len(joined) - last
    if n:
        yield pd.concat(held, ignore_index=True)


def _in_fit(pdf: pd.DataFrame, spec: dict) -> np.ndarray:
    return (pdf["rn"] < pdf[spec["upto"]]).to_numpy() if spec["upto"] else np.ones(len(pdf), dtype=bool)


COEF_SCHEMA = f"{SERIES} string, variation int, y_mean double, y_std double, coef array<double>, gap double"


def fit_reweighted(train: DataFrame, specs: list[dict], columns: list[str]) -> DataFrame:
    """Coefficients per series and spec for Huber and quantile losses, with the ``gap``: a proven bound on how
    far their mean loss, in deviations of y, lies above the least one. A fit has converged if that is TOLERANCE
    or less; one that has not within the passes allowed is the best found.

    ``train`` is standardised; a spec's ``upto`` names a column that ends its rows (for folds).
    """
    specs = [with_defaults(s) for s in specs]
    if one_row_per_date(train):

        def run(batches):
            for pdf in whole_series(batches):
                m, keys, stds = matrix(pdf), pdf[[SERIES, "y_mean", "y_std"]].to_numpy(), pdf["y_std"].to_numpy(dtype=float)
                for i, s in enumerate(specs):
                    fitted = np.flatnonzero(_in_fit(pdf, s))
                    starts, held = group_starts(keys[fitted, 0]), np.append(m[fitted], np.zeros((1, m.shape[1])), axis=0)
                    for own, places in stacks(starts, len(fitted)):
                        real, first = places < len(fitted), fitted[starts[own]]
                        some = real.sum(axis=1) > 1
                        if some.any():
                            coefs, gaps = iterate_side_by_side(held[places[some]], real[some], s, columns, stds[first[some]])
                            out = pd.DataFrame(keys[first[some]], columns=[SERIES, "y_mean", "y_std"])
                            yield out.assign(variation=i, coef=coefs.tolist(), gap=gaps)[[SERIES, "variation", "y_mean", "y_std", "coef", "gap"]]

        return spread(train, SERIES).sortWithinPartitions(SERIES).mapInPandas(run, COEF_SCHEMA)
    return _fit_by_passes(train, specs, columns)


def _fit_by_passes(train: DataFrame, specs: list[dict], columns: list[str]) -> DataFrame:
    """Re-weighting as Spark jobs: a pass adds up the sums of all specs per series, the small solves
    follow per series, and the state between passes (a few numbers per series) is written out.

    A pass also adds up the bound for the coefficients that the pass before led to; the best proven ones are kept.
    """
    keys, k, n_specs = [SERIES, "y_mean", "y_std"], len(columns) + 1, len(specs)
    ends = {s["upto"] for s in specs if s["upto"]}
    train = train.select(*keys, "rn", "x", "z", *ends).persist()
    width = (k + 1) ** 2 + k + 3  # of a spec's weighted sums; its k + 4 sums for the bound follow

    def start_sums(pdf):
        m = matrix(pdf)
        return np.concatenate([cross_products(m[_in_fit(pdf, s)]) for s in specs])

    def start(row):
        for s, sums in zip(specs, np.split(np.asarray(row.gram, dtype=float), n_specs)):
            gram = square(sums, k + 1)
            coef = ridge(gram, used_columns(s, columns), 0.0, raw_weight(columns, row.y_std))
            errors = np.append(-coef, 1.0)
            sigma = float(np.sqrt(max(errors @ gram @ errors, 0.0) / gram[0, 0])) or 1.0
            yield coef, sigma, coef, sigma, coef, np.inf, np.inf

    def table(values):
        return np.asarray(values, dtype=float).reshape(n_specs, k)

    def pass_sums(i):
        def payload(pdf):
            m, first = matrix(pdf), pdf.iloc[0]
            states = zip(specs, table(first["coefs"]), first["sigmas"], table(first["old_coefs"]), first["old_sigmas"])
            sums, peaks = [], []
            for s, coef, sigma, old, old_sigma in states:
                part = m[_in_fit(pdf, s)]
                bound, peak = dual_sums(part, coef, sigma, (old, old_sigma, smoothing(i - 1)), s)
                sums += [weighted_sums(part, coef, sigma, smoothing(i), s), bound]
                peaks.append(peak)
            return np.concatenate([*sums, peaks])

        return payload

    def advance(i):
        def step(row):
            weight, flat = raw_weight(columns, row.y_std), np.asarray(row.gram, dtype=float)
            states = zip(specs, np.split(flat[:-n_specs], n_specs), flat[-n_specs:], table(row.coefs), row.sigmas, table(row.best), row.gaps)
            for s, sums, peak, coef, sigma, best, gap in states:
                use = used_columns(s, columns)
                weighted, bound = sums[:width], sums[width:]
                now = proven_gap(bound, peak, weighted[-3], coef, s, use, weight, row.y_std) if i else np.inf
                if now <= max(gap, TOLERANCE):
                    best, gap = coef, now
                new, new_sigma = reweighted_step(weighted, s, use, weight, row.y_std, coef, sigma)
                yield new, max(new_sigma, smoothing(i)), coef, sigma, best, gap, np.max(np.abs(new - coef))

        return step

    named = ["coefs", "sigmas", "old_coefs", "old_sigmas", "best", "gaps", "moves"]

    def solved(sums, step):
        def run(batches):
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    parts = list(zip(*step(row)))
                    out.append((row.series_id, row.y_mean, row.y_std, *[np.hstack(p).astype(float).tolist() for p in parts]))
                yield pd.DataFrame(out, columns=[*keys, *named])

        schema = f"{SERIES} string, y_mean double, y_std double, " + ", ".join(f"{c} array<double>" for c in named)
        return cut_lineage(sums.mapInPandas(run, schema))

    state = solved(partial_sums(train, keys, start_sums), start)
    for i in range(MAX_JOBS):
        last = state.select(SERIES, *named)
        sums = partial_sums(train.join(last.drop("best", "gaps", "moves"), SERIES), keys, pass_sums(i), peaks=n_specs)
        state = solved(sums.join(last, SERIES), advance(i))
        # Looking at the largest gap is a job of its own, so not after every pass.
        if i and i % 5 == 0:
            gap, move = state.agg(F.max(F.array_max("gaps")), F.max(F.array_max("moves"))).first()
            if (gap or 0.0) <= TOLERANCE and (i >= ENOUGH_PASSES or (move or 0.0) < SETTLED):
                break
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(n_specs - 1)),
        lambda v: F.struct(v.alias("variation"), F.slice("best", v * k + 1, F.lit(k)).alias("coef"), F.get("gaps", v).alias("gap")),
    )
    train.unpersist()
    return state.select(*keys, F.explode(pieces).alias("_p")).select(
        SERIES, "_p.variation", "y_mean", "y_std", "_p.coef", "_p.gap"
    )


def fit_closed(train: DataFrame, specs: list[dict], columns: list[str]) -> DataFrame:
    """Coefficients per series and spec for squared loss and lasso: one pass over the rows."""
    keys = [SERIES, "y_mean", "y_std"]
    grams = partial_sums(train.select(*keys, "x", "z"), keys, lambda pdf: cross_products(matrix(pdf)))
    width = len(columns) + 2

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            stacked = [square(g, width) for g in pdf["gram"]]
            for i, s in enumerate(specs):
                coef = solve_closed(stacked, s, columns, pdf["y_std"].to_numpy())
                rows = pdf[keys].assign(variation=i, coef=coef.tolist(), gap=0.0)
                yield rows[[SERIES, "variation", "y_mean", "y_std", "coef", "gap"]]

    return spread(grams, SERIES).mapInPandas(run, COEF_SCHEMA)


def fit_linear(split: DataFrame, specs: list[dict], columns: list[str] | None = None) -> DataFrame:
    """(series_id, variation, y_mean, y_std, coef, gap) for any mix of losses; coef[0] is the constant.

    ``gap`` bounds the mean loss above the least one (see fit_reweighted); solved systems have none.
    """
    columns = columns or feature_names()
    train = standardised(split, columns).where("is_train")
    closed = [i for i, s in enumerate(specs) if s["loss"] in ("l2", "l1")]
    weighted = [i for i, s in enumerate(specs) if s["loss"] in ("huber", "quantile")]
    if len(closed) + len(weighted) != len(specs):
        raise ValueError(f"losses must be among l1, l2, huber, quantile: {specs}")
    parts = []
    for chosen, fit in ((closed, fit_closed), (weighted, fit_reweighted)):
        if chosen:
            own = F.element_at(F.array(*[F.lit(i) for i in chosen]), F.col("variation") + 1)
            parts.append(fit(train, [specs[i] for i in chosen], columns).withColumn("variation", own))
    return reduce(DataFrame.unionByName, parts)


def predict_linear(split: DataFrame, fits: DataFrame, columns: list[str] | None = None, where: str = "not is_train") -> DataFrame:
    """One-step forecasts: the features of a row hold the true values before it."""
    columns = columns or feature_names()
    rows = in_units(split.where(where).join(fits, SERIES), columns, "variation", "coef")
    dot = F.col("coef")[0] + reduce(
        lambda a, b: a + b, [F.col("coef")[i + 1] * F.col("x")[i] for i in range(len(columns))]
    )
    return forecast_rows(rows, "lr", F.col("y_mean") + F.col("y_std") * dot, ONE_STEP)


def forecast_linear(split: DataFrame, specs: list[dict] | None = None, columns: list[str] | None = None) -> DataFrame:
    return predict_linear(split, fit_linear(split, specs or VARIATIONS, columns), columns)


def linear_candidates(split: DataFrame, loss: str = "l2", grid: list[dict] | None = None, n_splits: int = 3,
                      columns: list[str] | None = None) -> DataFrame:
    """RMSE of every candidate on every expanding fold: (series_id, candidate_no, params, fold, rmse)."""
    columns = columns or feature_names()
    grid = grid or GRIDS[loss]
    train = standardised(split, columns).where(F.col("is_train") & (F.col("n_train") > n_splits))
    if loss in ("l2", "l1"):
        return _folds_from_segments(train, loss, grid, n_splits, columns)
    return _folds_by_fitting(train, loss, grid, n_splits, columns)


def _folds_from_segments(train, loss, grid, n_splits, columns):
    """Rows are cut into one segment before the first validation slice and one per slice. The cross
    products of a fold's training rows are the sum of the earlier segments, and those of its slice
    give the validation error, so every candidate and fold comes from one pass."""
    passed = [F.when(F.col("rn") >= fold_start(F.lit(i), n_splits), 1).otherwise(0) for i in range(n_splits)]
    segmented = train.withColumn("segment", reduce(lambda a, b: a + b, passed))
    keys = [SERIES, "y_std", "segment"]
    grams = partial_sums(segmented.select(*keys, "x", "z"), keys, lambda pdf: cross_products(matrix(pdf)))
    by_series = grams.groupBy(SERIES, "y_std").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment", "gram"))), lambda s: s["gram"]).alias("grams")
    )
    width = len(columns) + 2

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            segments = [[square(g, width) for g in row] for row in pdf["grams"]]
            stds, series = pdf["y_std"].to_numpy(), len(pdf)
            fit = [sum(parts[: fold + 1]) for fold in range(n_splits) for parts in segments]
            held = np.stack([parts[fold + 1] for fold in range(n_splits) for parts in segments])
            for c, params in enumerate(grid):
                coefs = solve_closed(fit, {"loss": loss, **params}, columns, np.tile(stds, n_splits))
                ends = np.column_stack([-coefs, np.ones(len(fit))])
                sse = np.maximum(np.einsum("pi,pij,pj->p", ends, held, ends), 0.0)
                yield pd.DataFrame(
                    {
                        SERIES: np.tile(pdf[SERIES].to_numpy(), n_splits), "candidate_no": c, "params": json.dumps(params),
                        "fold": np.repeat(np.arange(n_splits), series),
                        "rmse": np.tile(stds, n_splits) * np.sqrt(sse / held[:, 0, 0]),
                    }
                )

    schema = f"{SERIES} string, candidate_no int, params string, fold int, rmse double"
    return spread(by_series, SERIES).mapInPandas(run, schema)


def _folds_by_fitting(train, loss, grid, n_splits, columns):
    starts = {f"_start_{f}": fold_start(F.lit(f), n_splits) for f in range(n_splits)}
    train = train.withColumns(starts)
    specs = [{"loss": loss, **params, "upto": f"_start_{f}"} for f in range(n_splits) for params in grid]
    fits = fit_reweighted(train, specs, columns)
    number, size = len(grid), F.expr(f"n_train div {n_splits + 1}")
    fits = fits.withColumns(
        {"fold": F.expr(f"variation div {number}").cast("int"), "candidate_no": F.col("variation") % number}
    )
    start = fold_start(F.col("fold"), n_splits)
    rows = train.drop("y_mean").join(fits.drop("y_std"), SERIES).where((F.col("rn") >= start) & (F.col("rn") < start + size))
    dot = F.col("coef")[0] + reduce(lambda a, b: a + b, [F.col("coef")[i + 1] * F.col("x")[i] for i in range(len(columns))])
    err = F.col("y_std") * (F.col("z") - dot)
    names = F.array(*[F.lit(json.dumps(p)) for p in grid])
    return (
        rows.groupBy(SERIES, "candidate_no", "fold")
        .agg(F.sqrt(F.avg(err * err)).alias("rmse"))
        .select(SERIES, "candidate_no", names[F.col("candidate_no")].alias("params"), "fold", "rmse")
    )


def tune_linear(split: DataFrame, loss: str = "l2", grid: list[dict] | None = None, n_splits: int = 3,
                columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates with mean RMSE over the folds, forecasts of the best refitted on all train rows)."""
    grid = grid or GRIDS[loss]
    per_fold = linear_candidates(split, loss, grid, n_splits, columns)
    candidates = mark_chosen(
        per_fold.groupBy(SERIES, "candidate_no", "params").agg(
            F.avg("rmse").alias("rmse"),
            F.transform(F.array_sort(F.collect_list(F.struct("fold", "rmse"))), lambda s: s["rmse"]).alias("fold_scores"),
        ).withColumn("model_key", F.lit("lr")),
        [SERIES],
    )
    best = best_candidate(candidates, [SERIES]).select(SERIES, F.col("candidate_no").alias("variation"), "params")
    fits = fit_linear(split, [{"loss": loss, **p} for p in grid], columns)
    forecasts = predict_linear(split, fits.join(best.select(SERIES, "variation"), [SERIES, "variation"]), columns)
    return candidates, forecasts.join(best.select(SERIES, "params"), SERIES).withColumn("variation", F.lit(0))


__all__ = [
    "GRIDS", "VARIATIONS", "fit_linear", "forecast_linear", "linear_candidates", "predict_linear", "tune_linear",
]
