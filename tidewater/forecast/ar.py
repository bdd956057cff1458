"""Autoregression with differencing and moving-average terms, plain and seasonal, by least squares.

A fit is reduced to one linear recursion on the (standardised) series, whatever its differences, so
that one rollout serves all orders. Orders with moving-average terms take two regressions: a long
autoregression, solved from sums, gives every row its residual; then the differenced series is regressed
on its lags and on lags of those residuals, which again needs sums only. A series of dates is fitted in the
task that holds its rows. For series of timestamps each regression is one pass over the rows for all orders
together, and the lags come from windows over blocks of neighbouring rows.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.common import forecast_rows, test_rows, train_scale
from tidewater.forecast.gram import cross_products_of, group_starts, solve_many, stacked_sums, stacks
from tidewater.forecast.linear import whole_series
from tidewater.forecast.rollout import recursive_rollout
from tidewater.operators.positions import SERIES, TS, Y, one_row_per_date, over_neighbours
from tidewater.operators.ranking import best_candidate, mark_chosen
from tidewater.operators.splits import period_for_training
from tidewater.session import spread

PERIODS = (4, 12, 52)


# Lags of the long autoregression behind the residuals, the first that leaves enough rows: this many rows a term.
LONG_LAGS, LONG_ROWS = (12, 4), 3


def order(p: int, d: int, P: int = 0, D: int = 0, q: int = 0, Q: int = 0) -> dict:
    return {"p": p, "d": d, "P": P, "D": D, "q": q, "Q": Q}


# The variations' orders without their moving-average terms.
PLAIN = [order(1, 0), order(1, 1), order(2, 1)]
SEASONAL = [order(1, 1, 0, 1), order(1, 1, 1, 1), order(2, 1, 0, 1)]


def polynomials(spec: dict, period: int, phi: np.ndarray, seasonal_phi: np.ndarray) -> np.ndarray:
    """Coefficients of y_(t-1), y_(t-2), ... in the recursions of a fitted order, one a line."""
    poly = np.zeros((len(phi), 1 + max(spec["p"], spec["P"] * period)))
    poly[:, 0] = 1.0
    poly[:, 1 : 1 + spec["p"]] -= phi
    if spec["P"]:
        poly[:, period] -= seasonal_phi[:, 0]
    for lag in [1] * spec["d"] + [period] * spec["D"]:
        longer = np.pad(poly, ((0, 0), (0, lag)))
        longer[:, lag:] -= poly
        poly = longer
    return -poly[:, 1:]


def reach(spec: dict, period: int) -> int:
    return max(spec["p"], spec["P"] * period) + spec["d"] + spec["D"] * period


def needed_lags(specs: list[dict], period: int) -> list[int]:
    """Lags of y that the difference polynomials of all specs touch."""
    lags = set()
    for s in specs:
        base = {0}
        for _ in range(s["d"]):
            base |= {b + 1 for b in base}
        for _ in range(s["D"]):
            base |= {b + period for b in base}
        shifts = [0, *range(1, s["p"] + 1), *([period] if s["P"] else [])]
        lags |= {b + k for b in base for k in shifts}
    return sorted(lags)


def difference(values: dict[int, np.ndarray], spec: dict, period: int, shift: int) -> np.ndarray:
    """The differenced series, ``shift`` rows back, from raw lags."""
    weights = {0: 1.0}
    for step in [1] * spec["d"] + [period] * spec["D"]:
        for lag, w in list(weights.items()):
            weights[lag + step] = weights.get(lag + step, 0.0) - w
    return sum(w * values[lag + shift] for lag, w in weights.items())


def design(values: dict[int, np.ndarray], spec: dict, period: int) -> np.ndarray:
    """[1, AR lags, seasonal lag, target] of one order."""
    shifts = [*range(1, spec["p"] + 1), *([period] if spec["P"] else []), 0]
    columns = [difference(values, spec, period, k) for k in shifts]
    return np.column_stack([np.ones(len(columns[0])), *columns])


def solve(grams: np.ndarray, spec: dict, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fits of many series that have enough rows: (their numbers, intercepts, recursion coefficients, weights of the
    residuals 1, 2, ... rows back); a constant is fitted only where nothing is differenced."""
    n_ar, n_ma = spec["p"] + spec["P"], spec["q"] + spec["Q"]
    k = n_ar + n_ma
    fitted = np.flatnonzero(grams[:, 0, 0] >= k + 1)
    grams = grams[fitted]
    coef, intercept = np.zeros((len(fitted), k)), np.zeros(len(fitted))
    if spec["d"] + spec["D"] == 0:
        n = grams[:, 0, :1]
        means = grams[:, 0, 1:] / n
        c = grams[:, 1:, 1:] - n[..., None] * (means[:, :, None] * means[:, None, :])
        if k and len(fitted):
            coef = solve_many(c[:, :k, :k], c[:, :k, k])
        intercept = means[:, k] - np.sum(coef * means[:, :k], axis=1)
    elif k and len(fitted):
        coef = solve_many(grams[:, 1 : k + 1, 1 : k + 1], grams[:, 1 : k + 1, k + 1])
    theta = np.zeros((len(fitted), max(spec["q"], spec["Q"] * period)))
    theta[:, : spec["q"]] = coef[:, n_ar : n_ar + spec["q"]]
    if spec["Q"]:
        theta[:, period - 1] += coef[:, -1]
    return fitted, intercept, polynomials(spec, period, coef[:, : spec["p"]], coef[:, spec["p"] : n_ar]), theta


def with_period(split: DataFrame, period: int | None) -> DataFrame:
    if "period" in split.columns:
        return split
    chosen = F.lit(period) if period else period_for_training()
    return split.withColumn("period", chosen.cast("int"))


def moving(specs: list[dict]) -> list[dict]:
    """The orders that have moving-average terms."""
    return [s for s in specs if s["q"] or s["Q"]]


def long_orders(specs: list[dict], long: tuple = LONG_LAGS) -> dict[tuple, list[dict]]:
    """Per pair of differences in use, the autoregressions to try for its residuals, longest first."""
    out = {}
    for s in moving(specs):
        seasonal = any(x["P"] or x["D"] or x["Q"] for x in moving(specs))
        tries = [order(long[0], s["d"], 1, s["D"])] if seasonal else []
        out[s["d"], s["D"]] = tries + [order(k, s["d"], 0, s["D"]) for k in long]
    return out


def is_seasonal(specs: list[dict]) -> bool:
    return any(s["P"] or s["D"] or s["Q"] for s in specs)


def lags_by_period(specs: list[dict], period: int | None) -> dict[int, list[int]]:
    periods = [period] if period else list(PERIODS)
    return {m: needed_lags(specs, m) for m in (periods if is_seasonal(specs) else [1])}


def _by_period(by_period: dict[int, list], make):
    """``make(list)`` of the row's period; of the only list where the orders have no season."""
    if list(by_period) == [1]:
        return make(by_period[1])
    pick = F
    for m, items in by_period.items():
        pick = pick.when(F.col("period") == m, make(items))
    return pick


def lag_rows(split: DataFrame, specs: list[dict], period: int | None) -> DataFrame:
    """Training rows with the raw lags the orders need, as one array (lags differ by period)."""
    by_period = lags_by_period(specs, period)
    train = with_period(split, period).where("is_train").join(train_scale(split), SERIES)
    z = train.select(
        SERIES, TS, "rn", "n_train", "period", "y_mean", "y_std", ((F.col(Y) - F.col("y_mean")) / F.col("y_std")).alias(Y)
    )

    def build(rows, w):
        return rows.withColumn("lags", _by_period(by_period, lambda lags: F.array(*[F.lag(Y, k).over(w) if k else F.col(Y) for k in lags])))

    return over_neighbours(z, build, behind=max(max(lags) for lags in by_period.values()))


def _values(arrays: pd.Series, lags: list[int]) -> dict[int, np.ndarray]:
    return dict(zip(lags, np.array(arrays.tolist(), dtype=float).T))


def _lags_of(specs: list[dict], period: int) -> list[int]:
    return needed_lags(specs, period if is_seasonal(specs) else 1)


def gram_widths(specs: list[dict]) -> list[int]:
    return [2 + s["p"] + s["P"] + s["q"] + s["Q"] for s in specs]


def error_shifts(specs: list[dict], period: int) -> list[int]:
    """How far back the moving-average terms reach, one entry per lag of the residuals."""
    deepest = max([s["q"] for s in specs], default=0)
    return [*range(1, deepest + 1), *([period] if any(s["Q"] for s in specs) else [])]


def with_errors(design_: np.ndarray, errors: dict[int, np.ndarray], spec: dict, period: int) -> np.ndarray:
    """The design with the lagged residuals of an order before its target."""
    shifts = [*range(1, spec["q"] + 1), *([period] if spec["Q"] else [])]
    return np.column_stack([design_[:, :-1], *[errors[k] for k in shifts], design_[:, -1]])


KEYS = [SERIES, "period", "y_mean", "y_std"]


def ar_grams(rows: DataFrame, specs: list[dict], known: list[dict] | None = None, families: list[tuple] = ()) -> DataFrame:
    """One row per series: the flattened cross products of every order, end to end.

    ``known`` are the orders that the array of lags was made for, ``families`` the pairs of differences whose
    lagged residuals stand end to end in ``errors``.
    """
    known = known or specs

    widths = gram_widths(specs)

    def of_period(pdf, starts, period):
        values, lines = _values(pdf["lags"], _lags_of(known, period)), list(stacks(starts, len(pdf)))
        out, errors = [], {}
        if families:
            shifts = error_shifts(specs, period)
            stacked = np.array(pdf["errors"].tolist(), dtype=float).T.reshape(len(families), len(shifts), -1)
            errors = {f: dict(zip(shifts, stacked[i])) for i, f in enumerate(families)}
        for s in specs:
            x = design(values, s, period)
            x = with_errors(x, errors[s["d"], s["D"]], s, period) if s["q"] or s["Q"] else x
            out.append(cross_products_of(x, lines, len(starts)))
        return np.concatenate(out, axis=1)

    def payload(pdf, starts):
        sizes, periods = np.diff(np.append(starts, len(pdf))), pdf["period"].to_numpy()
        out = np.empty((len(starts), sum(w * w for w in widths)))
        for period in np.unique(periods):
            own = np.flatnonzero(periods[starts] == period)
            out[own] = of_period(pdf[periods == period], np.cumsum(sizes[own]) - sizes[own], int(period))
        return out

    return stacked_sums(rows.select(*KEYS, "lags", *(["errors"] if families else [])), KEYS, payload)


def grams_by_period(pdf: pd.DataFrame, widths: list[int]):
    """(period, rows of the batch that have it, the cross products of every order as a stack)."""
    for period, own in pdf.groupby("period"):
        flat, ends = np.array(own["gram"].tolist(), dtype=float), np.cumsum([w * w for w in widths])
        yield int(period), own, [g.reshape(len(own), w, w) for g, w in zip(np.split(flat, ends[:-1], axis=1), widths)]


def filters_of(stacked: list[np.ndarray], tries: dict[tuple, list[dict]], known: list[dict], period: int) -> list[list]:
    """The filters of many series of one period, from the cross products of all autoregressions to try."""
    lags, filters = _lags_of(known, period), [[None] * len(tries) for _ in range(len(stacked[0]))]
    places = {family: i for i, family in enumerate(tries)}
    for s, g in zip([s for specs in tries.values() for s in specs], stacked):
        fitted, constant, recursion, _ = solve(g, s, period)
        # lags that this autoregression doesn't use weigh nothing
        used = [np.zeros(len(fitted)) if k > recursion.shape[1] else -recursion[:, k - 1] for k in lags[1:]]
        weights = np.column_stack([np.ones(len(fitted)), *used, constant])
        for at, line in zip(fitted, weights.tolist()):
            family = places[s["d"], s["D"]]
            if filters[at][family] is None and g[at, 0, 0] >= LONG_ROWS * (s["p"] + s["P"] + 1):
                filters[at][family] = line
    return filters


def residual_filters(grams: DataFrame, tries: dict[tuple, list[dict]], known: list[dict]) -> DataFrame:
    """(series_id, filters): per pair of differences the weights of the raw lags and a constant that make the
    residual of the longest autoregression the series has rows for; null where it has too few."""
    widths = gram_widths([s for specs in tries.values() for s in specs])

    def run(batches):
        for pdf in batches:
            for period, own, stacked in grams_by_period(pdf, widths):
                yield pd.DataFrame({SERIES: own[SERIES].to_numpy(), "filters": filters_of(stacked, tries, known, period)})

    return spread(grams, SERIES).mapInPandas(run, f"{SERIES} string, filters array<array<double>>")


def error_rows(rows: DataFrame, filters: DataFrame, specs: list[dict], families: list[tuple], period: int | None) -> DataFrame:
    """``rows`` with ``residuals`` (one per pair of differences) and their lags in ``errors``.

    Residuals of the first rows, which lack lags, count as zero, their expected value.
    """
    joined = rows.join(filters, SERIES)

    def residual(i):
        weights = F.col("filters")[i]
        # a weight of zero belongs to a lag that this autoregression doesn't use: it may be missing
        terms = F.zip_with("lags", F.slice(weights, 1, F.size("lags")), lambda v, w: F.when(w == 0, 0.0).otherwise(v * w))
        return F.when(weights.isNotNull(), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) - F.element_at(weights, -1))

    made = joined.withColumn("residuals", F.array(*[residual(i) for i in range(len(families))]))
    periods = [period] if period else list(PERIODS)
    shifts = {m: error_shifts(specs, m) for m in (periods if any(s["Q"] for s in specs) else [1])}

    def build(part, w):
        def lagged(own):
            return F.array(*[
                F.when(F.col("filters")[i].isNotNull(), F.coalesce(F.lag(F.col("residuals")[i], k).over(w), F.lit(0.0)))
                for i in range(len(families)) for k in own
            ])

        return part.withColumn("errors", _by_period(shifts, lagged))

    return over_neighbours(made, build, behind=max(max(x) for x in shifts.values())).drop("filters")


def last_values(rows: DataFrame, depth: int, upto: str, column: str = Y, name: str = "state") -> DataFrame:
    """The ``depth`` values before position ``upto``, newest first."""
    tail = rows.where((F.col("rn") < F.col(upto)) & (F.col("rn") >= F.col(upto) - depth))
    newest = F.sort_array(F.collect_list(F.struct("rn", column)), asc=False)
    return tail.groupBy(SERIES).agg(F.transform(newest, lambda s: s[column]).alias(name))


def fit_ar(split: DataFrame, specs: list[dict], period: int | None = None, long: tuple = LONG_LAGS) -> DataFrame:
    """(series_id, variation, intercept, coef, state, theta, shocks) of every order that the series is long enough for.

    ``theta`` weighs the residuals 1, 2, ... rows back, ``shocks`` holds the last ones, newest first.
    """
    depth = max(reach(s, m) for s in specs for m in ([period] if period else PERIODS))
    tries = long_orders(specs, long)
    families = list(tries)
    known = [*specs, *[s for own in tries.values() for s in own]]
    if one_row_per_date(split):
        return _fit_whole_series(split, specs, known, tries, period, depth)
    state = last_values(split.where("is_train"), depth, "n_train")
    rows = lag_rows(split, known, period)
    if families:
        filters = residual_filters(ar_grams(rows, [s for own in tries.values() for s in own], known), tries, known)
        rows = error_rows(rows, filters, specs, families, period)
        shown = max(max(error_shifts(specs, m)) for m in ([period] if period else PERIODS))
        state = state.join(last_values(rows, shown, "n_train", "residuals", "shocks"), SERIES, "left")
    else:
        state = state.withColumn("shocks", F.lit(None).cast("array<array<double>>"))
    grams = ar_grams(rows, specs, known, families).join(state, SERIES)
    widths = gram_widths(specs)

    def run(batches):
        for pdf in batches:
            for period, own, stacked in grams_by_period(pdf, widths):
                yield from fits_of(stacked, specs, families, period, *(own[c].to_numpy() for c in (SERIES, "y_mean", "y_std", "state", "shocks")))

    return spread(grams, SERIES).mapInPandas(run, FIT_SCHEMA)


FIT_SCHEMA = f"{SERIES} string, variation int, intercept double, coef array<double>, state array<double>, theta array<double>, shocks array<double>"


def fits_of(stacked: list[np.ndarray], specs: list[dict], families: list[tuple], period: int, series, means, stds, states, shocks):
    """The fits of many series of one period, a frame per order, from the cross products of all orders."""
    known_values = np.array([len(x) for x in states])
    late_errors = [s * np.nan_to_num(np.array([list(e) for e in x], dtype=float)) for s, x in zip(stds, shocks)] if families else []
    for i, (g, s) in enumerate(zip(stacked, specs)):
        fitted, intercept, coef, theta = solve(g, s, period)
        enough = known_values[fitted] >= reach(s, period)
        fitted, intercept, coef, theta = (x[enough] for x in (fitted, intercept, coef, theta))
        if not len(fitted):
            continue
        if s["d"] + s["D"] == 0:
            intercept = stds[fitted] * intercept + means[fitted] * (1.0 - coef.sum(axis=1))
        late = [[]] * len(fitted)
        if theta.shape[1]:
            at = families.index((s["d"], s["D"]))
            late = [late_errors[j][: theta.shape[1], at].tolist() for j in fitted]
        made = {"coef": coef.tolist(), "state": [states[j] for j in fitted], "theta": theta.tolist(), "shocks": late}
        yield pd.DataFrame({SERIES: series[fitted], "variation": i, "intercept": intercept, **made})


def _fit_whole_series(split: DataFrame, specs: list[dict], known: list[dict], tries: dict[tuple, list[dict]], period: int | None, depth: int) -> DataFrame:
    """:func:`fit_ar` for series of dates, which the calendar bounds: the rows of a series meet in one task, once, and all
    regressions follow there. Lags are shifts of whole columns, and many series are worked on side by side."""
    families, long = list(tries), [s for own in tries.values() for s in own]
    shown = max([k for m in ([period] if period else PERIODS) for k in error_shifts(specs, m)], default=0)
    z = (F.col(Y) - F.col("y_mean")) / F.col("y_std")
    train = with_period(split, period).where("is_train").join(train_scale(split), SERIES).select(*KEYS, "rn", Y, z.alias("z"))

    def newest(values, starts, sizes, count):
        return [values[a : a + n][::-1][:count] for a, n in zip(starts, sizes)]

    def of_period(pdf, starts, period):
        n = len(pdf)
        sizes = np.diff(np.append(starts, n))
        owner, lines = np.repeat(np.arange(len(starts)), sizes), list(stacks(starts, n))
        place = np.arange(n) - starts[owner]

        def shifted(values, k):
            out = np.full(n, np.nan)
            out[k:] = values[: max(n - k, 0)]
            out[place < k] = np.nan
            return out

        def summed_up(x, width):
            return cross_products_of(x, lines, len(starts)).reshape(-1, width, width)

        target, lags = pdf["z"].to_numpy(dtype=float), _lags_of(known, period)
        values = {k: shifted(target, k) for k in lags}
        errors, shocks = {}, None
        if families:
            filters, kept = filters_of([summed_up(design(values, s, period), w) for s, w in zip(long, gram_widths(long))], tries, known, period), []
            for i, family in enumerate(families):
                has = np.array([f[i] is not None for f in filters])
                weights = np.array([f[i] or [0.0] * (len(lags) + 1) for f in filters])[owner].T
                # a weight of zero belongs to a lag that this autoregression doesn't use: it may be missing
                residual = sum(np.where(w == 0, 0.0, values[k] * w) for k, w in zip(lags, weights)) - weights[-1]
                residual[~has[owner]] = np.nan
                kept.append(residual)
                errors[family] = {k: np.where(has[owner], np.nan_to_num(shifted(residual, k)), np.nan) for k in error_shifts(specs, period)}
            shocks = newest(np.column_stack(kept), starts, sizes, shown)
        stacked = []
        for s, width in zip(specs, gram_widths(specs)):
            x = design(values, s, period)
            stacked.append(summed_up(with_errors(x, errors[s["d"], s["D"]], s, period) if s["q"] or s["Q"] else x, width))
        firsts = [pdf[c].to_numpy()[starts] for c in (SERIES, "y_mean", "y_std")]
        yield from fits_of(stacked, specs, families, period, *firsts, newest(pdf[Y].to_numpy(dtype=float), starts, sizes, depth), shocks)

    def run(batches):
        for pdf in whole_series(batches):
            starts, periods = group_starts(pdf[SERIES].to_numpy()), pdf["period"].to_numpy()
            sizes = np.diff(np.append(starts, len(pdf)))
            for period in np.unique(periods):
                own = sizes[periods[starts] == period]
                yield from of_period(pdf[periods == period], np.cumsum(own) - own, int(period))

    return spread(train, SERIES).sortWithinPartitions(SERIES, "rn").mapInPandas(run, FIT_SCHEMA)


def forecast_fits(split: DataFrame, fits: DataFrame, model_key: str) -> DataFrame:
    """Roll fitted recursions out over the test rows."""
    horizon = split.where(~F.col("is_train")).groupBy(SERIES).agg(F.count(F.lit(1)).alias("horizon"))
    rolled = recursive_rollout(fits.join(horizon, SERIES), [SERIES, "variation"])
    rows = test_rows(split).withColumn("step", F.col("rn") - F.col("n_train") + 1)
    return forecast_rows(rows.join(rolled, [SERIES, "step"]), model_key, F.col("yhat"))


def forecast_ar(split: DataFrame, specs: list[dict] | None = None, long: tuple = LONG_LAGS) -> DataFrame:
    return forecast_fits(split, fit_ar(split, specs or PLAIN, None, long), "arima")


def forecast_seasonal_ar(split: DataFrame, specs: list[dict] | None = None, period: int | None = None) -> DataFrame:
    return forecast_fits(split, fit_ar(split, specs or SEASONAL, period), "sarima")


# The two grids, and their parts without moving-average terms.
GRID = [order(p, d, q=q) for p in range(5) for d in range(2) for q in range(5)]
SEASONAL_FULL_GRID = [
    order(p, d, P, D, q, Q) for p in range(3) for d in range(2) for q in range(3) for P in range(2) for D in range(2) for Q in range(2)
]
PLAIN_GRID = [order(p, d) for p in range(5) for d in range(2)]
SEASONAL_GRID = [order(p, d, P, D) for p in range(3) for d in range(2) for P in range(2) for D in range(2)]


def order_json(spec: dict, period: int, seasonal: bool) -> str:
    out = {"order": [spec["p"], spec["d"], spec["q"]]}
    if seasonal:
        out["seasonal_order"] = [spec["P"], spec["D"], spec["Q"], period]
    return json.dumps(out)


def ar_candidates(
    split: DataFrame, grid: list[dict], period: int | None = None, val_frac: float = 0.2, seasonal: bool = False
) -> DataFrame:
    """Holdout RMSE of every order. Rows are read once for all orders; each (series, order) then rolls
    its recursion over the holdout piece by piece."""
    val = F.least(F.greatest(F.lit(1), F.floor(F.col("n_train") * F.lit(val_frac))), F.col("n_train") - 1)
    fit_split = (
        with_period(split, period)
        .where("is_train")
        .withColumn("n_train", (F.col("n_train") - val).cast("bigint"))
        .withColumn("is_train", F.col("rn") < F.col("n_train"))
    )
    return score_orders(fit_split, grid, period, "sarima" if seasonal else "arima", seasonal)


def score_orders(fit_split: DataFrame, grid: list[dict], period: int | None, model_key: str, seasonal: bool) -> DataFrame:
    fits = fit_ar(fit_split, grid, period)
    forecasts = forecast_fits(fit_split, fits, model_key)
    err = F.col(Y) - F.col("yhat")
    scored = forecasts.groupBy(SERIES, "variation").agg(
        F.when(F.count("yhat") == F.count(Y), F.sqrt(F.avg(err * err))).alias("rmse")
    )
    periods = [period] if period else list(PERIODS)
    names = F.create_map(
        *[
            x
            for m in periods
            for i, s in enumerate(grid)
            for x in (F.lit(f"{m}/{i}"), F.lit(order_json(s, m, seasonal)))
        ]
    )
    by_series = with_period(fit_split, period).groupBy(SERIES).agg(F.any_value("period").alias("period"))
    named = scored.join(by_series, SERIES).select(
        SERIES,
        F.lit(model_key).alias("model_key"),
        F.col("variation").alias("candidate_no"),
        F.element_at(names, F.concat_ws("/", "period", "variation")).alias("params"),
        "rmse",
    )
    return mark_chosen(named, [SERIES])


def refit_chosen(split: DataFrame, candidates: DataFrame, grid: list[dict], period: int | None, model_key: str) -> DataFrame:
    """Fit every order on all training rows (one pass) and keep the chosen one per series."""
    best = best_candidate(candidates, [SERIES]).select(SERIES, F.col("candidate_no").alias("variation"), "params")
    fits = fit_ar(split, grid, period).join(best.select(SERIES, "variation"), [SERIES, "variation"])
    forecasts = forecast_fits(split, fits, model_key)
    return forecasts.join(best.select(SERIES, "params"), SERIES).withColumn("variation", F.lit(0))


def tune_ar(split: DataFrame, grid: list[dict] | None = None, val_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(candidates, forecasts of the best order refitted on all training rows)."""
    grid = grid or GRID
    candidates = ar_candidates(split, grid, None, val_frac)
    return candidates, refit_chosen(split, candidates, grid, None, "arima")


def tune_seasonal_ar(
    split: DataFrame, grid: list[dict] | None = None, period: int | None = None, val_frac: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    grid = grid or SEASONAL_FULL_GRID
    candidates = ar_candidates(split, grid, period, val_frac, seasonal=True)
    return candidates, refit_chosen(split, candidates, grid, period, "sarima")
