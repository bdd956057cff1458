"""Orders with moving-average terms against NumPy regressions on the whole series."""

import json

import numpy as np
import pytest
from conftest import by_series, panel_frame, series, stamped_frame

from tidewater.forecast import ar
from tidewater.forecast.rollout import roll
from tidewater.operators.splits import chrono_split
from tidewater.plans import sweep


def lagged(v, k):
    return np.concatenate([np.full(k, np.nan), v[: len(v) - k]]) if k else v


def regress(columns, target, constant):
    x = np.column_stack([*([np.ones(len(target))] if constant else []), *columns]) if columns or constant else np.zeros((len(target), 0))
    use = ~np.isnan(np.column_stack([x, target])).any(axis=1)
    return np.linalg.lstsq(x[use], target[use], rcond=None)[0], x, use


def plain_fit(y, spec, period, long=ar.LONG_LAGS):
    """Two regressions and the rollout, row by row."""
    w = y.astype(float)
    for step in [1] * spec["d"] + [period] * spec["D"]:
        w = w - lagged(w, step)
    constant = spec["d"] + spec["D"] == 0
    e = np.zeros(len(y))
    if spec["q"] or spec["Q"]:
        seasonal = spec["P"] or spec["D"] or spec["Q"]
        for lags in ([*range(1, long[0] + 1), period] if seasonal else None, *(range(1, k + 1) for k in long)):
            if lags is None:
                continue
            coef, x, use = regress([lagged(w, k) for k in lags], w, constant)
            if use.sum() >= ar.LONG_ROWS * (len(lags) + 1):
                break
        else:
            return None
        e = np.where(use, w - x @ coef, 0.0)
    past = [*range(1, spec["p"] + 1), *([period] if spec["P"] else [])]
    shifts = [*range(1, spec["q"] + 1), *([period] if spec["Q"] else [])]
    errors = [np.nan_to_num(lagged(e, k)) for k in shifts]
    coef, _, use = regress([*[lagged(w, k) for k in past], *errors], w, constant)
    return coef, e, w, past, shifts, constant


def plain_forecast(y, spec, period, steps):
    coef, e, w, past, shifts, constant = plain_fit(y, spec, period)
    c, b = (coef[0], coef[1:]) if constant else (0.0, coef)
    ys, ws, es = list(y), list(w), list(e)
    weights = {0: 1.0}
    for step in [1] * spec["d"] + [period] * spec["D"]:
        for lag, v in list(weights.items()):
            weights[lag + step] = weights.get(lag + step, 0.0) - v
    for _ in range(steps):
        new = c + sum(b[i] * ws[-k] for i, k in enumerate(past)) + sum(b[len(past) + i] * es[-k] for i, k in enumerate(shifts))
        ws.append(new)
        es.append(0.0)
        ys.append(new - sum(v * ys[-lag] for lag, v in weights.items() if lag))
    return np.array(ys[len(y) :])


def checked(got, split, specs, period, rtol=1e-5):
    seen = 0
    for sid, g in by_series(split).items():
        y, steps = g[g.is_train].y.to_numpy(), int((~g.is_train).sum())
        for i, spec in enumerate(specs):
            np.testing.assert_allclose(got[sid, i], plain_forecast(y, spec, period, steps), rtol=rtol, err_msg=f"{sid} {spec}")
            seen += 1
    return seen


def forecasts_of(df):
    return {(sid, v): g.sort_values("rn").yhat.to_numpy() for (sid, v), g in df.toPandas().groupby(["series_id", "variation"])}


@pytest.mark.parametrize("name", ["dated_split", "stamped_split"])
def test_plain_orders_match_two_regressions(request, name):
    split = request.getfixturevalue(name)
    specs = [ar.order(0, 0, q=1), ar.order(1, 0, q=2), ar.order(2, 1, q=1), ar.order(0, 1, q=4), ar.order(1, 1)]
    assert checked(forecasts_of(ar.forecast_ar(split, specs)), split, specs, 1) == 15


@pytest.mark.parametrize("make", [panel_frame, stamped_frame])
def test_seasonal_orders_match_two_regressions(spark, make):
    split = chrono_split(make(spark, {"s": series(300, 3, "season"), "w": series(260, 5)}))
    specs = [ar.order(1, 1, 0, 1, 0, 1), ar.order(1, 1, 1, 1, 1, 1), ar.order(0, 0, 1, 0, 1, 1), ar.order(2, 0, 0, 1, 2, 0)]
    assert checked(forecasts_of(ar.forecast_seasonal_ar(split, specs, 12)), split, specs, 12, 1e-4) == 8


def test_blocks_change_nothing(spark, monkeypatch):
    from tidewater.operators import positions

    y = {"a": series(400, 9)}
    want = forecasts_of(ar.forecast_ar(chrono_split(panel_frame(spark, y)), [ar.order(1, 1, q=2)]))
    monkeypatch.setattr(positions.over_neighbours, "__defaults__", (0, 0, 32))
    got = forecasts_of(ar.forecast_ar(chrono_split(stamped_frame(spark, y)), [ar.order(1, 1, q=2)]))
    np.testing.assert_allclose(got["a", 0], want["a", 0], rtol=1e-9)


def test_terms_of_a_known_process_are_found(spark):
    rng = np.random.default_rng(11)
    e = rng.normal(size=6000)
    w = np.zeros(6000)
    for t in range(1, 6000):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    split = chrono_split(panel_frame(spark, {"a": 50 + w[1000:]}))
    fit = ar.fit_ar(split, [ar.order(1, 0, q=1), ar.order(0, 0, q=1)]).orderBy("variation").toPandas()
    assert abs(fit.coef[0][0] - 0.6) < 0.05 and abs(fit.theta[0][0] - 0.4) < 0.05
    assert fit.theta[1][0] > 0.5 and len(fit.shocks[0]) == 1


def test_moving_terms_fade_from_the_forecast():
    got = roll(np.zeros(0), 2.0, np.zeros(0), 0, 5, theta=[0.5, 0.25], shocks=[4.0, 8.0])
    np.testing.assert_allclose(got, [2 + 2 + 2, 2 + 1, 2, 2, 2])
    coef, state, theta, shocks = np.array([0.6, -0.2]), np.array([3.0, 1.0]), [0.3, 0.1, 0.2], [1.0, -2.0, 0.5]
    whole = roll(coef, 1.0, state, 0, 12, theta, shocks)
    for start in (1, 2, 5):
        np.testing.assert_allclose(roll(coef, 1.0, state, start, 12 - start, theta, shocks), whole[start:], rtol=1e-9)


def test_whole_grids_are_scored_and_names_tell_the_fit(spark, dated_split):
    assert len(ar.GRID) == 50 and len(ar.SEASONAL_FULL_GRID) == 144
    candidates, tuned = ar.tune_ar(dated_split)
    rows = candidates.toPandas()
    for sid, g in by_series(dated_split).items():
        y = g[g.is_train].y.to_numpy()
        val = int(len(y) * 0.2)
        own = rows[rows.series_id == sid].sort_values("candidate_no")
        fitted = [s for s in ar.GRID if not s["q"] or plain_fit(y[:-val], s, 1) is not None]
        assert len(own) == len(fitted) and own.chosen.sum() >= 1
        best = json.loads(own.loc[own.rmse.idxmin()].params)["order"]
        want = plain_forecast(y[:-val], ar.order(best[0], best[1], q=best[2]), 1, val)
        np.testing.assert_allclose(own.rmse.min(), np.sqrt(np.mean((y[-val:] - want) ** 2)), rtol=1e-5)
    assert set(forecasts_of(tuned)) == {("a", 0), ("b", 0), ("c", 0)}


def test_default_seasonal_variations_fit_what_they_name(spark):
    split = chrono_split(panel_frame(spark, {"s": series(200, 3, "season")}))
    forecasts = sweep.sweep(split, ["sarima"])
    names = {(r.variation, r.model) for r in forecasts.select("variation", "model").distinct().collect()}
    assert names == {(0, "SARIMA(1, 1, 0)x(0, 1, 1, 52)"), (1, "SARIMA(1, 1, 1)x(1, 1, 1, 52)"), (2, "SARIMA(2, 1, 0)x(0, 1, 1, 52)")}
    specs = [ar.order(1, 1, 0, 1, 0, 1), ar.order(1, 1, 1, 1, 1, 1), ar.order(2, 1, 0, 1, 0, 1)]
    assert checked(forecasts_of(forecasts), split, specs, 52, 1e-3) == 3


def test_too_short_for_residuals_is_no_fit(spark):
    split = chrono_split(panel_frame(spark, {"a": series(16, 4)}))
    assert {r.variation for r in ar.fit_ar(split, [ar.order(1, 0), ar.order(1, 0, q=1)]).collect()} == {0}


@pytest.mark.parametrize("grid", [ar.PLAIN, [ar.order(1, 1, 0, 1, 0, 1), ar.order(1, 0, 1, 0, 1, 1), ar.order(2, 1, 0, 0, 1)]])
@pytest.mark.parametrize("period", [None, 4])
def test_series_of_dates_are_fitted_in_one_pass_as_by_windows(spark, monkeypatch, grid, period):
    """Short series miss orders, filters or both; the windows serve as the plain way."""
    values = {f"s{n}": np.random.default_rng(n).normal(size=n).cumsum() for n in (3, 7, 12, 19, 31, 60, 140)}
    split = chrono_split(panel_frame(spark, values)).persist()
    plan = ar.fit_ar(split, grid, period)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    once = {(r["series_id"], r["variation"]): r for r in plan.collect()}
    monkeypatch.setattr(ar, "one_row_per_date", lambda split: False)
    wanted = {(r["series_id"], r["variation"]): r for r in ar.fit_ar(split, grid, period).collect()}
    assert set(once) == set(wanted) and {v for _, v in once} == {0, 1, 2}
    for key, row in wanted.items():
        for c in ("intercept", "coef", "state", "theta", "shocks"):
            assert np.allclose(once[key][c], row[c], rtol=1e-6, atol=1e-6), (key, c)
    split.unpersist()
