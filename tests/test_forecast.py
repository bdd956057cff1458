import itertools
import json

import numpy as np
import pandas as pd
import pytest
from conftest import by_series, panel_frame, series, stamped_frame
from pyspark.sql import functions as F

from tidewater.forecast import ar, es, linear, ma, smoothing_maps, trees, trend
from tidewater.forecast.rollout import recursive_rollout, roll
from tidewater.operators.features import feature_names, feature_table
from tidewater.operators.ranking import best_candidate
from tidewater.operators.splits import chrono_split

SPLITS = ["dated_split", "stamped_split"]


@pytest.fixture(params=SPLITS)
def split(request):
    return request.getfixturevalue(request.param)


def parts(split):
    out = {}
    for sid, g in by_series(split).items():
        out[sid] = (g[g.is_train], g[~g.is_train])
    return out


def forecasts_of(df):
    return {
        (sid, v): g.sort_values("rn").yhat.to_numpy()
        for (sid, v), g in df.toPandas().groupby(["series_id", "variation"])
    }


def test_moving_average_and_its_tuning(split):
    got = forecasts_of(ma.forecast_ma(split))
    candidates, tuned = ma.tune_ma(split)
    rows = candidates.toPandas()
    chosen = forecasts_of(tuned)
    for sid, (train, test) in parts(split).items():
        y = train.y.to_numpy()
        for i, w in enumerate((3, 5, 7)):
            np.testing.assert_allclose(got[sid, i], np.full(len(test), y[-w:].mean()))
        val = min(max(1, int(len(y) * 0.2)), len(y) - 1)
        fit, held = y[:-val], y[-val:]
        scores = {w: np.sqrt(np.mean((held - fit[-w:].mean()) ** 2)) for w in range(2, min(30, len(fit) // 2))}
        mine = rows[rows.series_id == sid].set_index("candidate_no").rmse
        assert sorted(mine.index + 2) == sorted(scores)
        np.testing.assert_allclose([mine[w - 2] for w in scores], list(scores.values()), rtol=1e-9)
        best = min(scores, key=scores.get)
        np.testing.assert_allclose(chosen[sid, 0], np.full(len(test), y[-best:].mean()))


def ar_reference(y, p, d, steps):
    z = np.diff(y) if d else y
    x = np.column_stack([z[p - k - 1 : len(z) - k - 1] for k in range(p)]) if p else np.zeros((len(z), 0))
    target = z[p:]
    if d == 0:
        x = np.column_stack([np.ones(len(target)), x])
    coef = np.linalg.lstsq(x, target, rcond=None)[0] if x.shape[1] else np.zeros(0)
    history, out, level = list(z), [], y[-1]
    for _ in range(steps):
        lagged = np.array([history[-k - 1] for k in range(p)])
        step = coef @ np.concatenate([[1.0], lagged]) if d == 0 else coef @ lagged
        history.append(step)
        level = level + step if d else step
        out.append(level)
    return np.array(out)


def test_autoregression_matches_least_squares(split):
    grid = ar.PLAIN_GRID
    got = forecasts_of(ar.forecast_ar(split, grid))
    for sid, (train, test) in parts(split).items():
        for i, s in enumerate(grid):
            want = ar_reference(train.y.to_numpy(), s["p"], s["d"], len(test))
            np.testing.assert_allclose(got[sid, i], want, rtol=1e-6)


def test_ar_tuning_scores_the_holdout_only(dated_split):
    candidates, tuned = ar.tune_ar(dated_split, ar.PLAIN_GRID)
    rows, chosen = candidates.toPandas(), forecasts_of(tuned)
    for sid, (train, test) in parts(dated_split).items():
        y = train.y.to_numpy()
        val = int(len(y) * 0.2)
        scores = [
            np.sqrt(np.mean((y[-val:] - ar_reference(y[:-val], s["p"], s["d"], val)) ** 2)) for s in ar.PLAIN_GRID
        ]
        mine = rows[rows.series_id == sid].sort_values("candidate_no")
        np.testing.assert_allclose(mine.rmse, scores, rtol=1e-6)
        best = ar.PLAIN_GRID[int(np.argmin(scores))]
        assert mine[mine.chosen].params.map(json.loads).tolist()[0] == {"order": [best["p"], best["d"], 0]}
        np.testing.assert_allclose(chosen[sid, 0], ar_reference(y, best["p"], best["d"], len(test)), rtol=1e-6)


def test_same_train_same_choice(spark):
    y = series(80, 42)
    a, b = y.copy(), y.copy()
    b[70:] = 0.0
    chosen = []
    for values in (a, b):
        split = chrono_split(panel_frame(spark, {"a": values}))
        c = ar.ar_candidates(split, ar.PLAIN_GRID)
        chosen.append(best_candidate(c, ["series_id"]).first().params)
    assert chosen[0] == chosen[1]


def test_seasonal_difference_repeats_the_season(split):
    got = forecasts_of(ar.forecast_seasonal_ar(split, [ar.order(0, 0, 0, 1)], 4))
    for sid, (train, test) in parts(split).items():
        np.testing.assert_allclose(got[sid, 0], np.resize(train.y.to_numpy()[-4:], len(test)), rtol=1e-9)


def test_seasonal_autoregression_follows_a_season(spark):
    split = chrono_split(panel_frame(spark, {"s": series(150, 3, "season")}))
    got = forecasts_of(ar.forecast_seasonal_ar(split, None, 12))
    _, test = parts(split)["s"]
    flat = np.std(test.y)
    for i in range(3):
        assert np.sqrt(np.mean((got["s", i] - test.y) ** 2)) < flat / 2


def test_rollout_in_pieces_equals_one_run(spark):
    coef, state = np.array([0.6, -0.3, 0.2]), np.array([3.0, 2.0, 1.0])
    whole = roll(coef, 1.5, state, 0, 50)
    fits = spark.createDataFrame([("a", coef.tolist(), 1.5, state.tolist(), 50)],
                                 "series_id string, coef array<double>, intercept double, state array<double>, horizon long")
    got = recursive_rollout(fits, ["series_id"], chunk=7).orderBy("step").toPandas()
    assert got.step.tolist() == list(range(1, 51))
    np.testing.assert_allclose(got.yhat, whole, rtol=1e-9)


def smoothing_reference(y, trend_kind, seasonal, period, weights):
    first = es.start_state(y, trend_kind, seasonal, period)
    if first is None:
        return None
    best = None
    for a, b, g in weights.T:
        level, slope, season = first[0], first[1], list(first[2])
        sse = 0.0
        for t, v in enumerate(y):
            base = level + slope if trend_kind == "add" else level * slope if trend_kind == "mul" else level
            s = season[t % period] if seasonal else None
            sse += (v - (base + s if seasonal == "add" else base * s if seasonal == "mul" else base)) ** 2
            clean = v - s if seasonal == "add" else v / s if seasonal == "mul" else v
            new = a * clean + (1 - a) * base
            if trend_kind:
                slope = b * (new - level if trend_kind == "add" else new / level) + (1 - b) * slope
            if seasonal:
                season[t % period] = g * (v - base if seasonal == "add" else v / base) + (1 - g) * s
            level = new
        if best is None or sse < best[0]:
            best = (sse, level, slope, season)
    return best


@pytest.mark.parametrize("block_rows", [10_000, 32])
def test_smoothing_matches_a_plain_loop(split, block_rows):
    got = forecasts_of(es.forecast_es(split, es.COMBINATIONS, 4, block_rows=block_rows))
    for sid, (train, test) in parts(split).items():
        y = train.y.to_numpy()
        for i, (t, s) in enumerate(es.COMBINATIONS):
            best = smoothing_reference(y, t, s, 4, es.weight_grid(t, s))
            k = np.arange(1, len(test) + 1)
            base = best[1] + (k * best[2] if t == "add" else 0) if t != "mul" else best[1] * best[2] ** k
            season = np.array([best[3][(len(y) + j - 1) % 4] for j in k]) if s else 0
            want = base + season if s == "add" else base * season if s == "mul" else base
            np.testing.assert_allclose(got[sid, i], np.broadcast_to(want, len(test)), rtol=1e-6)


def test_multiplicative_smoothing_needs_positive_values(spark):
    split = chrono_split(panel_frame(spark, {"a": np.sin(np.arange(60))}))
    made = {v for _, v in forecasts_of(es.forecast_es(split, es.COMBINATIONS, 4))}
    assert made == {0, 2, 6, 8}


def test_trend_model_beats_the_mean_and_reads_seasons(spark):
    t = np.arange(900)
    y = 500 + 0.3 * t + 40 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(0).normal(size=900)
    split = chrono_split(panel_frame(spark, {"a": y}))
    _, test = parts(split)["a"]
    got = forecasts_of(trend.forecast_trend_seasonal(split))
    assert len(got) == 3
    assert min(np.sqrt(np.mean((v - test.y) ** 2)) for v in got.values()) < 8
    candidates, tuned = trend.tune_trend_seasonal(split)
    assert candidates.count() == 32
    assert np.sqrt(np.mean((forecasts_of(tuned)["a", 0] - test.y) ** 2)) < 8


def design(frame, columns):
    return frame[columns].to_numpy(dtype=float)


def test_least_squares_matches_numpy(split):
    got = forecasts_of(linear.forecast_linear(split, [{"loss": "l2", "lags": 3}, {"loss": "l2"}]))
    for sid, (train, test) in parts(split).items():
        for i, lags in enumerate((3, 7)):
            cols = [c for c in feature_names() if not c.startswith("lag_") or int(c[4:]) <= lags]
            x, z = design(train, cols), design(test, cols)
            mean = x.mean(axis=0)
            coef = np.linalg.lstsq(x - mean, train.y - train.y.mean(), rcond=1e-10)[0]
            np.testing.assert_allclose(got[sid, i], train.y.mean() + (z - mean) @ coef, rtol=1e-6)


def test_lasso_reaches_the_optimum(split):
    alpha = 0.1
    fits = linear.fit_linear(split, [{"loss": "l1", "alpha": alpha}])
    coefs = {x.series_id: x for x in fits.collect()}
    for sid, (train, _) in parts(split).items():
        x, y = design(train, feature_names()), train.y.to_numpy()
        fit = coefs[sid]
        raw = np.array(fit.coef[1:]) * linear.raw_weight(feature_names(), fit.y_std)
        xc, yc = x - x.mean(axis=0), y - y.mean()

        def objective(w):
            return np.mean((yc - xc @ w) ** 2) / 2 + alpha * np.abs(w).sum()

        w, n = np.zeros(x.shape[1]), len(y)
        for _ in range(20_000):
            for j in range(len(w)):
                q = xc[:, j] @ xc[:, j] / n
                if q > 0:
                    pull = xc[:, j] @ (yc - xc @ w) / n + q * w[j]
                    w[j] = np.sign(pull) * max(abs(pull) - alpha, 0) / q
            if _ % 500 == 499 and abs(objective(w) - objective(raw)) < 1e-4 * objective(w):
                break
        assert objective(raw) <= objective(w) * (1 + 1e-3)


def huber_objective(r, sigma, eps, w):
    z = np.abs(r / sigma)
    h = np.where(z < eps, z**2, 2 * eps * z - eps**2)
    return np.sum(sigma + h * sigma) + 1e-4 * w @ w


def test_huber_and_quantile_are_stationary_on_both_paths(spark, data):
    fits = {}
    for name, frame in (("dates", panel_frame), ("times", stamped_frame)):
        panel = frame(spark, {"a": data["a"]})
        split = chrono_split(feature_table(panel))
        cols = ["lag_1", "lag_2"]
        fits[name] = linear.fit_linear(split, [{"loss": "huber"}, {"loss": "quantile"}, {"loss": "l2"}], cols).collect()
        train = split.where("is_train").toPandas().sort_values("rn")
        x, y = design(train, cols), train.y.to_numpy()
        for fit in fits[name]:
            c = np.array(fit.coef)
            z, std = (x - fit.y_mean) / fit.y_std, fit.y_std
            assert fit.gap == 0.0 if fit.variation == 2 else 0 <= fit.gap <= linear.TOLERANCE
            r = (y - fit.y_mean) / std - c[0] - z @ c[1:]
            if fit.variation == 1:
                best = np.mean(np.abs(r))
                for d in np.random.default_rng(0).normal(scale=1e-2, size=(200, 3)):
                    other = np.mean(np.abs((y - fit.y_mean) / std - (c[0] + d[0]) - z @ (c[1:] + d[1:])))
                    assert other > best - 1e-4
            elif fit.variation == 0:
                sigmas = np.linspace(0.005, 1.0, 2000)
                best = min(huber_objective(r, s, 1.35, c[1:]) for s in sigmas)
                for d in np.random.default_rng(1).normal(scale=1e-2, size=(50, 3)):
                    moved = (y - fit.y_mean) / std - (c[0] + d[0]) - z @ (c[1:] + d[1:])
                    assert min(huber_objective(moved, s, 1.35, c[1:] + d[1:]) for s in sigmas) > best - 1e-3
    a, b = ({f.variation: f.coef for f in fits[n]} for n in ("dates", "times"))
    for v in a:
        np.testing.assert_allclose(a[v], b[v], atol=1e-4)


def least_quantile_loss(x, y, q):
    """The least mean loss, over all lines through as many rows as there are coefficients: one of them is optimal."""
    width = x.shape[1] + 1
    m = np.column_stack([np.ones(len(x)), x])
    losses = []
    for rows in itertools.combinations(range(len(x)), width):
        chosen = m[list(rows)]
        if abs(np.linalg.det(chosen)) > 1e-9:
            r = y - m @ np.linalg.solve(chosen, y[list(rows)])
            losses.append(np.mean(np.maximum(q * r, (q - 1) * r)))
    return min(losses)


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantile_gap_bounds_the_distance_to_the_least_loss(q):
    rng = np.random.default_rng(3)
    spec = linear.with_defaults({"loss": "quantile", "quantile": q})
    for trial in range(5):
        x = rng.normal(size=(24, 2))
        y = x @ [1.0, -2.0] + rng.standard_t(2, size=24)
        y = (y - y.mean()) / y.std()
        if trial == 4:  # ties
            x, y = np.round(x), np.round(y)
        coef, gap = linear.iterate_locally(np.column_stack([np.ones(24), x, y]), spec, ["lag_1", "lag_2"], 1.0)
        r = y - coef[0] - x @ coef[1:]
        loss, least = np.mean(np.maximum(q * r, (q - 1) * r)), least_quantile_loss(x, y, q)
        assert least - 1e-12 <= loss <= least + gap + 1e-12 and gap <= linear.TOLERANCE


def slow_rows(n=200, width=8):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, width))
    y = x @ rng.normal(size=width) + rng.standard_t(2, size=n)
    return x, (y - y.mean()) / y.std()


def test_slow_reweighted_fits_go_on_until_they_are_proven(monkeypatch):
    x, y = slow_rows()
    m, cols = np.column_stack([np.ones(len(x)), x, y]), [f"lag_{i + 1}" for i in range(x.shape[1])]
    for given in ({"loss": "quantile", "quantile": 0.9}, {"loss": "huber", "epsilon": 1.0}):
        spec = linear.with_defaults(given)
        coef, gap = linear.iterate_locally(m, spec, cols, 1.0)
        monkeypatch.setattr(linear, "MAX_PASSES", 40)
        early, early_gap = linear.iterate_locally(m, spec, cols, 1.0)
        monkeypatch.undo()
        assert gap <= linear.TOLERANCE < early_gap
        errors = y[:, None] - m[:, :-1] @ np.column_stack([coef, early])
        if given["loss"] == "quantile":
            losses = np.mean(np.maximum(0.9 * errors, -0.1 * errors), axis=0)
        else:
            sigmas = np.geomspace(1e-5, 1, 400)
            losses = [min(huber_objective(r, s, spec["epsilon"], c[1:]) for s in sigmas) / len(y) for r, c in zip(errors.T, (coef, early))]
        assert losses[0] <= losses[1] + 1e-9 and losses[1] <= losses[0] + early_gap + 1e-4


def test_gaps_of_degenerate_series():
    line = np.arange(30.0)
    exact = np.column_stack([np.ones(30), line, line / 10])
    flat = np.column_stack([np.ones(30), np.zeros(30), np.zeros(30)])
    for loss in ("huber", "quantile"):
        for m in (exact, flat, exact[:2]):
            coef, gap = linear.iterate_locally(m, linear.with_defaults({"loss": loss}), ["lag_1"], 1.0)
            assert gap <= linear.TOLERANCE and np.all(np.isfinite(coef))


def ridge_reference(x, y, alpha):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return lambda z: y.mean() + (z - x.mean(axis=0)) @ w


def test_ridge_tuning_matches_fold_by_fold_fits(split):
    per_fold = linear.linear_candidates(split, "l2").toPandas()
    cols = feature_names()
    for sid, (train, _) in parts(split).items():
        x, y = design(train, cols), train.y.to_numpy()
        size = len(y) // 4
        for c, alpha in enumerate((0.01, 0.1, 1.0, 10.0)):
            for fold in range(3):
                at = len(y) - (3 - fold) * size
                predicted = ridge_reference(x[:at], y[:at], alpha)(x[at : at + size])
                want = np.sqrt(np.mean((y[at : at + size] - predicted) ** 2))
                row = per_fold[(per_fold.series_id == sid) & (per_fold.candidate_no == c) & (per_fold.fold == fold)]
                assert row.rmse.iloc[0] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("loss", ["l2", "l1", "huber", "quantile"])
def test_linear_tuning_returns_forecasts_for_every_test_row(dated_split, loss):
    candidates, forecasts = linear.tune_linear(dated_split, loss)
    got = forecasts_of(forecasts)
    for sid, (_, test) in parts(dated_split).items():
        assert len(got[sid, 0]) == len(test) and np.isfinite(got[sid, 0]).all()
    assert candidates.where("size(fold_scores) != 3").count() == 0


def test_unknown_loss(dated_split):
    with pytest.raises(ValueError):
        linear.fit_linear(dated_split, [{"loss": "cosh"}])
    with pytest.raises(ValueError):
        trees.forest({}, "huber")
    with pytest.raises(ValueError):
        trees.boosted({}, "cosh")


def test_trees_beat_the_mean_on_a_learnable_series(spark):
    y = 100 + 30 * np.sin(np.arange(200) / 3)
    split = chrono_split(feature_table(panel_frame(spark, {"a": y, "b": 10 * y})))
    for key, params in (("rf", {"n_estimators": 5}), ("xgb", {"n_estimators": 5})):
        got = forecasts_of(trees.forecast_trees(split, key, {"loss": "l2", **params}))
        for sid, (train, test) in parts(split).items():
            rmse = np.sqrt(np.mean((got[sid, 0] - test.y) ** 2))
            assert rmse < np.std(test.y)


def test_forest_tuning_and_importance(spark, dated_split):
    grid = {"n_estimators": [2], "max_depth": [2, 4]}
    candidates, forecasts, model = trees.tune_trees(dated_split, "rf", grid=grid)
    assert candidates.count() == 3 * 2 * 3
    assert forecasts.where("yhat is null").count() == 0
    table = trees.feature_importance(spark, model).toPandas()
    assert table.importance.sum() == pytest.approx(1.0) and table.importance.is_monotonic_decreasing
    assert len(trees.grid_candidates(trees.FOREST_GRID)) == 108
    assert len(trees.grid_candidates(trees.BOOSTED_GRID)) == 1296


def test_short_series_are_left_out_not_broken(spark):
    split = chrono_split(panel_frame(spark, {"tiny": [1.0, 2.0, 4.0]}))
    assert ar.forecast_ar(split, [ar.order(4, 1)]).count() == 0
    assert es.forecast_es(split, [("add", "add")], 12).count() == 0
    assert ma.forecast_ma(split, [7]).where(F.col("yhat").isNotNull()).count() == 0


def test_smoothing_maps_equal_steps():
    from tidewater.forecast.smoothing_maps import Maps

    rng = np.random.default_rng(2)
    y = rng.normal(10, 2, 203)
    for trend_kind, seasonal in ((None, None), ("add", None), (None, "add"), ("add", "add")):
        grid = es.weight_grid(trend_kind, seasonal)
        level, slope, season = es.start_state(y, trend_kind, seasonal, 5)
        x = np.concatenate([[level], [slope] if trend_kind else [], season])
        for chunk in (64, 16, 24):
            m = Maps(grid, trend_kind is not None, seasonal is not None, 5 if seasonal else 1, chunk)
            state, sse = m.run(y, np.tile(x, (m.points, 1)))
            zeros = np.zeros(grid.shape[1])
            want = es.smooth(y, 0, zeros + level, zeros + slope, np.tile(season, (grid.shape[1], 1)), zeros, grid, trend_kind, seasonal)
            np.testing.assert_allclose(state[:, 0], want[0], rtol=1e-9)
            np.testing.assert_allclose(sse, want[3], rtol=1e-9)
            if seasonal:
                np.testing.assert_allclose(np.roll(state[:, m.size - 5 :], len(y) % 5, axis=1), want[2], rtol=1e-8, atol=1e-9)
            # two runs compose: the later one moves the state of the earlier and adds its own
            half, _ = m.run(y[:96], np.tile(x, (m.points, 1)))
            own, _ = m.run(y[96:], np.zeros((m.points, m.size)), errors=False)
            np.testing.assert_allclose(m.ahead(half, len(y) - 96) + own, state, rtol=1e-9)


def test_smoothing_of_a_long_series_in_blocks(spark):
    y = series(1500, 8, "season")
    split = chrono_split(stamped_frame(spark, {"a": y}))
    combos = [("add", "add"), ("add", None), (None, "add"), (None, None)]
    train = split.where("is_train").withColumn("period", F.lit(12))
    whole = {r.variation: r for r in es.fit_smoothing(train, combos, None, 65_536).collect()}
    cut = {r.variation: r for r in es.fit_smoothing(train, combos, None, 128).collect()}
    for v in range(4):
        assert whole[v].point == cut[v].point
        np.testing.assert_allclose([whole[v].level, whole[v].slope, whole[v].sse], [cut[v].level, cut[v].slope, cut[v].sse], rtol=1e-7)
        np.testing.assert_allclose(whole[v].season, cut[v].season, rtol=1e-6, atol=1e-8)


def test_states_of_whole_grids_stay_in_their_task(dated_split):
    """A series of one block gives its best point where it was smoothed; wide rows are worked off a few at a time."""
    train = es.with_period(dated_split, 12).where("is_train")
    plan = es.fit_smoothing(train, es.VARIATIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("FlatMapGroupsInPandas") == 1
    sizes = [len(part) for part in smoothing_maps.in_slices([pd.DataFrame({"a": range(150)}), pd.DataFrame({"a": [1]})])]
    assert sizes == [64, 64, 22, 1]
