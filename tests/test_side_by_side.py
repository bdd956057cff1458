"""Many series worked on at once give what each gives alone."""

import numpy as np
import pytest
from conftest import panel_frame, series

from tidewater.forecast import ar, gram, linear
from tidewater.operators.features import feature_names, feature_table
from tidewater.operators.splits import chrono_split


def test_stacks_hold_every_row_once():
    sizes = np.array([3, 70, 1, 3, 2, 40])
    starts, seen = np.append(0, np.cumsum(sizes)[:-1]), []
    for own, places in gram.stacks(starts, sizes.sum(), 30):
        assert places.size <= 30 or len(own) == 1
        for group, line in zip(own, places):
            rows = line[line < sizes.sum()]
            assert rows.tolist() == list(range(starts[group], starts[group] + sizes[group]))
            seen += rows.tolist()
    assert sorted(seen) == list(range(sizes.sum()))


@pytest.mark.parametrize("loss", ["huber", "quantile"])
def test_reweighted_fits_of_a_task_share_their_passes(spark, loss):
    panel = panel_frame(spark, {f"s{i}": series(90 + 7 * (i % 5), i) for i in range(12)})
    split = chrono_split(feature_table(panel)).persist()
    train = linear.standardised(split, feature_names()).where("is_train").toPandas().sort_values(["series_id", "rn"])
    spec, many = linear.with_defaults({"loss": loss}), linear.iterate_side_by_side
    parts = list(linear.whole_series([train.iloc[a : a + 37] for a in range(0, len(train), 37)], 200))
    assert sum(len(p) for p in parts) == len(train) and sum(p["series_id"].nunique() for p in parts) == 12
    fits = {r["series_id"]: r for r in linear.fit_linear(split, [{"loss": loss}]).collect()}
    assert len(fits) == 12
    for sid, own in train.groupby("series_id"):
        m, fit = linear.matrix(own), fits[sid]
        coef, gap = linear.iterate_locally(m, spec, feature_names(), own["y_std"].iloc[0])
        assert abs(fit["gap"] - gap) < 1e-4
        assert gap > linear.TOLERANCE or np.allclose(m[:, :-1] @ coef, m[:, :-1] @ fit["coef"], atol=0.02)  # what the proof leaves open
    longest = max(train.groupby("series_id").size())
    stacked = [np.pad(linear.matrix(own), ((0, longest - len(own)), (0, 0))) for _, own in train.groupby("series_id")]
    real = np.arange(longest) < train.groupby("series_id").size().to_numpy()[:, None]
    coefs, gaps = many(np.stack(stacked), real, spec, feature_names(), train.groupby("series_id")["y_std"].first().to_numpy())
    assert np.allclose(gaps, [fits[s]["gap"] for s in sorted(fits)], atol=1e-4) and coefs.shape == (12, len(feature_names()) + 1)


def test_passes_of_a_fit_share_one_decomposition(monkeypatch):
    rng, real_eigh, decomposed = np.random.default_rng(8), np.linalg.eigh, []
    m = rng.normal(size=(6, 50, 15))
    m[..., 0], m[..., 8], m[..., -1] = 1.0, m[..., 1:4].mean(axis=2), m[..., 1] + rng.standard_t(2, size=(6, 50))
    # numpy's pinv reaches eigh through its own module
    monkeypatch.setitem(np.linalg.pinv.__wrapped__.__globals__, "eigh", lambda a, *b, **c: decomposed.append(len(a)) or real_eigh(a, *b, **c))
    monkeypatch.setattr(np.linalg, "eigh", lambda a, *b, **c: decomposed.append(len(a)) or real_eigh(a, *b, **c))
    fast = linear.iterate_side_by_side(m, np.ones((6, 50), bool), linear.with_defaults({"loss": "huber"}), feature_names(), np.full(6, 2e5))
    assert sum(decomposed) <= 3 * len(m)
    monkeypatch.setattr(linear, "solve_again", lambda a, b, *flat: gram.solve_many(a, b))
    slow = linear.iterate_side_by_side(m, np.ones((6, 50), bool), linear.with_defaults({"loss": "huber"}), feature_names(), np.full(6, 2e5))
    assert sum(decomposed) > 50 and np.allclose(fast[0], slow[0], atol=1e-9) and np.allclose(fast[1], slow[1], atol=1e-9)


def test_known_flat_directions_change_no_solution():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 40, 6))
    x[1, :, 5] = x[1, :, :3].mean(axis=1)  # flat in one direction
    x[2, :, 5], x[2, :, 4] = x[2, :, 0], 2 * x[2, :, 1]  # in two
    x[3, :, 5] = x[3, :, 0] + 1e-4 * x[3, :, 5]  # nearly flat, and nearer than the limit
    x[4, :, 2] = 0.0
    y = rng.normal(size=(5, 40, 1))
    flat = gram.flat_directions(x.transpose(0, 2, 1) @ x)
    assert flat[1].tolist() == [True, True, False, True, True]
    for penalty in (0.0, 1e-11):
        w = rng.uniform(0.01, 1, size=(5, 40, 1))
        a, b = (x * w).transpose(0, 2, 1) @ x + penalty * np.eye(6), ((x * w).transpose(0, 2, 1) @ y)[..., 0]
        want = gram.solve_many(a, b)
        assert np.allclose(gram.solve_again(a, b, *flat), want, rtol=1e-6, atol=1e-9)
        lost = (np.zeros((5, 6)), np.ones(5, bool))  # of no use: every flat system goes the long way
        assert np.allclose(gram.solve_again(a, b, *lost), want, rtol=1e-6, atol=1e-9)


def test_passes_without_proof_keep_the_best(monkeypatch):
    """A look at every fifth pass only keeps what a look at each would."""
    rng = np.random.default_rng(10)
    m = rng.normal(size=(4, 30, 15))
    m[..., 0] = 1.0
    spec, looks, real_bound = linear.with_defaults({"loss": "quantile"}), [], linear._bounded
    monkeypatch.setattr(linear, "MAX_PASSES", 7)
    monkeypatch.setattr(linear, "TOLERANCE", 0.0)
    monkeypatch.setattr(linear, "_bounded", lambda *a: looks.append((a[4], real_bound(*a))) or looks[-1][1])
    best, gaps = linear.iterate_side_by_side(m, np.ones((4, 30), bool), spec, feature_names(), np.ones(4))
    assert len(looks) == 7
    every = np.stack([g for _, g in looks])
    assert np.allclose(gaps, every.min(axis=0))
    assert np.allclose(best, np.stack([c for c, _ in looks])[every.argmin(axis=0), np.arange(4)])


def test_scales_of_many_series_are_those_of_each():
    rng = np.random.default_rng(5)
    sizes = [2, 9, 30]
    r, real = np.zeros((3, 30)), np.arange(30) < np.array(sizes)[:, None]
    for line, n in zip(r, sizes):
        line[:n] = rng.standard_t(2, n)
    assert np.allclose(linear.best_scales(r, real, 1.35), [linear.best_scale(line[:n], 1.35) for line, n in zip(r, sizes)])


def test_orders_of_many_series_are_solved_at_once():
    rng, spec = np.random.default_rng(6), ar.order(2, 1, q=1)
    x = rng.normal(size=(60, 5))
    x[7, 2] = np.nan
    starts = np.array([0, 3, 33])  # the first has too few rows for its three terms and gets no fit
    grams = gram.cross_products_of(x, list(gram.stacks(starts, len(x))), 3)
    for line, rows in zip(grams, np.split(x, starts[1:])):
        assert np.allclose(line, gram.cross_products(rows))
    fitted, intercept, coef, theta = ar.solve(grams.reshape(3, 5, 5), spec, 1)
    assert fitted.tolist() == [1, 2] and not intercept.any()
    for rows, own, late in zip((x[3:33], x[33:]), coef, theta):
        rows = rows[~np.isnan(rows).any(axis=1)]
        phi = np.linalg.lstsq(rows[:, 1:4], rows[:, 4], rcond=None)[0]
        assert np.allclose(own, [1 + phi[0], phi[1] - phi[0], -phi[1]]) and np.allclose(late, phi[2:])


def test_sums_of_a_batch_are_those_of_its_groups(spark):
    rows = [(f"g{i % 7}", float(i), float(i * i % 11)) for i in range(90)]
    frame = spark.createDataFrame(rows, "k string, a double, b double").repartition(3)
    alone = gram.partial_sums(frame, ["k"], lambda pdf: gram.cross_products(pdf[["a", "b"]].to_numpy()))

    def payload(pdf, starts):
        return gram.cross_products_of(pdf[["a", "b"]].to_numpy(), list(gram.stacks(starts, len(pdf))), len(starts))

    together = gram.stacked_sums(frame, ["k"], payload)
    assert {r["k"]: r["gram"] for r in together.collect()} == {r["k"]: r["gram"] for r in alone.collect()}
