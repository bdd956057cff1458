"""Boosting on pseudo-Huber and quantile loss, forests on absolute error, against plain searches."""

import numpy as np
import pytest
from conftest import panel_frame, series
from pyspark.ml.functions import array_to_vector

from tidewater.forecast import histogram_trees as ht
from tidewater.forecast import trees
from tidewater.operators.splits import chrono_split
from tidewater.operators.features import feature_table
from tidewater.plans import sweep

PARAMS = {"n_estimators": 12, "learning_rate": 0.2, "max_depth": 3, "min_child_weight": 1, "subsample": 1.0, "colsample_bytree": 1.0}
FOREST = {"n_estimators": 1, "max_depth": 1, "min_samples_split": 2, "min_samples_leaf": 1}


def rows_frame(spark, x, z, parts=3):
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, z)]
    frame = spark.createDataFrame(rows, "x array<double>, z double").repartition(parts)
    return frame.withColumn("vector", array_to_vector("x")).select("vector", "z")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[:, 1] = rng.integers(0, 4, 400)
    z = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + rng.standard_t(2, 400)
    return x, z


def plain_split(bins, z, least=1):
    """The split with the smallest sum of absolute deviations from medians, by trying all of them."""
    def cost(v):
        return np.abs(v - np.sort(v)[(len(v) - 1) // 2]).sum()

    best = (cost(z) - 1e-9, None, None)
    for f in range(bins.shape[1]):
        for b in range(ht.BINS - 1):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) >= least:
                c = cost(z[left]) + cost(z[~left])
                if c < best[0] - 1e-9:
                    best = (c, f, b)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_exact_growth_equals_trying_all_splits(seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 6, (60, 3)).astype(np.uint8)
    z = np.sort(np.round(rng.normal(size=60) + (bins[:, 1] > 2), 1))
    tree = ht.grow_exact(bins, z, np.ones(60), {**FOREST, "max_depth": 2, "min_samples_leaf": 3}, 0)
    todo = [(0, np.arange(60), 0)]
    while todo:
        node, rows, level = todo.pop()
        want, f, b = plain_split(bins[rows], z[rows], 3)
        if tree.feature[node] < 0:
            assert f is None or level == 2
            assert tree.value[node] == np.sort(z[rows])[(len(rows) - 1) // 2]
            continue
        left = bins[rows, tree.feature[node]] <= tree.cut[node]
        got = sum(np.abs(z[r] - np.sort(z[r])[(len(r) - 1) // 2]).sum() for r in (rows[left], rows[~left]))
        assert got == pytest.approx(want)
        todo += [(tree.left[node], rows[left], level + 1), (tree.right[node], rows[~left], level + 1)]


@pytest.mark.parametrize("rows, decimals", [(2, 1), (37, 1), (900, 1), (900, 12)])
def test_runs_of_rows_give_the_split_of_single_rows(rows, decimals):
    rng = np.random.default_rng(rows)
    bins = rng.integers(0, ht.BINS, (rows, 5)).astype(np.uint8)
    bins[:, 3] = bins[:, 1]  # equal splits: the first feature wins
    values = np.sort(np.round(rng.standard_t(3, rows) + (bins[:, 1] > 9), decimals))
    weight = rng.integers(1, 4, rows).astype(float)
    counts = np.zeros((5, ht.BINS, rows))
    counts[np.arange(5)[:, None], bins.T, np.arange(rows)] = weight
    for leaf, split in ((1, 2), (4, 2), (10**6, 2), (1, 10**6)):
        assert ht.exact_split(bins, values, weight, leaf, split) == ht.absolute_split(counts, counts * values, values, leaf, split)


def test_all_target_edges_share_their_passes(spark, sample, monkeypatch):
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    monkeypatch.setattr(ht, "HELD_VALUES", 5)
    x, z = sample
    frame = rows_frame(spark, x, z)
    blocks, passes, total_of = ht.blocks_of(frame, ht.bin_edges(frame)), [], ht.total_of
    monkeypatch.setattr(ht, "total_of", lambda *a: passes.append(1) or total_of(*a))
    got = ht.MedianForest(FOREST)._target_edges(blocks)
    wanted = {np.sort(z)[max(int(np.ceil(k / ht.TARGET_BINS * len(z))) - 1, 0)] for k in range(1, ht.TARGET_BINS)}
    assert set(got) == wanted and len(passes) <= 3


@pytest.mark.parametrize("block_rows", [ht.BLOCK_ROWS, 50])
def test_one_split_forest_equals_brute_force(spark, sample, monkeypatch, block_rows):
    """With 50 rows a block the root and its children are too large for one task."""
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    x, z = sample
    z = np.round(z)  # few distinct targets: the target bins are exact
    model = ht.MedianForest(FOREST, block_rows=block_rows, bootstrap=False).fit(rows_frame(spark, x, z))
    bins = ht.to_bins(x, model.edges)
    cost, f, b = plain_split(bins, z)
    got = model.predict(x)
    assert np.abs(z - got).sum() == pytest.approx(cost)
    left = bins[:, f] <= b
    assert set(np.unique(got)) == {np.sort(v)[(len(v) - 1) // 2] for v in (z[left], z[~left])}


def test_large_nodes_are_split_before_rows_meet(spark, sample):
    x, z = sample
    params = {**FOREST, "n_estimators": 5, "max_depth": 6}
    whole = ht.MedianForest(params, seed=1).fit(rows_frame(spark, x, z))
    cut = ht.MedianForest(params, seed=1, block_rows=60).fit(rows_frame(spark, x, z))
    a, b = (np.abs(z - m.predict(x)).mean() for m in (whole, cut))
    base = np.abs(z - np.median(z)).mean()
    assert a < 0.75 * base and b < 0.8 * base and len(cut.trees) == 5


@pytest.mark.parametrize("local", [0, ht.LOCAL_ROWS])
def test_leaf_quantiles_are_exact(spark, monkeypatch, local):
    monkeypatch.setattr(ht, "HELD_VALUES", 5)
    monkeypatch.setattr(ht, "LOCAL_ROWS", local)
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [1e6, -1e6]])
    frame = rows_frame(spark, np.arange(len(z))[:, None] % 3, z, 4)
    blocks = ht.blocks_of(frame, ht.bin_edges(frame))

    def value_of(row):
        return np.frombuffer(row.bins, np.uint8).astype(np.int64), np.frombuffer(row.z)

    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = ht.leaf_quantiles(blocks, value_of, share)
        for leaf in range(3):
            own = np.sort(z[np.arange(len(z)) % 3 == leaf])
            assert got[leaf] == own[max(int(np.ceil(share * len(own))) - 1, 0)]


@pytest.mark.parametrize("loss, q, local", [("huber", 0.5, 0), ("quantile", 0.5, 0), ("huber", 0.5, 400), ("quantile", 0.9, 400)])
def test_loss_falls_every_round(spark, sample, monkeypatch, loss, q, local):
    monkeypatch.setattr(ht, "LOCAL_ROWS", local)  # at 0 every level is a job
    x, z = sample
    booster = ht.Booster(PARAMS, loss, q)
    model = booster.fit(rows_frame(spark, x, z))
    # the loss before each round, and the loss of the finished model
    own = [float(np.mean(booster.slopes(z, ht.BinnedModel(model.edges, model.trees[:k], model.start, model.weight).predict(x))[0])) for k in range(13)]
    np.testing.assert_allclose(model.losses, own[:12], rtol=1e-9)
    assert all(b < a for a, b in zip(own, own[1:]))
    start = np.sort(z)[int(np.ceil(q * len(z))) - 1]
    assert model.start == start
    if loss == "quantile":
        assert abs(np.mean(z <= model.predict(x)) - q) < 0.08


def test_first_boosted_tree_has_the_best_split(spark, sample):
    x, z = sample
    model = ht.Booster({**PARAMS, "n_estimators": 1, "max_depth": 1}, "huber").fit(rows_frame(spark, x, z))
    bins, r = ht.to_bins(x, model.edges), z - model.start
    g, h = r / np.sqrt(1 + r * r), (1 + r * r) ** -1.5
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {
        (f, b): score(bins[:, f] <= b) + score(bins[:, f] > b)
        for f in range(3) for b in range(ht.BINS - 1) if min(h[bins[:, f] <= b].sum(), h[bins[:, f] > b].sum()) >= 1
    }
    tree = model.trees[0]
    assert gains[tree.feature[0], tree.cut[0]] == pytest.approx(max(gains.values()))
    for leaf in (1, 2):
        own = tree.leaves_of(bins) == leaf
        assert tree.value[leaf] == pytest.approx(g[own].sum() / (h[own].sum() + 1))


def test_samples_of_rows_and_columns_repeat(spark, sample):
    x, z = sample
    params = {**PARAMS, "n_estimators": 4, "subsample": 0.7, "colsample_bytree": 0.7}
    frame = rows_frame(spark, x, z).coalesce(1)
    first, second = (ht.Booster(params, "huber").fit(frame).predict(x) for _ in range(2))
    np.testing.assert_array_equal(first, second)
    assert np.abs(first - ht.Booster({**params, "subsample": 1.0}, "huber").fit(frame).predict(x)).max() > 0


def test_held_and_distributed_tables_give_the_same_trees(spark, sample, monkeypatch):
    x, z = sample
    frame = rows_frame(spark, x, z).persist()
    held = [ht.Booster({**PARAMS, "subsample": 0.8}, loss).fit(frame).predict(x) for loss in ("huber", "quantile")]
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    for loss, want in zip(("huber", "quantile"), held):
        np.testing.assert_allclose(ht.Booster({**PARAMS, "subsample": 0.8}, loss).fit(frame).predict(x), want, rtol=1e-9)


def test_no_rows_and_constant_rows(spark):
    none = rows_frame(spark, np.zeros((1, 2)), [0.0]).where("z > 5")
    for estimator in (ht.Booster(PARAMS, "huber"), ht.MedianForest(FOREST)):
        assert np.isnan(estimator.fit(none).predict(np.zeros((2, 2)))).all()
    flat = rows_frame(spark, np.ones((30, 2)), np.full(30, 3.0))
    for estimator in (ht.Booster(PARAMS, "quantile"), ht.Booster(PARAMS, "huber"), ht.MedianForest(FOREST, bootstrap=False)):
        np.testing.assert_allclose(estimator.fit(flat).predict(np.ones((2, 2))), 3.0)


def test_default_variations_all_fit(spark):
    split = chrono_split(feature_table(panel_frame(spark, {"a": series(120, 1), "b": series(110, 2, "season")})))
    got = sweep.run_forecaster(split, "rf", [{"loss": "l2", "lags": 3, "n_estimators": 5}, {"loss": "l1", "lags": 5, "n_estimators": 5}, {"loss": "l2", "n_estimators": 6, "lags": 7}]).toPandas()
    got["model"] = "rf"
    third = trees.forecast_trees(split, "xgb", {"loss": "huber", "lags": 7, "n_estimators": 10}, 2).toPandas()
    assert set(got.variation) == {0, 1, 2} and got.yhat.notna().all() and third.yhat.notna().all()
    for rows in (got[got.variation == 1], third):
        for _, g in rows.groupby("series_id"):
            assert np.abs(g.y - g.yhat).mean() < 0.1 * np.abs(g.y).mean()


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_quantile_tree_takes_two_jobs_for_all_its_leaves(spark, sample, monkeypatch):
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    monkeypatch.setattr(ht, "HELD_VALUES", 20)
    frame = rows_frame(spark, *sample).persist()
    fits = [jobs_of(spark, f"fit-{n}", lambda: ht.Booster({**PARAMS, "n_estimators": n}, "quantile").fit(frame)) for n in (2, 6)]
    assert fits[1] - fits[0] <= 4 * (PARAMS["max_depth"] + 2)
    frame.unpersist()


@pytest.mark.parametrize("held", [2, 4096])
def test_first_bins_change_no_quantile(spark, sample, monkeypatch, held):
    """Whatever the bins were learned from: the same values, others, or values that are all equal."""
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    monkeypatch.setattr(ht, "HELD_VALUES", held)
    x, z = sample
    frame = rows_frame(spark, x, np.round(z, 1))
    blocks = ht.blocks_of(frame, ht.bin_edges(frame))
    value_of = lambda row: (ht.bins_of(row)[:, 1].astype(np.int64) % 3, np.frombuffer(row.z))
    wanted = ht.leaf_ranks(blocks, value_of, [0.1, 0.5, 0.99])
    for known in (np.sort(z), np.sort(z) + 3, np.sort(z) * 1e-3, np.zeros(9)):
        first = ht.FirstBins(32)
        first.leaves = 3
        first.learn(known, np.arange(len(known)))
        for _ in range(2):
            assert ht.leaf_ranks(blocks, value_of, [0.1, 0.5, 0.99], first) == wanted


@pytest.mark.parametrize("depth", [0, 1, 3, 7])
def test_trees_find_leaves_split_by_split_as_row_by_row(monkeypatch, depth):
    rng, tree, leaves = np.random.default_rng(depth), ht.Tree(), [0]
    for _ in range(depth):
        leaves = [child for x in leaves for child in tree.split(x, rng.integers(0, 4), rng.integers(0, 9))]
    tree.value = [float(v) for v in rng.normal(size=len(tree.value))]
    bins = rng.integers(0, 10, (300, 4)).astype(np.uint8)
    got = []
    for few in (0, 1000):
        monkeypatch.setattr(ht, "FEW_NODES", few)
        got.append((tree.leaves_of(bins), tree.predict(bins)))
    for a, b in zip(*got):
        assert a.dtype == b.dtype and (a == b).all()
