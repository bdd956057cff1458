"""Forests of a grid that share their trees, against plain searches and fits of single candidates."""

import numpy as np
import pytest
from conftest import panel_frame, series
from pyspark.ml.functions import array_to_vector

from tidewater.forecast import grid_forest as gf
from tidewater.forecast import histogram_trees as ht
from tidewater.forecast import trees
from tidewater.operators.features import feature_table
from tidewater.operators.splits import chrono_split
from tidewater.workloads import model_queries


def plain(bins, z, w, leaf, split, depth):
    """Predictions of the tree that tries all cuts of a node, node after node."""
    out, todo = np.zeros(len(z)), [(np.arange(len(z)), 0)]
    while todo:
        rows, level = todo.pop()
        n, s = w[rows].sum(), (w[rows] * z[rows]).sum()
        out[rows] = s / n
        best = (s * s / n + 1e-9, None)
        if n < split or level >= depth:
            continue
        for b in bins:
            for cut in np.unique(b[rows])[:-1]:
                goes = b[rows] <= cut
                sides = [(w[r].sum(), (w[r] * z[r]).sum()) for r in (rows[goes], rows[~goes])]
                gain = sum(t * t / m for m, t in sides)
                if min(m for m, _ in sides) >= leaf and gain > best[0] + 1e-10:
                    best = (gain, goes)
        if best[1] is not None:
            todo += [(rows[best[1]], level + 1), (rows[~best[1]], level + 1)]
    return out


@pytest.mark.parametrize("leaf", [1, 2, 4])
def test_one_tree_holds_those_of_all_limits(leaf):
    rng = np.random.default_rng(leaf)
    bins, w = rng.integers(0, 9, (4, 150)).astype(np.uint8), rng.integers(1, 4, 150)
    z = rng.normal(size=150) + (bins[1] > 5)
    tree, limits = gf.grow_mean(bins, z, w, leaf), [(d, s) for d in (2, 5, np.inf) for s in (2, 5, 10)]
    got = gf.limited_values(tree, limits)[tree.leaves_of(bins.T)]
    for i, (depth, split) in enumerate(limits):
        np.testing.assert_allclose(got[:, i], plain(bins, z, w, leaf, split, depth))


GRID = {"n_estimators": [2, 6], "max_depth": [None, 2], "min_samples_split": [2, 12], "min_samples_leaf": [1, 3]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 1)
    z = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + rng.normal(size=400)
    frame = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, z))], "i int, x array<double>, z double")
    return frame.coalesce(2).withColumn("vector", array_to_vector("x")).drop("x").persist()


def predicted(model, rows):
    return np.array([r["zhats"] for r in model.transform_all(rows.select("i", "vector")).orderBy("i").collect()])


def test_candidates_of_a_grid_are_those_of_single_fits(rows):
    candidates = trees.grid_candidates(GRID)
    got = predicted(trees.shared_forest(candidates).fit(rows), rows)
    assert got.shape == (400, 16) and len(np.unique(np.round(got, 9), axis=1).T) == 10  # at depth 2 no node is small
    for i in (0, 3, 6, 9, 15):
        alone = predicted(trees.shared_forest(candidates[i]).fit(rows), rows)
        np.testing.assert_allclose(alone[:, 0], got[:, i])


def test_large_nodes_are_split_by_sums_like_small_ones(rows, monkeypatch):
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    monkeypatch.setattr(gf, "JOB_NODES", 5)
    candidates = [{**trees.FOREST, **p} for p in trees.grid_candidates(GRID)]
    whole, cut = (gf.GridForest(candidates, node_rows=n).fit(rows) for n in (1000, 60))
    assert not whole.tops and max(len(top.feature) for top, _ in cut.tops.values()) > 9
    np.testing.assert_allclose(predicted(cut, rows), predicted(whole, rows))
    single = [gf.GridForest([{**trees.FOREST, "n_estimators": 3, "max_depth": 4}], node_rows=n).fit(rows) for n in (1000, 60)]
    a, b = (m.featureImportances.toArray() for m in single)
    np.testing.assert_allclose(a, b)
    assert a.sum() == pytest.approx(1) and a[0] > 0.5


def test_a_large_node_without_a_split_stays_a_leaf(rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    flat = rows.withColumn("z", F.lit(3.0))
    np.testing.assert_allclose(predicted(gf.GridForest([{**trees.FOREST, "n_estimators": 2}], node_rows=50).fit(flat), rows), 3.0)
    none = gf.GridForest([{**trees.FOREST, "n_estimators": 2}]).fit(rows.where("z > 99"))
    assert none.transform(rows).where("zhat is not null").count() == 0


def test_tuning_covers_the_whole_grid(spark, monkeypatch):
    """The query scored 4 of the 108 candidates."""
    seen, listed = [], trees.grid_candidates

    class Stop(Exception):
        pass

    def spy(grid):
        seen.extend(listed(grid))
        raise Stop

    split = chrono_split(feature_table(panel_frame(spark, {"a": series(80, 1), "b": series(70, 2)})))
    monkeypatch.setattr(model_queries, "suppliers", lambda *_: split)
    monkeypatch.setattr(trees, "grid_candidates", spy)
    with pytest.raises(Stop):
        model_queries.QUERIES["tune_forest"](spark, "")
    assert seen == listed(trees.FOREST_GRID) and len(seen) == 108


def test_scores_are_those_of_each_fold_alone(spark):
    split = chrono_split(feature_table(panel_frame(spark, {"a": series(80, 1), "b": series(70, 2, "season")}))).persist()
    got = trees.tree_candidates(split, "rf", grid={**GRID, "min_samples_leaf": [1]}).toPandas()
    assert len(got) == 2 * 8 * 3 and got.rmse.notna().all()
    for _, same in got.groupby(["series_id", "fold"]):
        assert same.candidate_no.tolist() != [] and same.rmse.nunique() > 2
    std = {r["series_id"]: r["y_std"] for r in trees.vectors(split, None).select("series_id", "y_std").distinct().collect()}
    np.testing.assert_allclose(got.rmse, got.scaled * got.series_id.map(std))
