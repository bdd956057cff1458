"""A forest that keeps the node of every row is the forest that walks down from the root."""

import pytest
from pyspark.ml.regression import RandomForestRegressor

from tidewater.forecast import trees


@pytest.mark.parametrize("kept", [0, 1 << 30])
def test_kept_nodes_change_no_tree(dated_split, monkeypatch, kept):
    monkeypatch.setattr(trees, "KEPT_NODES", kept)
    asked, set_ids = [], RandomForestRegressor.setCacheNodeIds
    monkeypatch.setattr(RandomForestRegressor, "setCacheNodeIds", lambda self, value: asked.append(value) or set_ids(self, value))
    made = trees.fit_trees(dated_split, "rf", "l2", 3, {"n_estimators": 8, "max_depth": 6})
    assert asked == [kept > 0]
    plain = RandomForestRegressor(
        featuresCol="vector", labelCol="z", predictionCol="zhat", seed=trees.SEED, featureSubsetStrategy="all", numTrees=8, maxDepth=6
    )
    rows = trees.vectors(dated_split, 3).where("is_train").select("series_id", "rn", "vector", "z")
    want = plain.fit(trees.dealt(rows, dated_split).select("vector", "z").persist())
    assert made.toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1] and made.totalNumNodes > 100
