"""Forests on absolute error over large nodes: what a task holds doesn't grow with the blocks of a partition."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector

from tidewater.forecast import histogram_trees as ht

PARAMS = {"n_estimators": 6, "max_depth": 4, "min_samples_split": 2, "min_samples_leaf": 1}


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(ht, "LOCAL_ROWS", 0)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    z = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + rng.standard_t(2, 3000)
    frame = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, z)], "x array<double>, z double").coalesce(1)
    return frame.withColumn("vector", array_to_vector("x")).select("vector", "z")


def test_draws_of_a_block_take_a_byte_each():
    forest, row = ht.MedianForest({**PARAMS, "n_estimators": 100}, 7), SimpleNamespace(block=3, n=65_536)
    tracemalloc.start()
    drawn = forest.weights(row, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    np.testing.assert_array_equal(drawn, np.random.default_rng([7, 3]).poisson(1.0, (65_536, 100)))


def test_blocks_reach_tasks_a_few_at_a_time(spark, rows, monkeypatch):
    monkeypatch.setattr(ht, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ht, "BATCH_BYTES", "1k")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        blocks = ht.blocks_of(rows, ht.bin_edges(rows))
        drawn = ht.MedianForest(PARAMS)._drawn(blocks, 6)
        assert blocks.count > 15
        sizes = drawn.frame.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int").collect()
        assert sum(r["n"] for r in sizes) == blocks.count and max(r["n"] for r in sizes) == 1
        files = drawn.frame.inputFiles()
        assert len(files) == blocks.count  # nor does the reader take them together
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def test_many_large_nodes_are_split_in_one_job(spark, rows):
    def jobs(trees):
        group = f"split-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        model = ht.MedianForest({**PARAMS, "n_estimators": trees}, block_rows=400).fit(rows)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert all(len(t.feature) > 7 for t in model.trees)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(30) <= jobs(2) + 6  # 30 roots alone took four jobs


@pytest.mark.parametrize("cells", [1, 1 << 30])
def test_features_added_up_apart_give_the_same_split(monkeypatch, cells):
    rng = np.random.default_rng(1)
    bins, values, weight = rng.integers(0, ht.BINS, (500, 5)).astype(np.uint8), np.sort(rng.normal(size=500)), rng.integers(1, 4, 500).astype(float)
    want = ht.exact_split(bins, values, weight, 1, 2)
    monkeypatch.setattr(ht, "SPLIT_CELLS", cells)
    assert ht.exact_split(bins, values, weight, 1, 2) == want is not None
