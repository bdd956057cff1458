"""The rows of a pooled fit lie in as many partitions as the cores keep busy, however many a shuffle has."""

import pytest

from tidewater.forecast import histogram_trees, trees


class Spy:
    def __init__(self, estimator, seen):
        self.estimator, self.seen = estimator, seen

    def fit(self, rows):
        self.seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return self.estimator.fit(rows)


@pytest.fixture
def seen(spark, monkeypatch):
    """(partitions, rows) of every fit, with many more shuffle partitions than cores."""
    out = []
    for key, made in list(trees.BUILDERS.items()):
        monkeypatch.setitem(trees.BUILDERS, key, lambda *a, made=made: Spy(made(*a), out))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield out
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tuned_fits_have_few_partitions_and_all_rows(spark, dated_split, seen):
    trees.tree_candidates(dated_split, "rf", grid={"n_estimators": [2], "max_depth": [2]})
    known = [(n, n // 4) for n in (r["n_train"] for r in dated_split.select("series_id", "n_train").distinct().collect())]
    assert sorted(rows for _, rows in seen) == sorted(sum(n - (3 - fold) * size for n, size in known) for fold in range(3))
    assert max(parts for parts, _ in seen) <= trees.CORE_PARTITIONS * spark.sparkContext.defaultParallelism


def test_a_pooled_fit_has_few_partitions_and_all_rows(spark, dated_split, seen):
    trees.fit_trees(dated_split, "rf", "l2", 3, {"n_estimators": 2, "max_depth": 2})
    [(parts, rows)] = seen
    assert rows == dated_split.where("is_train").count()
    assert parts <= trees.CORE_PARTITIONS * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("loss", ["huber", "quantile"])
def test_boosting_has_few_blocks(spark, dated_split, seen, monkeypatch, loss):
    blocks, write = [], histogram_trees.blocks_of
    monkeypatch.setattr(histogram_trees, "blocks_of", lambda *a: blocks.append(write(*a)) or blocks[-1])
    trees.fit_trees(dated_split, "xgb", loss, 7, {"n_estimators": 2})
    [(parts, rows)], [made] = seen, blocks
    assert rows == dated_split.where("is_train").count() == sum(r["n"] for r in made.frame.collect())
    assert made.count <= parts <= trees.CORE_PARTITIONS * spark.sparkContext.defaultParallelism
