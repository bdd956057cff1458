"""Random forests and boosted trees: one MLlib model over all series of the panel.

Features and target are put in units of each series' training mean and deviation, so that series of
different size share one model; with a single series this is the per-series model. MLlib spreads the
rows of every fit over the cluster. Losses that it lacks (absolute error in forests, pseudo-Huber and
quantile in boosting) are grown on histograms, in the same units. So are forests on squared error that
are tuned: the candidates of a grid share their trees.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.forecast.common import ONE_STEP, forecast_rows
from tidewater.forecast.grid_forest import GridForest
from tidewater.forecast.histogram_trees import Booster, MedianForest
from tidewater.forecast.linear import standardised
from tidewater.operators.features import feature_names
from tidewater.operators.positions import SERIES
from tidewater.operators.splits import fold_start
from tidewater.session import scratch_path

# Seed, depths, rounds, rates and the two tuning grids.
SEED = 42
FOREST = {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1}
BOOSTED = {
    "n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_child_weight": 1, "subsample": 1.0,
    "colsample_bytree": 1.0,
}
FOREST_GRID = {
    "n_estimators": [50, 100, 200],
    "max_depth": [None, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
}
BOOSTED_GRID = {
    "n_estimators": [50, 100, 200],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "max_depth": [3, 4, 5, 6],
    "min_child_weight": [1, 2, 4],
    "subsample": [0.8, 0.9, 1.0],
    "colsample_bytree": [0.8, 0.9, 1.0],
}
# Partitions per core of the rows of a fit, and the rows beyond which a partition is not filled up further.
CORE_PARTITIONS, PARTITION_ROWS = 2, 1 << 20
# MLlib grows no deeper; an unlimited depth means this one.
DEEPEST = 30
GBT_LOSS = {"l2": "squared", "l1": "absolute"}


# Sums of nodes that are split together: few enough to stay near the cores. Row and tree pairs up to which a forest keeps
# the node of every row, four bytes each, instead of walking down from the root at every level.
SUMS_MB, KEPT_NODES = 64, 1 << 30


class PooledForest(RandomForestRegressor):
    """MLlib's forest: the same trees, the sooner the fewer rows walk."""

    def _fit(self, rows: DataFrame):
        self.setCacheNodeIds(rows.count() * self.getNumTrees() <= KEPT_NODES)
        return super()._fit(rows)


def grid_candidates(grid: dict[str, list]) -> list[dict]:
    """Parameter combinations, first name slowest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def forest(params: dict, loss: str = "l2") -> RandomForestRegressor | MedianForest:
    p = {**FOREST, **params}
    p["max_depth"] = min(p["max_depth"] or DEEPEST, DEEPEST)
    if loss == "l1":
        return MedianForest(p, SEED)
    if loss != "l2":
        raise ValueError("forests know the losses l2, l1")
    # MLlib sets a minimum per child only; half of the minimum to split is the closest it has.
    leaf = max(p["min_samples_leaf"], p["min_samples_split"] // 2)
    return PooledForest(
        featuresCol="vector", labelCol="z", predictionCol="zhat", seed=SEED, featureSubsetStrategy="all",
        numTrees=p["n_estimators"], maxDepth=p["max_depth"],
        minInstancesPerNode=leaf, maxMemoryInMB=SUMS_MB,
    )


def boosted(params: dict, loss: str = "l2") -> GBTRegressor | Booster:
    p = {**BOOSTED, **params}
    if loss in ("huber", "quantile"):
        return Booster(p, loss, seed=SEED)
    if loss not in GBT_LOSS:
        raise ValueError(f"boosted trees know the losses {', '.join(GBT_LOSS)}, huber, quantile")
    share = p["colsample_bytree"]
    return GBTRegressor(
        featuresCol="vector", labelCol="z", predictionCol="zhat", seed=SEED, lossType=GBT_LOSS[loss],
        maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"],
        minInstancesPerNode=p["min_child_weight"], subsamplingRate=p["subsample"],
        featureSubsetStrategy="all" if share >= 1 else str(share),
    )


def shared_forest(params: dict | list[dict], loss: str = "l2") -> GridForest:
    """The forests of one or many candidates, which share their trees."""
    if loss != "l2":
        raise ValueError("forests share trees on the loss l2")
    return GridForest([{**FOREST, **p} for p in ([params] if isinstance(params, dict) else params)], SEED)


# Estimators by model key; "rf_grid" are the forests of a grid.
BUILDERS = {"rf": forest, "xgb": boosted, "rf_grid": shared_forest}


def columns_for(lags: int | None) -> list[str]:
    return [c for c in feature_names() if not (lags and c.startswith("lag_") and int(c[4:]) > lags)]


def vectors(split: DataFrame, lags: int | None) -> DataFrame:
    return standardised(split, columns_for(lags)).withColumn("vector", array_to_vector("x")).drop("x")


def dealt(rows: DataFrame, split: DataFrame) -> DataFrame:
    """The rows of a fit, which are training rows of ``split``, in partitions by hash. Every partition hands on sums for
    all nodes of a level, however few its rows, so that what is shuffled grows with their number: the cores decide it,
    and the rows only where there are very many."""
    spark = split.sparkSession
    parts = max(CORE_PARTITIONS * spark.sparkContext.defaultParallelism, -(-split.where("is_train").count() // PARTITION_ROWS))
    return rows.repartition(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), SERIES, "rn")


def fit_trees(split: DataFrame, model_key: str, loss: str = "l2", lags: int | None = None, params: dict | None = None):
    """Fit one pooled model on all training rows."""
    estimator = BUILDERS[model_key](params or {}, loss)
    rows = vectors(split, lags).where("is_train").select(SERIES, "rn", "vector", "z")
    train = dealt(rows, split).select("vector", "z").persist()
    try:
        return estimator.fit(train)
    finally:
        train.unpersist()


def predict_trees(split: DataFrame, model, model_key: str, variation: int, lags: int | None = None) -> DataFrame:
    rows = model.transform(vectors(split, lags).where("not is_train")).withColumn("variation", F.lit(variation))
    return forecast_rows(rows, model_key, F.col("y_mean") + F.col("y_std") * F.col("zhat"), ONE_STEP)


def forecast_trees(split: DataFrame, model_key: str, spec: dict, variation: int = 0) -> DataFrame:
    """One variation such as {"loss": "l2", "lags": 3, "n_estimators": 200}."""
    params = {k: v for k, v in spec.items() if k not in ("loss", "lags")}
    model = fit_trees(split, model_key, spec.get("loss", "l2"), spec.get("lags"), params)
    return predict_trees(split, model, model_key, variation, spec.get("lags"))


def feature_importance(spark: SparkSession, model, lags: int | None = None, top: int = 20) -> DataFrame:
    """Importance of every feature, largest first."""
    rows = [(c, float(v)) for c, v in zip(columns_for(lags), model.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)


def tree_candidates(
    split: DataFrame, model_key: str, loss: str = "l2", grid: dict | None = None, n_splits: int = 3, parallel: int = 4,
) -> DataFrame:
    """RMSE of every candidate per series and expanding fold: (series_id, candidate_no, params, fold, rmse, scaled).

    Folds are cut per series, every candidate is one pooled fit per fold, and the fits are submitted a
    few at a time. Forests on squared error take one fit per fold for all candidates.
    """
    candidates = grid_candidates(grid or (FOREST_GRID if model_key == "rf" else BOOSTED_GRID))
    size = F.expr(f"n_train div {n_splits + 1}")
    usable = vectors(split, None).where(F.col("is_train") & (F.col("n_train") > n_splits))
    rows = dealt(usable, split).persist()

    path = scratch_path(split.sparkSession, f"{model_key}-candidates")
    if (model_key, loss) == ("rf", "l2"):
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            list(pool.map(lambda fold: _score_forests(rows, candidates, fold, n_splits, f"{path}/fold={fold}"), range(n_splits)))
        rows.unpersist()
        return split.sparkSession.read.parquet(path).select(SERIES, "candidate_no", "params", "fold", "rmse", "scaled")

    def score(task):
        number, params, fold = task
        start = fold_start(F.lit(fold), n_splits)
        model = BUILDERS[model_key](params, loss).fit(rows.where(F.col("rn") < start).select("vector", "z"))
        held = model.transform(rows.where((F.col("rn") >= start) & (F.col("rn") < start + size)))
        err = F.col("y_std") * (F.col("z") - F.col("zhat"))
        complete = F.count("zhat") == F.count("z")
        scores = held.groupBy(SERIES).agg(
            F.when(complete, F.sqrt(F.avg(err * err))).alias("rmse"), F.when(complete, F.sqrt(F.avg(err * err)) / F.any_value("y_std")).alias("scaled")
        )
        scores.withColumn("params", F.lit(json.dumps(params))).write.parquet(f"{path}/candidate_no={number}/fold={fold}")

    tasks = [(i, p, f) for i, p in enumerate(candidates) for f in range(n_splits)]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        list(pool.map(score, tasks))
    rows.unpersist()
    written = split.sparkSession.read.parquet(path)
    return written.select(SERIES, "candidate_no", "params", "fold", "rmse", "scaled")


def _score_forests(rows: DataFrame, candidates: list[dict], fold: int, n_splits: int, path: str) -> None:
    """Write the errors of all candidates of a forest in one fold."""
    start, size = fold_start(F.lit(fold), n_splits), F.expr(f"n_train div {n_splits + 1}")
    train = rows.where(F.col("rn") < start).sortWithinPartitions(SERIES, "rn").select("vector", "z")
    model = BUILDERS["rf_grid"](candidates, "l2").fit(train)
    held = model.transform_all(rows.where((F.col("rn") >= start) & (F.col("rn") < start + size)))
    complete = F.count("zhats") == F.count("z")
    errors = [F.col("y_std") * (F.col("z") - F.col("zhats")[i]) for i in range(len(candidates))]
    scores = held.groupBy(SERIES).agg(
        F.any_value("y_std").alias("y_std"),
        F.array(*[F.when(complete, F.sqrt(F.avg(err * err))) for err in errors]).alias("errors"),
    )
    names = F.array(*[F.lit(json.dumps(p)) for p in candidates])
    scores.select(SERIES, "y_std", F.posexplode("errors").alias("candidate_no", "rmse")).select(
        SERIES, "candidate_no", names[F.col("candidate_no")].alias("params"), "rmse", (F.col("rmse") / F.col("y_std")).alias("scaled")
    ).write.parquet(path)


def best_tree_params(candidates: DataFrame) -> dict:
    """The pooled model has one parameter set: lowest RMSE averaged over series and folds, each in units of
    its series' training deviation, so that no series decides by its size."""
    ranked = candidates.where("scaled is not null").groupBy("candidate_no", "params").agg(F.avg("scaled").alias("scaled"))
    return json.loads(ranked.orderBy("scaled", "candidate_no").select("params").first()[0])


def tune_trees(
    split: DataFrame, model_key: str, loss: str = "l2", grid: dict | None = None, n_splits: int = 3, parallel: int = 4
):
    """(candidates per series and fold, forecasts, fitted model) with the best parameters refitted."""
    candidates = tree_candidates(split, model_key, loss, grid, n_splits, parallel)
    best = best_tree_params(candidates)
    model = fit_trees(split, "rf_grid" if (model_key, loss) == ("rf", "l2") else model_key, loss, None, best)
    forecasts = predict_trees(split, model, model_key, 0).withColumn("params", F.lit(json.dumps(best)))
    return candidates, forecasts, model
