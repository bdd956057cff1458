"""Writing ranked tables, configurations, summaries and tuning candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.catalog import REPORT_COLUMNS
from tidewater.functions.configs import TUNED_NOTE
from tidewater.operators.metrics import finite
from tidewater.operators.positions import SERIES


def results_layout(df: DataFrame, dataset: str, run_date: str | None = None) -> DataFrame:
    """Add dataset and run_date, the folders every result is written under."""
    day = F.to_date(F.lit(run_date)) if run_date else F.current_date()
    return df.withColumns({"dataset": F.lit(dataset), "run_date": F.date_format(day, "yyyy-MM-dd")})


def _replace(df: DataFrame, *folders: str):
    """A writer that replaces only the folders it writes to; other datasets, dates and models stay."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders)


def _partitioned(df: DataFrame, dataset: str, run_date: str | None):
    return _replace(results_layout(df, dataset, run_date), "dataset", "run_date")


def write_comparison(ranked: DataFrame, path: str, dataset: str, run_date: str | None = None) -> None:
    """Ranked table as CSV, report columns in fixed order."""
    columns = [c for c in REPORT_COLUMNS if c in ranked.columns]
    ordered = ranked.select(SERIES, "rank", *columns).sortWithinPartitions(SERIES, "rank")
    _partitioned(ordered, dataset, run_date).option("header", True).csv(path)


def write_configs(configs: DataFrame, ranked: DataFrame, path: str, dataset: str, run_date: str | None = None) -> None:
    """The configuration of the best variation of every ranked model, as JSON lines; one without stays, without fields."""
    best = ranked.select(SERIES, "rank", "model_key", F.col("best_variation").alias("variation"))
    chosen = best.join(configs, [SERIES, "model_key", "variation"], "left").select(SERIES, "rank", "config.*")
    _partitioned(chosen.sortWithinPartitions(SERIES, "rank"), dataset, run_date).json(path)


def summary(profile: DataFrame, judged: DataFrame, ranked: DataFrame, best_per_run: DataFrame | None = None,
            tuned: DataFrame | None = None, source: dict[str, str] | None = None) -> DataFrame:
    """One nested row per series: dataset, recommendation, results, best per run, tuned parameters.

    Results carry their parameters (columns ``params``, ``hyperparameters``, ``hyperparameters_source``) and
    their deviations over runs (``composite_std``, ``rmse_std``) where ``ranked`` has them. ``source`` names the
    data file and its columns. Metrics that are infinite or not a number are null.
    """
    measured = [finite(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "mase", "mape")]
    spread = [F.round(c, 4).alias(c) for c in ("rmse_std", "composite_std") if c in ranked.columns]
    given = {"params": "variation_spec", "hyperparameters": "hyperparameters", "hyperparameters_source": "hyperparameters_source"}
    settings = [F.col(c).alias(name) for c, name in given.items() if c in ranked.columns]
    entry = F.struct("rank", "model", F.round("composite_score", 4).alias("composite_score"), *measured, *spread, *settings)
    named = {"file": "file", "time_col": "time_column", "data_col": "data_column"}
    origin = [F.lit(source[key]).alias(name) for key, name in named.items()] if source else []
    out = (
        profile.withColumn("dataset", F.struct(*origin, "total_samples", "training_samples", "testing_samples"))
        .select(SERIES, "dataset")
        .join(judged.select(SERIES, F.col("judgment").alias("best_judgment")), SERIES, "left")
        .join(ranked.groupBy(SERIES).agg(F.array_sort(F.collect_list(entry)).alias("results")), SERIES, "left")
    )
    if best_per_run is not None:
        run = F.struct("run", F.col("model").alias("best_model"), F.round("composite_score", 4).alias("composite_score"),
                       "rmse", "mae", "r2")
        per_run = best_per_run.groupBy(SERIES).agg(F.array_sort(F.collect_list(run)).alias("best_per_run"))
        out = out.join(per_run, SERIES, "left")
    if tuned is not None:
        pairs = tuned.groupBy(SERIES).agg(
            F.map_from_entries(F.collect_list(F.struct("model", "params"))).alias("tuned_best_params")
        )
        selection = F.struct(F.lit("rmse").alias("metric"), F.lit(TUNED_NOTE).alias("note"))
        chosen = F.when(F.col("tuned_best_params").isNotNull(), selection)
        out = out.join(pairs, SERIES, "left").withColumn("parameter_selection", chosen)
    return out


def write_summary(rows: DataFrame, path: str, dataset: str, run_date: str | None = None) -> None:
    _partitioned(rows.withColumnRenamed("dataset", "data"), dataset, run_date).json(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Tuning candidates, best first within every series, one folder per model."""
    ordered = candidates.repartition("model_key", SERIES).sortWithinPartitions("model_key", SERIES, "rmse")
    _replace(ordered, "model_key").parquet(path)


def validation_summary(candidates: DataFrame) -> DataFrame:
    """Best parameters and score of every series and model."""
    w = Window.partitionBy(SERIES, "model_key").orderBy(finite(F.col("rmse")).asc_nulls_last(), "candidate_no")
    return candidates.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(
        SERIES, "model_key", F.col("params").alias("best_params"), F.col("rmse").alias("validation_score"),
        F.lit("rmse").alias("selection_metric"), F.lit(True).alias("refit_on_full_train"),
    )
