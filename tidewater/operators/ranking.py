"""Composite scores, ranks and run/variation aggregates over metric rows.

A metric row is one (series, model, variation, run); a ranking set holds at most models x variations
x runs rows, so windows over a series are bounded by the model registry and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.metrics import METRICS, finite, no_nan
from tidewater.operators.positions import SERIES

MASE_CAP, MAPE_CAP = 10.0, 200.0
TIE = 1e-9
SCORES = ["s_rmse", "s_mae", "s_r2", "s_mase", "s_mape"]


def clip_metric(value: Column, cap: float) -> Column:
    """Infinity becomes missing, then values are capped."""
    value = finite(value)
    return F.when(value.isNotNull(), F.least(value, F.lit(cap)))


def mean_of_present(columns: list[Column]) -> Column:
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(present > 0, total / present)


def score_columns(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Five 0-1 scores (1 is best), min-max normalised inside every ranking set."""
    w = Window.partitionBy(*by)
    present = [c for c in METRICS if c in metrics.columns]
    missing = F.lit(None).cast("double")
    clean = metrics.withColumns(
        {
            **{c: no_nan(F.col(c)) for c in present},
            "_mase": clip_metric(F.col("mase"), MASE_CAP) if "mase" in present else missing,
            "_mape": clip_metric(F.col("mape"), MAPE_CAP) if "mape" in present else missing,
        }
    )

    def span(c):
        return F.min(c).over(w), F.max(c).over(w)

    def apart(lo, hi):
        # Values that differ only by the order their sums were taken in count as equal.
        return hi - lo > TIE * F.greatest(F.abs(hi), F.abs(lo))

    def low_is_good(c):
        lo, hi = span(c)
        return F.when(apart(lo, hi), 1 - (F.col(c) - lo) / (hi - lo)).otherwise(1.0)

    def low_is_good_or_neutral(c):
        lo, hi = span(c)
        graded = F.when(apart(lo, hi), 1 - (F.col(c) - lo) / (hi - lo)).otherwise(1.0)
        return F.when(F.col(c).isNull(), 0.5).otherwise(graded)

    lo, hi = span("r2")
    return clean.withColumns(
        {
            "s_rmse": low_is_good("rmse"),
            "s_mae": low_is_good("mae"),
            "s_r2": F.when(apart(lo, hi), (F.col("r2") - lo) / (hi - lo)).otherwise(
                F.when(hi >= 0, 1.0).otherwise(0.0)
            ),
            "s_mase": low_is_good_or_neutral("_mase"),
            "s_mape": low_is_good_or_neutral("_mape"),
        }
    ).drop("_mase", "_mape")


def composite_score(metrics: DataFrame, by: list[str] | None = None, keep_scores: bool = False) -> DataFrame:
    """Equal-weight mean of the five scores, skipping missing ones."""
    scored = score_columns(metrics, by or [SERIES]).withColumn(
        "composite_score", mean_of_present([F.col(c) for c in SCORES])
    )
    return scored if keep_scores else scored.drop(*SCORES)


def _tie_break(df: DataFrame) -> list[str]:
    return [c for c in ("model", "model_key", "variation", "run") if c in df.columns]


def rank_models(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rank 1 is the best composite score (lowest rmse where there is no composite column)."""
    # Rounded, so that equal composites fall to the tie-break whatever order their sums were taken in.
    if "composite_score" in scored.columns:
        best = F.round("composite_score", 9).desc_nulls_last()
    else:
        best = F.col("rmse").asc_nulls_last()
    w = Window.partitionBy(*(by or [SERIES])).orderBy(best, *_tie_break(scored))
    return scored.withColumn("rank", F.row_number().over(w))


def top_k(ranked: DataFrame, k: int = 3) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def lead_margin(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best row of every set with its composite lead over the second (NULL when alone)."""
    w = Window.partitionBy(*(by or [SERIES])).orderBy("rank")
    gap = F.col("composite_score") - F.lead("composite_score").over(w)
    return ranked.withColumn("margin", gap).where(F.col("rank") == 1)


def aggregate_runs(metrics: DataFrame, with_composite_std: bool = False) -> DataFrame:
    """Mean of every metric over runs and the population deviation of rmse (0 for one run).

    ``with_composite_std`` adds the deviation of the per-run composite in the same pass. A column
    ``error`` stays for variations that failed in every run; the other runs of a variation count.
    """
    keys = [c for c in (SERIES, "model", "model_key", "variation") if c in metrics.columns]

    def deviation(value):
        return F.when(F.count(value) > 1, F.stddev_pop(value)).otherwise(0.0)

    extra = []
    if with_composite_std:
        by_name = Window.partitionBy(SERIES, "run", "model").orderBy("model_key", "variation")
        own = F.col("composite_score")
        if "error" in metrics.columns:
            own = F.when(F.col("error").isNull(), own)
        first = F.first(own, ignorenulls=True).over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        metrics = run_composites(metrics).withColumn("_run_score", first)
        extra = [deviation(F.col("_run_score")).alias("composite_std")]
    if "error" in metrics.columns:
        extra.append(F.when(F.count_if(F.col("error").isNull()) == 0, F.max("error")).alias("error"))
    return metrics.groupBy(*keys).agg(
        *[F.avg(no_nan(F.col(c))).alias(c) for c in METRICS if c in metrics.columns],
        deviation(no_nan(F.col("rmse"))).alias("rmse_std"),
        *extra,
    )


def run_composites(metrics: DataFrame) -> DataFrame:
    """Composite scores with every run as its own ranking set."""
    return composite_score(metrics, [SERIES, "run"])


def run_composite_lookup(metrics: DataFrame) -> DataFrame:
    """Per run, the composite of a model name; a name that occurs twice gives its first row."""
    first = F.min_by("composite_score", F.struct("model_key", "variation"))
    return run_composites(metrics).groupBy(SERIES, "run", "model").agg(first.alias("composite_score"))


def composite_std(metrics: DataFrame) -> DataFrame:
    """Population deviation over runs of the per-run composite of every model name."""
    score = F.col("composite_score")
    return run_composite_lookup(metrics).groupBy(SERIES, "model").agg(
        F.when(F.count(score) > 1, F.stddev_pop(score)).otherwise(0.0).alias("composite_std")
    )


def mean_prediction(forecasts: DataFrame) -> DataFrame:
    """Mean forecast over runs per series, model, variation and time."""
    keys = [c for c in (SERIES, "model", "model_key", "variation", "ts") if c in forecasts.columns]
    extra = [F.any_value(c).alias(c) for c in ("y", "rn", "forecast_mode") if c in forecasts.columns]
    return forecasts.groupBy(*keys).agg(*extra, F.avg("yhat").alias("yhat"))


def best_per_run(metrics: DataFrame) -> DataFrame:
    """The top composite row of every run."""
    return rank_models(run_composites(metrics), [SERIES, "run"]).where(F.col("rank") == 1).drop("rank")


def _medians(scored: DataFrame) -> list[Column]:
    names = ("composite_score", *METRICS, "rmse_std", "composite_std")
    return [F.median(no_nan(F.col(c))).alias(c) for c in names if c in scored.columns and c != "mse"]


def _best_variation() -> Column:
    order = F.struct(F.round("composite_score", 9), -F.col("variation"))
    return F.max_by("variation", order).alias("best_variation")


def median_by_model(scored: DataFrame, name: str = "model") -> DataFrame:
    """Median of every metric over the variations that share a name."""
    return scored.groupBy(SERIES, name).agg(*_medians(scored))


def best_variation(scored: DataFrame, name: str = "model") -> DataFrame:
    """The variation with the highest composite per name; the first one on ties."""
    return scored.groupBy(SERIES, name).agg(_best_variation())


def merge_variations(scored: DataFrame) -> DataFrame:
    """Medians, model key and best variation per model name, in one aggregation."""
    return scored.groupBy(SERIES, "model").agg(
        F.min("model_key").alias("model_key"), _best_variation(), *_medians(scored)
    )


def best_by_family(ranked: DataFrame) -> DataFrame:
    """The first-ranked model of every family."""
    w = Window.partitionBy(SERIES, "family").orderBy("rank")
    return ranked.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the lowest rmse per key; the earliest one on ties."""
    order = F.struct("rmse", "candidate_no")
    usable = candidates.where(finite(F.col("rmse")).isNotNull())
    return usable.groupBy(*keys).agg(
        F.min_by("candidate_no", order).alias("candidate_no"),
        F.min_by("params", order).alias("params"),
        F.min("rmse").alias("rmse"),
    )


def mark_chosen(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Flag every candidate whose score equals the best one to within 1e-9."""
    best = F.min(finite(F.col("rmse"))).over(Window.partitionBy(*keys))
    return candidates.withColumn("chosen", F.coalesce(F.abs(F.col("rmse") - best) < 1e-9, F.lit(False)))


def score_back_to_rows(metrics: DataFrame, scored: DataFrame) -> DataFrame:
    """Put composite scores computed elsewhere back on metric rows by key."""
    keys = [c for c in (SERIES, "model_key", "variation", "run") if c in metrics.columns]
    return metrics.join(scored.select(*keys, "composite_score"), keys, "left")
