"""Chronological splits, holdouts and folds as columns of one table (never as copies)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.positions import SERIES, TS, number_rows


def chrono_split(features: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Add rn, n, n_train and is_train: the first floor(n * (1 - test_size)) rows train."""
    return (
        number_rows(features)
        .withColumn("n_train", F.floor(F.col("n") * F.lit(1 - test_size)).cast("bigint"))
        .withColumn("is_train", F.col("rn") < F.col("n_train"))
    )


def holdout_split(split: DataFrame, val_frac: float = 0.2) -> DataFrame:
    """Train rows only, with n_fit and role ('fit' or 'val'): the last part of train validates."""
    size = F.least(F.greatest(F.lit(1), F.floor(F.col("n_train") * F.lit(val_frac))), F.col("n_train") - 1)
    return (
        split.where("is_train")
        .withColumn("n_fit", (F.col("n_train") - size).cast("bigint"))
        .withColumn("role", F.when(F.col("rn") < F.col("n_fit"), "fit").otherwise("val"))
    )


def fold_start(fold, n_splits: int = 3):
    """First validation row of a fold: n_train - (n_splits - fold) * (n_train div (n_splits + 1))."""
    size = F.expr(f"n_train div {n_splits + 1}")
    return F.col("n_train") - (F.lit(n_splits) - fold) * size


def expanding_folds(split: DataFrame, n_splits: int = 3) -> DataFrame:
    """Train rows repeated once per fold they belong to, with fold and role columns.

    Every fold trains on all rows before its validation slice, so no fold sees the future.
    """
    size = F.expr(f"n_train div {n_splits + 1}")
    start = fold_start(F.col("fold"), n_splits)
    return (
        split.where(F.col("is_train") & (F.col("n_train") > n_splits))
        .withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(n_splits)])))
        .where(F.col("rn") < start + size)
        .withColumn("role", F.when(F.col("rn") < start, "fit").otherwise("val"))
    )


def dataset_profile(split: DataFrame) -> DataFrame:
    """Rows in total, train and test, and the time range of every series."""
    return split.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("is_train").alias("training_samples"),
        F.count_if(~F.col("is_train")).alias("testing_samples"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
    )


def seasonal_period(split: DataFrame) -> DataFrame:
    """Seasonal period by training length: above 104 rows 52, above 24 rows 12, else 4."""
    counted = split.where("is_train").groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_train"))
    return counted.withColumn("period", period_for_training())


PERIOD_SQL = "CASE WHEN n_train > 104 THEN 52 WHEN n_train > 24 THEN 12 ELSE 4 END"


def period_for_training():
    """The period as a column, from n_train."""
    return F.expr(PERIOD_SQL)


def train_tail(split: DataFrame, fraction: float = 0.15) -> DataFrame:
    """The last part of the training rows, starting at floor((1 - fraction) * n_train)."""
    start = F.floor(F.col("n_train") * F.lit(1 - fraction))
    return split.where(F.col("is_train") & (F.col("rn") >= start))


def mid_slice(split: DataFrame) -> DataFrame:
    """The middle half of the test rows: [mid - quarter, mid + quarter)."""
    step = F.col("rn") - F.col("n_train")
    n_test = F.col("n") - F.col("n_train")
    mid, quarter = F.floor(n_test / 2), F.floor(n_test / 4)
    return split.where(~F.col("is_train") & (step >= mid - quarter) & (step < mid + quarter))
