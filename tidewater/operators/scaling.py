"""Scalers fitted on training rows, applied to all rows, and undone on forecasts.

Every scaler is x * mul + add with one (mul, add) pair per series and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.positions import SERIES
from tidewater.operators.quantiles import exact_quantiles

SCALERS = ("standard", "minmax", "robust", "none")


def _checked(kind: str | None) -> str:
    name = (kind or "standard").lower().strip()
    if name not in SCALERS:
        raise ValueError(f"unknown scaler {name!r}; choose one of {', '.join(SCALERS)}")
    return name


def _long(rows: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    return rows.select(SERIES, F.explode(pairs).alias("_p")).select(SERIES, "_p.column", "_p.x")


def fit_scaler(
    train: DataFrame, columns: list[str], kind: str | None = "standard", feature_range: tuple = (0, 1)
) -> DataFrame:
    """(series_id, column, mul, add) fitted on the given rows."""
    name = _checked(kind)
    long = _long(train, columns)
    keys = [SERIES, "column"]
    if name == "robust":
        q = exact_quantiles(long, keys, "x", [0.25, 0.5, 0.75])
        at = {p: F.max(F.when(F.col("prob") == p, F.col("value"))) for p in (0.25, 0.5, 0.75)}
        stats = q.groupBy(*keys).agg(at[0.5].alias("_centre"), (at[0.75] - at[0.25]).alias("_spread"))
    elif name == "standard":
        stats = long.groupBy(*keys).agg(F.avg("x").alias("_centre"), F.stddev_pop("x").alias("_spread"))
    elif name == "minmax":
        lo, hi = feature_range
        ranges = long.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
        mul = F.lit(float(hi - lo)) / width
        return ranges.select(*keys, mul.alias("mul"), (F.lit(float(lo)) - F.col("_lo") * mul).alias("add"))
    else:
        return long.select(*keys).distinct().withColumns({"mul": F.lit(1.0), "add": F.lit(0.0)})
    mul = 1 / F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(1.0)
    return stats.select(*keys, mul.alias("mul"), (-F.col("_centre") * mul).alias("add"))


def _by_series(params: DataFrame) -> DataFrame:
    entry = F.struct("column", F.struct("mul", "add"))
    return params.groupBy(SERIES).agg(F.map_from_entries(F.collect_list(entry)).alias("_scale"))


def apply_scaler(rows: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    joined = rows.join(_by_series(params), SERIES)
    scaled = {c: F.col(c) * F.col("_scale")[c]["mul"] + F.col("_scale")[c]["add"] for c in columns}
    return joined.withColumns(scaled).drop("_scale")


def scale(
    split: DataFrame, columns: list[str], kind: str | None = "standard", feature_range: tuple = (0, 1)
) -> tuple[DataFrame, DataFrame]:
    """(scaled rows, parameters), fitted on the training rows only."""
    if _checked(kind) == "none":
        return split, fit_scaler(split.where("is_train"), columns, kind)
    params = fit_scaler(split.where("is_train"), columns, kind, feature_range)
    return apply_scaler(split, params, columns), params


def unscale(rows: DataFrame, params: DataFrame, value: str = "yhat", fitted_on: str = "y") -> DataFrame:
    """Undo the scaling of one fitted column on another column, e.g. of y on the forecasts."""
    own = params.where(F.col("column") == fitted_on).select(SERIES, "mul", "add")
    return rows.join(own, SERIES).withColumn(value, (F.col(value) - F.col("add")) / F.col("mul")).drop("mul", "add")


def scale_sequences(
    split: DataFrame,
    sequences: DataFrame,
    columns: list[str],
    n_steps: int,
    kind: str = "standard",
    feature_range: tuple = (0, 1),
) -> DataFrame:
    """Scale array-of-feature-rows sequences by a fit on the flattened training sequences.

    Row j of the table appears in every training sequence that starts after it, so the fit counts it
    min(j + n_steps, n_train - 1) - max(j + 1, n_steps) + 1 times; no sequence has to be taken apart.
    """
    last = F.least(F.col("rn") + n_steps, F.col("n_train") - 1)
    times = last - F.greatest(F.col("rn") + 1, F.lit(n_steps)) + 1
    repeated = split.withColumn("_times", times).where("is_train and _times > 0")
    repeated = repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    params = fit_scaler(repeated, columns, kind, feature_range)
    arrays = _by_series(params).select(
        SERIES,
        F.array(*[F.col("_scale")[c]["mul"] for c in columns]).alias("_mul"),
        F.array(*[F.col("_scale")[c]["add"] for c in columns]).alias("_add"),
    )
    def scaled_row(row):
        grown = F.zip_with(row, F.col("_mul"), lambda x, m: x * m)
        return F.zip_with(grown, F.col("_add"), lambda x, a: x + a)

    return sequences.join(arrays, SERIES).withColumn("x", F.transform("x", scaled_row)).drop("_mul", "_add")
