"""Lag, rolling and calendar features of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.positions import BLOCK_ROWS, SERIES, TS, Y, number_rows, over_neighbours

CALENDAR = ["dayofweek", "month", "quarter", "year"]
ROLLING = ["rolling_mean", "rolling_std"]


def lag_names(lags: int) -> list[str]:
    return [f"lag_{k}" for k in range(1, lags + 1)]


def feature_names(lags: int = 7) -> list[str]:
    return lag_names(lags) + ROLLING + CALENDAR


def calendar_columns() -> dict[str, Column]:
    """Monday is day 0."""
    ts = F.col(TS)
    return {
        "dayofweek": F.weekday(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
    }


def _full_frame(window, rows: int, value: Column) -> Column:
    frame = window.rowsBetween(-rows, -1)
    return F.when(F.count(Y).over(frame) == rows, value.over(frame))


def lag_features(panel: DataFrame, lags: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The previous 1..lags values by position (gaps in the calendar are not filled)."""
    return over_neighbours(
        panel,
        lambda rows, w: rows.withColumns({f"lag_{k}": F.lag(Y, k).over(w) for k in range(1, lags + 1)}),
        behind=lags,
        block_rows=block_rows,
    )


def rolling_features(panel: DataFrame, rolling_window: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean and sample standard deviation of the rows before the current one; NULL on a short frame."""
    return over_neighbours(
        panel,
        lambda rows, w: rows.withColumns(
            {
                "rolling_mean": _full_frame(w, rolling_window, F.avg(Y)),
                "rolling_std": _full_frame(w, rolling_window, F.stddev_samp(Y)),
            }
        ),
        behind=rolling_window,
        block_rows=block_rows,
    )


def feature_table(
    panel: DataFrame,
    lags: int = 7,
    rolling_window: int = 3,
    drop_incomplete: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All features over one window definition: one shuffle and one sort for lags and rolling alike."""

    def build(rows, w):
        return rows.withColumns(
            {
                **{f"lag_{k}": F.lag(Y, k).over(w) for k in range(1, lags + 1)},
                "rolling_mean": _full_frame(w, rolling_window, F.avg(Y)),
                "rolling_std": _full_frame(w, rolling_window, F.stddev_samp(Y)),
            }
        )

    built = over_neighbours(panel, build, behind=max(lags, rolling_window), block_rows=block_rows)
    table = built.withColumns(calendar_columns()).select(SERIES, TS, Y, *feature_names(lags))
    return table.dropna() if drop_incomplete else table


def subset_lags(features: DataFrame, lags: int) -> DataFrame:
    """Keep every non-lag column plus lag_1..lag_N in numeric order."""
    is_lag = {c: int(c[4:]) for c in features.columns if c.startswith("lag_") and c[4:].isdigit()}
    kept = sorted((k, c) for c, k in is_lag.items() if k <= lags)
    return features.select(*[c for c in features.columns if c not in is_lag], *[c for _, c in kept])


def feature_target_split(features: DataFrame, target: str = Y) -> tuple[DataFrame, DataFrame]:
    """(all columns but the target, the target), both with their keys."""
    keys = [c for c in (SERIES, TS) if c in features.columns]
    return features.drop(target), features.select(*keys, target)


def short_series_flag(features: DataFrame, minimum: int = 30) -> DataFrame:
    """Rows per series and whether there are too few for reliable results."""
    counts = features.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("too_short", F.col("n_rows") < minimum)


def naive_diff(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First difference of y by position."""
    return over_neighbours(
        rows, lambda r, w: r.withColumn("diff", F.col(Y) - F.lag(Y).over(w)), behind=1, block_rows=block_rows
    )


__all__ = [
    "feature_names", "feature_table", "feature_target_split", "lag_features", "lag_names", "naive_diff",
    "number_rows", "rolling_features", "short_series_flag", "subset_lags",
]
