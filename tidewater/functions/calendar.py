"""Calendar parts of a panel's times, and how far values on them lie from a series' usual level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import literal_map
from tidewater.operators.metrics import no_nan
from tidewater.operators.positions import SERIES, TS, Y

# Holidays on the same date every year.
DATED_HOLIDAYS = {"01-01": "new year", "02-14": "valentine", "07-04": "independence", "12-24": "christmas eve", "12-25": "christmas"}


def date_parts(panel: DataFrame) -> DataFrame:
    """Hour, day of month, day of year, and the yearly and daily temperature cycles; a date is at hour 0."""
    ts = F.col(TS)
    day, hour = F.dayofyear(ts), F.hour(ts.cast("timestamp_ntz"))
    turn = 2 * 3.141592653589793
    return panel.withColumns(
        {
            "hour": hour,
            "day": F.dayofmonth(ts),
            "dayofyear": day,
            "yearly_cycle": -F.cos(turn * day / 365) * 15 + 15,
            "daily_cycle": -F.cos(turn * hour / 24) * 5,
        }
    )


def _parts() -> dict[str, Column]:
    """The parts that factors are estimated for; each has few values, whatever the length of a series."""
    ts, weekday = F.col(TS), F.weekday(TS)
    return {
        "weekday": weekday,
        "weekend": (weekday >= 5).cast("int"),
        "month": F.month(ts),
        "month_end": (F.last_day(ts) == F.to_date(ts)).cast("int"),
        "hour": F.hour(ts.cast("timestamp_ntz")),
        "season": F.quarter(ts),
    }


def calendar_factor(panel: DataFrame) -> DataFrame:
    """Mean of a series on the row's weekday, weekend or workday, month, month end or not, hour and quarter, each
    divided by the mean of the series.

    A factor is null where the mean of the series is zero or no value of it is known on that part; missing
    values (null, NaN) count for nothing. Rows are added up once, to at most a few thousand sums a series;
    the factors of a series travel to its rows as one map.
    """
    parts = _parts()
    cells = panel.groupBy(SERIES, *[c.alias(f"_{p}") for p, c in parts.items()]).agg(
        F.sum(no_nan(F.col(Y))).alias("_sum"), F.count(no_nan(F.col(Y))).alias("_n")
    )
    labels = F.array(F.lit("all"), *[F.concat_ws("=", F.lit(p), f"_{p}") for p in parts])
    means = (
        cells.select(SERIES, "_sum", "_n", F.explode(labels).alias("_part"))
        .groupBy(SERIES, "_part").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"))
        .groupBy(SERIES).agg(F.map_from_entries(F.collect_list(F.struct("_part", "_mean"))).alias("_means"))
    )

    def factor(part: str, value: Column) -> Column:
        mean = F.try_element_at(F.col("_means"), F.concat_ws("=", F.lit(part), value))
        return F.try_divide(mean, F.try_element_at(F.col("_means"), F.lit("all")))

    joined = panel.join(means, SERIES, "left")
    return joined.withColumns({f"{p}_factor": factor(p, c) for p, c in parts.items()}).drop("_means")


def holiday(day: Column) -> Column:
    """Name of the holiday on a date, else null. Memorial day is the last Monday of May, the day after
    Thanksgiving the Friday after the fourth Thursday of November."""
    month, of_month, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    return (
        F.when((month == 5) & (weekday == 0) & (of_month >= 25), "memorial")
        .when((month == 11) & (weekday == 4) & of_month.between(23, 29), "thanksgiving friday")
        .otherwise(F.try_element_at(literal_map(DATED_HOLIDAYS), F.date_format(day, "MM-dd")))
    )


def holiday_factor(panel: DataFrame, named: Column | None = None) -> DataFrame:
    """Mean of a series on the row's holiday divided by its mean on ordinary days, and 1.0 on ordinary days.

    ``named`` gives a row's holiday and is null on ordinary days (default :func:`holiday`). The factor is null
    where no value of the holiday is known, or where the mean of the ordinary days is zero or unknown.
    """
    marked = panel.withColumn("_holiday", holiday(F.to_date(TS)) if named is None else named)
    means = marked.groupBy(SERIES, "_holiday").agg(F.avg(no_nan(F.col(Y))).alias("_mean"))
    series = means.groupBy(SERIES).agg(
        F.max(F.when(F.col("_holiday").isNull(), F.col("_mean"))).alias("_ordinary"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("_holiday").isNotNull(), F.struct("_holiday", "_mean")))
        ).alias("_means"),
    )
    ratio = F.try_divide(F.try_element_at("_means", F.col("_holiday")), F.col("_ordinary"))
    factor = F.when(F.col("_holiday").isNull(), 1.0).otherwise(ratio)
    return marked.join(series, SERIES, "left").withColumn("holiday_factor", factor).drop("_holiday", "_ordinary", "_means")
