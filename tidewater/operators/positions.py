"""Positions of rows inside a series, and windows over neighbouring rows.

A panel with a DATE time column holds one row per series and date, so a series can never have more
rows than the calendar has days; a plain per-series window is bounded by that. A panel with a
timestamp column has no such bound: one sensor may hold a third of all rows. For those panels rows
are numbered per (series, hour) plus a running offset of hour counts; hours with more rows than a
block are cut into ranges of consecutive rows, numbered apart, so that no hour has to fit a task.
Neighbour windows run over fixed-size blocks of consecutive rows, each block also receiving the few
rows it needs from the block before or after it. The counts of a series are at most as many as the
calendar has hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import cut_lineage

SERIES, TS, Y = "series_id", "ts", "y"
BLOCK_ROWS = 65_536
RANGE_ROWS = 1 << 20


def one_row_per_date(df: DataFrame) -> bool:
    return isinstance(df.schema[TS].dataType, T.DateType)


def _time_order(df: DataFrame) -> list[str]:
    # Equal timestamps are kept; the value decides their order so that reruns agree.
    return [TS] if one_row_per_date(df) or Y not in df.columns else [TS, Y]


def number_rows(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``rn`` (0-based position by time within the series) and ``n`` (rows in the series).

    Equal times are ordered by value; rows that agree in both get consecutive numbers in any order.
    """
    df = df.drop("rn", "n")
    per_series = Window.partitionBy(SERIES)
    if one_row_per_date(df):
        return df.withColumns(
            {
                "rn": (F.row_number().over(per_series.orderBy(TS)) - 1).cast("bigint"),
                "n": F.count(F.lit(1)).over(per_series),
            }
        )
    hour = {"_day": F.to_date(TS), "_hour": F.hour(TS)}
    slot = [SERIES, *hour]
    hours = cut_lineage(df.groupBy(SERIES, *[c.alias(k) for k, c in hour.items()]).agg(F.count(F.lit(1)).alias("_rows")))
    crowded = F.col("_rows") > block_rows
    earlier = per_series.orderBy(*hour).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hours.select(
        *slot,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(per_series).alias("n"),
        crowded.alias("_crowded"),
    )
    placed = df.withColumns(hour).join(offsets, slot)
    columns = [*df.columns, "rn", "n"]
    within = Window.partitionBy(*slot).orderBy(*_time_order(df))
    rank = (F.col("_offset") + F.row_number().over(within) - 1).cast("bigint")
    in_ranges = hours.where(crowded).agg(F.sum("_rows")).first()[0]
    if in_ranges is None:
        return placed.withColumn("rn", rank).select(columns)
    calm = placed.where("NOT _crowded").withColumn("rn", rank)
    ranges = _number_in_ranges(placed.where("_crowded"), slot, _time_order(df), in_ranges)
    return calm.select(columns).unionByName(ranges.select(columns))


def _number_in_ranges(rows: DataFrame, slot: list[str], order: list[str], size: int) -> DataFrame:
    """``rn`` of rows whose slots are too large for a task: a range partition, counted and ranked by part.

    Rows are written once with an id, so that equal rows can be told apart and a lost task finds the
    same ones again, and once with the part they fell into. A slot spans neighbouring parts, whose
    counts give the offset of each.
    """
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(wanted, -(-size // RANGE_ROWS))
    named = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    dealt = cut_lineage(
        named.repartitionByRange(parts, *slot, *order, "_row").withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*slot).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part", *slot).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.select("_part", *slot, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", *slot).orderBy(*order, "_row")
    place = F.col("_offset") + F.col("_before") + F.row_number().over(within) - 1
    return dealt.join(counts, ["_part", *slot]).withColumn("rn", place.cast("bigint"))


def over_neighbours(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    behind: int = 0,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``build(rows, window)`` where the window sees ``behind`` rows before and ``ahead`` after.

    ``build`` adds columns computed over ``window`` (ordered by time, no frame set) and must not
    look further than it declared.
    """
    if one_row_per_date(df):
        return build(df, Window.partitionBy(SERIES).orderBy(TS))
    if max(behind, ahead) > block_rows:
        raise ValueError("block_rows must be at least as long as the neighbourhood")
    numbered = df if "rn" in df.columns else number_rows(df, block_rows)
    home = F.floor(F.col("rn") / block_rows)
    place = F.col("rn") % block_rows
    targets = [home]
    if behind:
        targets.append(F.when(place >= block_rows - behind, home + 1))
    if ahead:
        targets.append(F.when((place < ahead) & (home > 0), home - 1))
    rows = numbered.withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    built = build(rows, Window.partitionBy(SERIES, "_block").orderBy("rn"))
    return built.where(F.col("_block") == home).drop("_block")
