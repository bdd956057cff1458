"""Reading series from files and shaping tables into panels (series_id, ts, y)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.metrics import no_nan
from tidewater.operators.positions import SERIES, TS, Y

# Strptime directives and their Spark pattern letters.
_DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%b": "MMM", "%B": "MMMM", "%d": "dd", "%j": "DDD",
    "%H": "HH", "%I": "hh", "%p": "a", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
}
_FORMAT_PART = re.compile(r"(?P<text>(?:%%|[A-Za-z'\[\]{}#])+)|(?P<directive>%.?)|[^%A-Za-z'\[\]{}#]+")


def spark_time_format(date_format: str) -> str:
    """The Spark pattern of a strptime format; letters outside directives stand for themselves.

    Other directives (weekdays and zones, which Spark does not read into a zone-free time) are an error.
    """
    parts = []
    for part in _FORMAT_PART.finditer(date_format):
        text, directive = part["text"], part["directive"]
        if text:
            parts.append("'" + text.replace("%%", "%").replace("'", "''") + "'")
        elif directive and directive not in _DIRECTIVES:
            raise ValueError(f"Time directive {directive!r} in {date_format!r} is not supported; known: {sorted(_DIRECTIVES)}")
        else:
            parts.append(_DIRECTIVES[directive] if directive else part[0])
    return "".join(parts)


def _read_csv(spark, path, schema):
    """Without a schema every column is text: only the header line is read ahead, and the panel casts what it keeps."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def _read_json(spark, path, schema, multi_line=True):
    """A whole document per file; one task reads a file, so large data belongs in line files."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def _read_json_lines(spark, path, schema):
    return _read_json(spark, path, schema, multi_line=False)


def _read_parquet(spark, path, schema):
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


READERS = {"csv": _read_csv, "json": _read_json, "jsonl": _read_json_lines, "parquet": _read_parquet}


def require_columns(df: DataFrame, time_col: str, data_col: str) -> DataFrame:
    for label, name in (("Time", time_col), ("Data", data_col)):
        if name not in df.columns:
            raise ValueError(f"{label} column {name!r} is not in the data")
    return df


def parse_time(time: Column, date_format: str | None = None) -> Column:
    """Text to a zone-free timestamp; an unreadable value fails the query."""
    if date_format:
        return F.to_timestamp_ntz(time, F.lit(spark_time_format(date_format)))
    return time.cast("timestamp_ntz")


def series_panel(
    df: DataFrame,
    time_col: str,
    data_col: str,
    series_cols: list[str] | None = None,
    date_format: str | None = None,
    one_row_per_date: bool = False,
) -> DataFrame:
    """Keep the time and the target, keyed by series; order is left to the windows that need it.

    The time becomes a timestamp, since a file may repeat a date any number of times. A caller who
    knows that it does not sets ``one_row_per_date`` and gets the DATE column that allows plain
    per-series windows.
    """
    require_columns(df, time_col, data_col)
    keys = [F.col(c).cast("string") for c in series_cols or []]
    series = keys[0] if len(keys) == 1 else F.concat_ws("|", *keys) if keys else F.lit("all")
    is_text = dict(df.dtypes)[time_col] == "string"
    time = parse_time(F.col(time_col), date_format if is_text else None)
    time = F.to_date(time) if one_row_per_date else time
    return df.select(series.alias(SERIES), time.alias(TS), no_nan(F.col(data_col).cast("double")).alias(Y))


def load_series(
    spark: SparkSession,
    path: str,
    time_col: str,
    data_col: str,
    date_format: str | None = None,
    series_cols: list[str] | None = None,
    schema=None,
    one_row_per_date: bool = False,
) -> DataFrame:
    """Panel from a CSV, JSON or parquet file or folder, chosen by its extension."""
    extension = path.rstrip("/").split(".")[-1].lower()
    if extension not in READERS:
        raise ValueError(f"Unsupported file format: {extension}")
    table = READERS[extension](spark, path, schema)
    return series_panel(table, time_col, data_col, series_cols, date_format, one_row_per_date)


def rollup(
    df: DataFrame,
    series_cols: list[str],
    time_col: str,
    value: Column,
    grain: str = "day",
    covariate: Column | None = None,
) -> DataFrame:
    """Sum a value (and average a covariate) per series and day, week, month, quarter or year.

    The result has one row per series and date. Partial sums are formed before the shuffle, so a hot
    series costs no more than any other.
    """
    keys = [F.col(c).cast("string") for c in series_cols]
    series = F.concat_ws("|", *keys) if len(keys) > 1 else keys[0] if keys else F.lit("all")
    day = F.to_date(time_col)
    when = day if grain == "day" else F.trunc(day, grain)
    extra = [(F.sum(covariate).cast("double") / F.count(covariate)).alias("covariate")] if covariate is not None else []
    return df.groupBy(series.alias(SERIES), when.alias(TS)).agg(F.sum(value).cast("double").alias(Y), *extra)


def rollup_daily(df: DataFrame, series_cols: list[str], time_col: str, value: Column, covariate: Column) -> DataFrame:
    return rollup(df, series_cols, time_col, value, "day", covariate)
