"""Sources, sinks, features, splits, scaling and sequences over the driver tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewater.functions import calendar as cal
from tidewater.operators import features as feat
from tidewater.operators import scaling, sequences, splits
from tidewater.operators.positions import SERIES, TS, Y
from tidewater.session import scratch_path
from tidewater.sources.series import load_series, parse_time
from tidewater.workloads import panels as p
from tidewater.workloads import sql
from tidewater.workloads.base import rounded, split_of

QUERIES, ORACLES = {}, {}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


# Sources


def _reload(kind):
    def run(spark, sf):
        path = scratch_path(spark, "series") + f".{kind}"
        rows = p.table(spark, sf, "events").select("ts", "event_type", "value")
        writer = rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        (writer.json if kind == "jsonl" else getattr(writer, kind))(path)
        schema = "ts string, event_type string, value double" if kind != "parquet" else None
        return load_series(spark, path, "ts", "value", series_cols=["event_type"], schema=schema)

    return run


_READINGS = sql.query(p.EVENT_READINGS, select="SELECT series_id, ts, y FROM panel")
add("load_series_csv", _reload("csv"), _READINGS)
add("load_series_json", _reload("jsonl"), _READINGS)
add("load_series", _reload("parquet"), _READINGS)


add(
    "parse_time",
    lambda spark, sf: p.table(spark, sf, "orders").select(
        "o_orderkey",
        parse_time(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"), "%d/%m/%Y %H:%M").alias("ts"),
    ),
    "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS ts FROM orders",
)
add("series_panel", p.event_readings, _READINGS)
add(
    "rollup_daily",
    lambda spark, sf: rounded(p.events_daily(spark, sf)),
    sql.query(p.EVENTS_DAILY, select="SELECT series_id, ts, round(y, 4) AS y, round(covariate, 4) AS covariate FROM panel"),
)

# Features and windows

_FEATURES = ", ".join(feat.lag_names(7))


def _rounded_features(lags=7):
    names = ["y", *feat.lag_names(lags), "rolling_mean", "rolling_std"]
    return ", ".join(f"round({c}, 4) AS {c}" for c in names)


add(
    "feature_table",
    lambda spark, sf: rounded(feat.feature_table(p.orders_daily(spark, sf))),
    sql.query(p.ORDERS_DAILY, sql.features(),
              select=f"SELECT series_id, ts, {_rounded_features()}, dayofweek, month, quarter, year FROM features"),
)
# The same features on series of raw readings, numbered by day and computed in blocks with copied edges.
add(
    "feature_table_blocks",
    lambda spark, sf: rounded(feat.feature_table(p.event_readings(spark, sf), block_rows=512)),
    sql.query(p.EVENT_READINGS, sql.features(),
              select=f"SELECT series_id, ts, {_rounded_features()}, dayofweek, month, quarter, year FROM features"),
)
add(
    "lag_features",
    lambda spark, sf: rounded(feat.lag_features(p.supplier_monthly(spark, sf))),
    sql.query(p.SUPPLIER_MONTHLY, sql.raw_features(),
              select="SELECT series_id, ts, round(y, 4) AS y, "
              + ", ".join(f"round(lag_{k}, 4) AS lag_{k}" for k in range(1, 8)) + " FROM raw_features"),
)
for _name in ("rolling_mean", "rolling_std"):
    add(
        _name,
        lambda spark, sf, c=_name: rounded(feat.rolling_features(p.orders_daily(spark, sf))).select(SERIES, TS, c),
        sql.query(p.ORDERS_DAILY, sql.raw_features(), select=f"SELECT series_id, ts, round({_name}, 4) AS {_name} FROM raw_features"),
    )
add(
    "subset_lags",
    lambda spark, sf: rounded(feat.subset_lags(feat.feature_table(p.orders_daily(spark, sf)), 3)),
    sql.query(p.ORDERS_DAILY, sql.features(),
              select=f"SELECT series_id, ts, {_rounded_features(3)}, dayofweek, month, quarter, year FROM features"),
)
add(
    "feature_target_split",
    lambda spark, sf: rounded(feat.feature_target_split(feat.feature_table(p.supplier_monthly(spark, sf)))[0]),
    sql.query(p.SUPPLIER_MONTHLY, sql.features(),
              select="SELECT series_id, ts, " + _rounded_features().replace("round(y, 4) AS y, ", "")
              + ", dayofweek, month, quarter, year FROM features"),
)
add(
    "drop_incomplete",
    lambda spark, sf: feat.feature_table(p.events_daily(spark, sf), drop_incomplete=False).dropna()
    .groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"), F.min(TS).alias("first_ts")),
    sql.query(p.EVENTS_DAILY, sql.features(),
              select="SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts FROM features GROUP BY ALL"),
)
add(
    "short_series_flag",
    lambda spark, sf: feat.short_series_flag(feat.feature_table(p.events_daily(spark, sf))),
    sql.query(p.EVENTS_DAILY, sql.features(),
              select="SELECT series_id, count(*) AS n_rows, count(*) < 30 AS too_short FROM features GROUP BY ALL"),
)
add(
    "naive_diff",
    lambda spark, sf: rounded(
        feat.naive_diff(splits.chrono_split(feat.feature_table(p.event_readings(spark, sf))).where("is_train")
                        .select(SERIES, TS, Y, "rn"), block_rows=512)
    ).select(SERIES, "rn", "diff"),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT,
              select="SELECT series_id, rn, round(y - lag(y) OVER (PARTITION BY series_id ORDER BY rn), 4) AS diff "
              "FROM split WHERE is_train"),
)

# Splits

_SPLIT_COLUMNS = [SERIES, TS, "rn", "n", "n_train", "is_train"]
for _suffix, _panel, _cte in (("", p.orders_daily, p.ORDERS_DAILY), ("_readings", p.event_readings, p.EVENT_READINGS)):
    add(
        f"chrono_split{_suffix}",
        lambda spark, sf, panel=_panel: split_of(panel(spark, sf)).select(*_SPLIT_COLUMNS),
        sql.query(_cte, sql.features(), sql.SPLIT, select=f"SELECT {', '.join(_SPLIT_COLUMNS)} FROM split"),
    )
add(
    "holdout_split",
    lambda spark, sf: splits.holdout_split(split_of(p.supplier_monthly(spark, sf))).select(SERIES, TS, "rn", "n_fit", "role"),
    sql.query(p.SUPPLIER_MONTHLY, sql.features(), sql.SPLIT, sql.HOLDOUT, select="SELECT series_id, ts, rn, n_fit, role FROM holdout"),
)
add(
    "expanding_folds",
    lambda spark, sf: splits.expanding_folds(split_of(p.orders_daily(spark, sf))).select(SERIES, TS, "rn", "fold", "role"),
    sql.query(p.ORDERS_DAILY, sql.features(), sql.SPLIT, sql.FOLDS,
              select="SELECT series_id, ts, rn, fold, CASE WHEN rn < val_start THEN 'fit' ELSE 'val' END AS role FROM folds"),
)
add(
    "seasonal_period",
    lambda spark, sf: splits.seasonal_period(split_of(p.supplier_monthly(spark, sf))),
    sql.query(p.SUPPLIER_MONTHLY, sql.features(), sql.SPLIT,
              select="SELECT series_id, count(*) AS n_train, CAST(CASE WHEN count(*) > 104 THEN 52 WHEN count(*) > 24 THEN 12 "
              "ELSE 4 END AS INTEGER) AS period FROM split WHERE is_train GROUP BY ALL"),
)
add(
    "dataset_profile",
    lambda spark, sf: splits.dataset_profile(split_of(p.event_readings(spark, sf))),
    sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT,
              select="SELECT series_id, count(*) AS total_samples, count(*) FILTER (is_train) AS training_samples, "
              "count(*) FILTER (NOT is_train) AS testing_samples, min(ts) AS first_ts, max(ts) AS last_ts FROM split GROUP BY ALL"),
)
add(
    "train_tail",
    lambda spark, sf: splits.train_tail(split_of(p.orders_total(spark, sf))).select(SERIES, TS, "rn"),
    sql.query(p.ORDERS_TOTAL, sql.features(), sql.SPLIT,
              select="SELECT series_id, ts, rn FROM split WHERE is_train AND rn >= floor(n_train * 0.85::DOUBLE)"),
)
add(
    "mid_slice",
    lambda spark, sf: splits.mid_slice(split_of(p.orders_total(spark, sf))).select(SERIES, TS, "rn"),
    sql.query(p.ORDERS_TOTAL, sql.features(), sql.SPLIT,
              select="SELECT series_id, ts, rn FROM split WHERE NOT is_train "
              "AND rn - n_train >= (n - n_train) // 2 - (n - n_train) // 4 AND rn - n_train < (n - n_train) // 2 + (n - n_train) // 4"),
)
add(
    "union_train_test",
    lambda spark, sf: _stacked(split_of(p.supplier_monthly(spark, sf))),
    sql.query(p.SUPPLIER_MONTHLY, sql.features(), sql.SPLIT,
              select="SELECT series_id, ts, is_train, round(y, 4) AS y FROM split"),
)


def _stacked(split):
    columns = [SERIES, TS, "is_train", Y]
    train, test = split.where("is_train").select(*columns), split.where("not is_train").select(*columns)
    return rounded(train.unionByName(test))


# Sequences

add(
    "sequence_windows",
    lambda spark, sf: _texts(sequences.sequence_windows(split_of(p.orders_daily(spark, sf)).where("is_train").select(SERIES, TS, Y), 5)),
    sql.query(p.ORDERS_DAILY, sql.features(), sql.SPLIT,
              select="SELECT series_id, ts, round(y, 2) AS y, x_sum, x_first FROM (SELECT series_id, ts, y, rn, "
              "round(sum(y) OVER w, 2) AS x_sum, round(first(y) OVER w, 2) AS x_first FROM split WHERE is_train "
              "WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE rn >= 5"),
)


def _texts(windows):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return windows.select(
        SERIES, TS, F.round(Y, 2).alias(Y), F.round(total, 2).alias("x_sum"), F.round(F.col("x")[0], 2).alias("x_first")
    )


_SEQUENCE_COLUMNS = ["lag_1", "rolling_mean", "month"]


def _flat_steps(seqs, places):
    steps = seqs.select(SERIES, TS, "is_train", F.posexplode("x").alias("step", "row"))
    return steps.select(
        SERIES, TS, "is_train", "step",
        *[F.round(F.col("row")[i], places).alias(c) for i, c in enumerate(_SEQUENCE_COLUMNS)],
    )


_STEPS = """
steps AS (
  SELECT a.series_id, a.ts, a.is_train, CAST(b.rn - a.rn + 3 AS INTEGER) AS step, b.lag_1, b.rolling_mean, b.month
  FROM split a JOIN split b ON a.series_id = b.series_id AND b.rn BETWEEN a.rn - 3 AND a.rn - 1 WHERE a.rn >= 3)"""
add(
    "feature_sequences",
    lambda spark, sf: _flat_steps(sequences.feature_sequences(split_of(p.supplier_monthly(spark, sf)), _SEQUENCE_COLUMNS, 3), 4),
    sql.query(p.SUPPLIER_MONTHLY, sql.features(), sql.SPLIT, _STEPS,
              select="SELECT series_id, ts, is_train, step, round(lag_1, 4) AS lag_1, round(rolling_mean, 4) AS rolling_mean, "
              "CAST(month AS DOUBLE) AS month FROM steps"),
)

# Scaling

_SCALE = {
    "standard": ("(y - avg(y) FILTER (is_train) OVER g) / nullif(stddev_pop(y) FILTER (is_train) OVER g, 0)", {}),
    "minmax": ("(y - min(y) FILTER (is_train) OVER g) / nullif(max(y) FILTER (is_train) OVER g - min(y) FILTER (is_train) OVER g, 0)", {}),
    "robust": ("(y - quantile_cont(y, 0.5) FILTER (is_train) OVER g) / nullif(quantile_cont(y, 0.75) FILTER (is_train) OVER g "
               "- quantile_cont(y, 0.25) FILTER (is_train) OVER g, 0)", {}),
    "none": ("y", {}),
}
for _kind, (_formula, _) in _SCALE.items():
    add(
        f"scale_{_kind}",
        lambda spark, sf, kind=_kind: rounded(
            scaling.scale(split_of(p.event_readings(spark, sf)), [Y], kind)[0].select(SERIES, TS, "rn", Y), 6
        ),
        sql.query(p.EVENT_READINGS, sql.features(), sql.SPLIT,
                  select=f"SELECT series_id, ts, rn, round({_formula}, 6) AS y FROM split WINDOW g AS (PARTITION BY series_id)"),
    )


def _inverse(spark, sf):
    split = split_of(p.orders_daily(spark, sf))
    scaled, params = scaling.scale(split, [Y], "minmax", (-1, 1))
    test = scaled.where("not is_train").select(SERIES, TS, (F.col(Y) * 0.5).alias("yhat"))
    return rounded(scaling.unscale(test, params), 4)


add(
    "scale_inverse",
    _inverse,
    sql.query(p.ORDERS_DAILY, sql.features(), sql.SPLIT,
              select="SELECT series_id, ts, round(yhat, 4) AS yhat FROM (SELECT series_id, ts, is_train, "
              "lo + ((((y - lo) / (hi - lo) * 2 - 1) * 0.5) + 1) / 2 * (hi - lo) AS yhat FROM (SELECT *, "
              "min(y) FILTER (is_train) OVER g AS lo, max(y) FILTER (is_train) OVER g AS hi FROM split "
              "WINDOW g AS (PARTITION BY series_id))) WHERE NOT is_train"),
)


def _scaled_sequences(spark, sf):
    split = split_of(p.supplier_monthly(spark, sf))
    seqs = sequences.feature_sequences(split, _SEQUENCE_COLUMNS, 3)
    return _flat_steps(scaling.scale_sequences(split, seqs, _SEQUENCE_COLUMNS, 3, "standard"), 6)


add(
    "scale_sequences",
    _scaled_sequences,
    sql.query(p.SUPPLIER_MONTHLY, sql.features(), sql.SPLIT, _STEPS,
              "fits AS (SELECT series_id, "
              + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _SEQUENCE_COLUMNS)
              + " FROM steps WHERE is_train GROUP BY series_id)",
              select="SELECT series_id, ts, is_train, step, "
              + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in _SEQUENCE_COLUMNS)
              + " FROM steps JOIN fits USING (series_id)"),
)

# Calendar lookups and scalar functions

# Part of a row's calendar as SQL, for each factor.
_PARTS = {
    "weekday": "isodow(ts)", "weekend": "isodow(ts) >= 6", "month": "month(ts)",
    "month_end": "last_day(ts) = CAST(ts AS DATE)", "hour": "hour(ts)", "season": "quarter(ts)",
}
add(
    "calendar_factor",
    lambda spark, sf: rounded(cal.calendar_factor(p.event_readings(spark, sf)).drop(Y)),
    sql.query(p.EVENT_READINGS, select="SELECT series_id, ts, "
              + ", ".join(f"round(avg(y) OVER (PARTITION BY series_id, {part}) / avg(y) OVER (PARTITION BY series_id), 4) AS {name}_factor"
                          for name, part in _PARTS.items())
              + " FROM panel"),
)
add(
    "date_parts",
    lambda spark, sf: rounded(cal.date_parts(p.event_readings(spark, sf)).drop(Y), 6),
    sql.query(p.EVENT_READINGS, select="""
SELECT series_id, ts, hour(ts)::INTEGER AS hour, day(ts)::INTEGER AS day, dayofyear(ts)::INTEGER AS dayofyear,
  round(-cos(2 * pi() * dayofyear(ts) / 365) * 15 + 15, 6) AS yearly_cycle,
  round(-cos(2 * pi() * hour(ts) / 24) * 5, 6) AS daily_cycle
FROM panel"""),
)

_HOLIDAY = """
named AS (
  SELECT *, CASE WHEN month(ts) = 5 AND isodow(ts) = 1 AND ts + 7 > last_day(ts) THEN 'memorial'
    WHEN month(ts) = 11 AND ts = first + CAST(22 + (11 - isodow(first)) % 7 AS INTEGER) THEN 'friday'
    WHEN strftime(ts, '%m-%d') IN ('01-01', '02-14', '07-04', '12-24', '12-25') THEN strftime(ts, '%m-%d') END AS holiday
  FROM (SELECT *, CAST(date_trunc('month', ts) AS DATE) AS first FROM panel))"""
add(
    "holiday_factor",
    lambda spark, sf: rounded(cal.holiday_factor(p.orders_daily(spark, sf))).drop(Y),
    sql.query(p.ORDERS_DAILY, _HOLIDAY, select="""
SELECT series_id, ts, CASE WHEN holiday IS NULL THEN 1.0::DOUBLE ELSE round(avg(y) OVER (PARTITION BY series_id, holiday)
  / avg(y) FILTER (holiday IS NULL) OVER (PARTITION BY series_id), 4) END AS holiday_factor FROM named"""),
)

__all__ = ["ORACLES", "QUERIES"]
