import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import by_series, panel_frame, series, stamped_frame

from tidewater.operators import features as feat
from tidewater.operators.positions import number_rows, over_neighbours
from tidewater.operators.sequences import feature_sequences, sequence_windows
from tidewater.operators.splits import (
    chrono_split, expanding_folds, holdout_split, mid_slice, seasonal_period, train_tail,
)
from pyspark.sql import functions as F


def pandas_features(y, lags=7):
    s = pd.Series(y)
    out = pd.DataFrame({f"lag_{k}": s.shift(k) for k in range(1, lags + 1)})
    out["rolling_mean"] = s.rolling(3).mean().shift(1)
    out["rolling_std"] = s.rolling(3).std().shift(1)
    out["y"] = s
    return out.dropna().reset_index(drop=True)


@pytest.mark.parametrize("frame,block", [(panel_frame, 64), (stamped_frame, 64), (stamped_frame, 8)])
def test_features_match_pandas_on_both_kinds_of_panel(spark, data, frame, block):
    got = by_series(feat.feature_table(frame(spark, data), block_rows=block), "ts")
    for sid, y in data.items():
        want = pandas_features(y)
        assert len(got[sid]) == len(want)
        for c in want.columns:
            np.testing.assert_allclose(got[sid][c], want[c], rtol=1e-9, atol=1e-9)


def test_calendar_features(spark):
    panel = panel_frame(spark, {"a": range(20)}, dt.date(2023, 12, 25))
    row = feat.feature_table(panel).orderBy("ts").first()
    assert (row.ts, row.dayofweek, row.month, row.quarter, row.year) == (dt.date(2024, 1, 1), 0, 1, 1, 2024)


def test_missing_value_removes_every_row_that_needs_it(spark):
    y = list(map(float, range(30)))
    y[15] = None
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "series_id string, ts date, y double")
    got = feat.feature_table(panel).toPandas()
    assert len(got) == 30 - 7 - 8
    split = chrono_split(feat.feature_table(panel)).toPandas().sort_values("rn")
    assert split.rn.tolist() == list(range(15)) and split.n.unique().tolist() == [15]


def test_equal_timestamps_are_kept(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [("a", when, float(v)) for v in (3, 1, 2)] + [("a", when + dt.timedelta(hours=1), 9.0)]
    panel = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    assert number_rows(panel).orderBy("rn").toPandas().y.tolist() == [1.0, 2.0, 3.0, 9.0]


def test_one_hot_series_is_numbered_like_a_plain_window(spark):
    panel = stamped_frame(spark, {"hot": series(2000, 5), "cold": series(11, 6)}, minutes=11)
    got = by_series(number_rows(panel), "ts")
    assert got["hot"].rn.tolist() == list(range(2000)) and set(got["hot"].n) == {2000}
    assert got["cold"].rn.tolist() == list(range(11))


def crowded_hour(spark, rows=3000):
    """Two series in one hour, a third of all rows equal in time and value, and a few rows of other hours."""
    start = dt.datetime(2024, 1, 1, 5)
    moments = [start + dt.timedelta(microseconds=(i * 7919) % 100_003) for i in range(rows)]
    data = [("hot" if i % 4 else "warm", m, float(i % 13)) for i, m in enumerate(moments)]
    data += [("hot", start, 1.0)] * (rows // 2) + [("hot", start, None)] * 3
    data += [("hot", start + dt.timedelta(hours=h), float(h)) for h in (-2, 1, 30)] + [("cold", start, 4.0)]
    return spark.createDataFrame(data, "series_id string, ts timestamp_ntz, y double").repartition(5)


def test_a_crowded_hour_is_numbered_in_ranges(spark):
    panel = crowded_hour(spark).withColumns({"_note": F.lit("kept"), "n": F.lit(-1)})
    got = number_rows(panel, block_rows=100)
    assert got.columns == ["series_id", "ts", "y", "_note", "rn", "n"]
    want = panel.toPandas().sort_values(["series_id", "ts", "y"], na_position="first")
    for sid, rows in by_series(got).items():
        own = want[want.series_id == sid]
        assert rows.rn.tolist() == list(range(len(own))) and set(rows.n) == {len(own)}
        assert rows.ts.tolist() == own.ts.tolist() and rows.y.fillna(-1).tolist() == own.y.fillna(-1).tolist()


def test_a_crowded_hour_uses_all_tasks(spark):
    """No part of the range partition takes much more than its share, equal rows included."""
    from tidewater.operators import positions

    panel = crowded_hour(spark).withColumns({"_day": F.to_date("ts"), "_hour": F.hour("ts"), "_offset": F.lit(0)})
    size = panel.count()
    got = positions._number_in_ranges(panel, ["series_id", "_day", "_hour"], ["ts", "y"], size)
    parts = [r["count"] for r in got.groupBy("_part").count().collect()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 1.5 * size / len(parts)


def test_features_of_a_crowded_hour_equal_plain_windows(spark):
    panel = crowded_hour(spark, 600).where("y IS NOT NULL").dropDuplicates()
    got = feat.feature_table(panel, lags=3, block_rows=50).select("series_id", "ts", "y", "lag_1", "lag_3", "rolling_mean")
    frame = panel.toPandas().sort_values(["series_id", "ts", "y"])
    by = frame.groupby("series_id").y
    frame["lag_1"], frame["lag_3"] = by.shift(1), by.shift(3)
    frame["rolling_mean"] = by.transform(lambda s: s.shift(1).rolling(3).mean())
    want, have = frame.dropna().reset_index(drop=True), got.toPandas().sort_values(["series_id", "ts", "y"]).reset_index(drop=True)
    assert have[["ts", "y", "lag_1", "lag_3"]].equals(want[["ts", "y", "lag_1", "lag_3"]])
    assert abs(have.rolling_mean - want.rolling_mean).max() < 1e-9


def test_blocks_reach_ahead_and_behind(spark):
    panel = stamped_frame(spark, {"a": range(100)})

    def build(rows, w):
        return rows.withColumn("s", F.sum("y").over(w.rowsBetween(-3, 2)))

    got = by_series(over_neighbours(panel, build, behind=3, ahead=2, block_rows=10))["a"]
    want = [sum(range(max(0, i - 3), min(100, i + 3))) for i in range(100)]
    assert got.s.tolist() == want
    with pytest.raises(ValueError):
        over_neighbours(panel, build, behind=11, block_rows=10)


def test_subset_lags_keeps_numeric_order(spark, data):
    table = feat.feature_table(panel_frame(spark, data), lags=11)
    assert feat.subset_lags(table, 10).columns[-10:] == [f"lag_{k}" for k in range(1, 11)]
    x, y = feat.feature_target_split(table)
    assert "y" not in x.columns and y.columns == ["series_id", "ts", "y"]


def test_short_series_flag(spark):
    table = feat.feature_table(panel_frame(spark, {"long": series(60), "short": series(36)}))
    got = {r.series_id: r.too_short for r in feat.short_series_flag(table).collect()}
    assert got == {"long": False, "short": True}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 29, 101, 723])
def test_split_and_holdout_sizes(spark, n):
    split = chrono_split(panel_frame(spark, {"a": range(n)}))
    rows = split.toPandas()
    n_train = int(n * (1 - 0.2))
    assert rows.is_train.sum() == n_train
    held = holdout_split(split).toPandas().sort_values("rn")
    if n_train > 1:
        val = min(max(1, int(n_train * 0.2)), n_train - 1)
        assert (held.role == "val").sum() == val
        assert held[held.role == "fit"].rn.max() < held[held.role == "val"].rn.min()


@pytest.mark.parametrize("n", [100, 50, 20, 10])
def test_folds_expand_and_never_see_the_future(spark, n):
    split = chrono_split(panel_frame(spark, {"a": range(n)}), test_size=0.0)
    folds = expanding_folds(split).toPandas()
    size = n // 4
    for fold, rows in folds.groupby("fold"):
        fit, val = rows[rows.role == "fit"], rows[rows.role == "val"]
        assert len(val) == size and val.rn.min() == n - (3 - fold) * size
        assert sorted(fit.rn) == list(range(n - (3 - fold) * size))
    assert len(folds.fold.unique()) == 3


def test_slices_and_periods(spark):
    split = chrono_split(panel_frame(spark, {"a": range(200), "b": range(40), "c": range(10)}))
    periods = {r.series_id: r.period for r in seasonal_period(split).collect()}
    assert periods == {"a": 52, "b": 12, "c": 4}
    tail = by_series(train_tail(split))["a"]
    assert tail.rn.min() == int((1 - 0.15) * 160) and tail.rn.max() == 159
    mid = by_series(mid_slice(split))["a"]
    assert mid.rn.tolist() == list(range(160 + 10, 160 + 30))


@pytest.mark.parametrize("frame", [panel_frame, stamped_frame])
def test_sequences(spark, frame):
    panel = frame(spark, {"a": range(40)})
    got = by_series(sequence_windows(panel, 3, block_rows=8), "ts")["a"]
    assert [list(x) for x in got.x] == [[i - 3, i - 2, i - 1] for i in range(3, 40)]
    split = chrono_split(panel)
    seqs = by_series(feature_sequences(split, ["y", "rn"], 4, block_rows=8))["a"]
    assert len(seqs) == 36
    first_test = seqs[~seqs.is_train].iloc[0]
    assert [list(r) for r in first_test.x] == [[float(i), float(i)] for i in range(28, 32)]
