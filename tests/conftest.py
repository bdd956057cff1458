import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewater.operators.features import feature_table  # noqa: E402
from tidewater.operators.splits import chrono_split  # noqa: E402
from tidewater.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def series(n, seed=0, kind="walk"):
    rng = np.random.default_rng(seed)
    if kind == "walk":
        return 100 + np.cumsum(rng.normal(size=n))
    t = np.arange(n)
    return 200 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 12) + rng.normal(size=n)


def panel_frame(spark, data, start=dt.date(2020, 1, 1), step=dt.timedelta(days=1)):
    """Panel from {series_id: values}; dates by default, timestamps for a datetime start."""
    rows = [(sid, start + i * step, float(v)) for sid, ys in data.items() for i, v in enumerate(ys)]
    kind = "timestamp_ntz" if isinstance(start, dt.datetime) else "date"
    return spark.createDataFrame(rows, f"series_id string, ts {kind}, y double")


def stamped_frame(spark, data, minutes=7):
    return panel_frame(spark, data, dt.datetime(2024, 1, 1), dt.timedelta(minutes=minutes))


@pytest.fixture(scope="session")
def data():
    return {"a": series(140, 1), "b": series(90, 2, "season"), "c": series(60, 3)}


@pytest.fixture(scope="session")
def dated_split(spark, data):
    return chrono_split(feature_table(panel_frame(spark, data))).persist()


@pytest.fixture(scope="session")
def stamped_split(spark, data):
    return chrono_split(feature_table(stamped_frame(spark, data), block_rows=16)).persist()


def by_series(df, order="rn"):
    pdf = df.toPandas()
    return {sid: g.sort_values(order).reset_index(drop=True) for sid, g in pdf.groupby("series_id")}
