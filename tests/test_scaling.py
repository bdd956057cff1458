import numpy as np
import pytest
from conftest import by_series, panel_frame, series, stamped_frame
from pyspark.sql import functions as F

from tidewater.operators import scaling
from tidewater.operators.quantiles import exact_quantiles
from tidewater.operators.sequences import feature_sequences
from tidewater.operators.splits import chrono_split


def scaler(train, kind, lo=0.0, hi=1.0):
    if kind == "standard":
        return train.mean(), train.std() or 1.0, 0.0
    if kind == "robust":
        q = np.quantile(train, [0.25, 0.5, 0.75])
        return q[1], (q[2] - q[0]) or 1.0, 0.0
    width = (train.max() - train.min()) or 1.0
    return train.min(), width / (hi - lo), lo


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust"])
@pytest.mark.parametrize("frame", [panel_frame, stamped_frame])
def test_scalers_fit_on_train_only_and_undo(spark, kind, frame):
    data = {"a": series(60, 1), "const": np.full(20, 7.0)}
    split = chrono_split(frame(spark, data))
    scaled, params = scaling.scale(split, ["y"], kind, (-1, 1))
    got = by_series(scaled)
    for sid, y in data.items():
        centre, width, shift = scaler(y[: int(len(y) * 0.8)], kind, -1, 1)
        np.testing.assert_allclose(got[sid].y, (y - centre) / width + shift, atol=1e-9)
    back = scaling.unscale(scaled.withColumn("yhat", F.col("y")), params)
    for sid, y in data.items():
        np.testing.assert_allclose(by_series(back)[sid].yhat, y, atol=1e-9)


def test_none_and_unknown(spark):
    split = chrono_split(panel_frame(spark, {"a": range(10)}))
    same, _ = scaling.scale(split, ["y"], "none")
    assert same is split
    with pytest.raises(ValueError, match="unknown scaler"):
        scaling.scale(split, ["y"], "quantile")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 11, 1001, 30_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {x.prob: x.value for x in exact_quantiles(df, ["k"], "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_quantiles_of_large_groups_are_narrowed(spark, monkeypatch, sent):
    from tidewater.operators import quantiles

    monkeypatch.setattr(quantiles, "SENT_BRACKETS", sent)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(3)
    groups = {
        "hot": np.concatenate([rng.normal(size=3000), np.full(900, 0.125), [1e12, -1e12]]), "ties": np.repeat([1.0, 2.0], 400),
        "one": np.full(500, 3.0), "small": rng.normal(size=7), "even": np.arange(1000.0),
    }
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(x.k, x.prob): x.value for x in exact_quantiles(df, ["k"], "v", probs, block_rows=50).collect()}
    assert len(got) == len(groups) * len(probs)
    for k, own in groups.items():
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust"])
def test_sequences_are_scaled_by_their_flattened_rows(spark, kind):
    y = series(30, 4)
    split = chrono_split(panel_frame(spark, {"a": y})).withColumn("z", F.col("y") * 2 + F.col("rn"))
    seqs = feature_sequences(split, ["y", "z"], 4)
    got = by_series(scaling.scale_sequences(split, seqs, ["y", "z"], 4, kind))["a"]
    x = np.column_stack([y, y * 2 + np.arange(30)])
    stacked = np.array([x[i - 4 : i] for i in range(4, 30)])
    flat = stacked[: 24 - 4].reshape(-1, 2)
    fits = [scaler(flat[:, j], kind) for j in range(2)]
    want = np.stack([(stacked[:, :, j] - c) / w for j, (c, w, _) in enumerate(fits)], axis=2)
    np.testing.assert_allclose(np.array([[list(r) for r in s] for s in got.x]), want, atol=1e-9)
