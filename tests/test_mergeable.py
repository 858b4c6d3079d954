"""Mergeable statistics against numpy on whole samples, however the rows are dealt."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import inference, mergeable


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    n = 4000
    frame = pd.DataFrame({"g": r.integers(0, 7, n), "a": np.round(r.normal(size=n), 1), "b": r.random(n) + 1, "w": r.integers(0, 4, n)})
    return frame, spark.createDataFrame(frame).repartition(5)


def trimmed(x, share):
    x = np.sort(x)
    n, upto = len(x), np.arange(1, len(x) + 1)
    kept = np.clip(np.minimum(upto, n * (1 - share)) - np.maximum(upto - 1, n * share), 0, None)
    return kept @ x / kept.sum()


@pytest.mark.parametrize("held", [1 << 20, 1])
def test_against_whole_samples(spark, rows, monkeypatch, held):
    monkeypatch.setattr(mergeable, "HELD", held)
    frame, df = rows
    got = {s: {r["g"]: r["stat"] for r in mergeable.aggregate(df, "g", c, "w", x).collect()} for s, c, x in (("ratio", ["a", "b"], mergeable.Ratio()), ("mean", ["a"], mergeable.TrimmedMean.of(df, "a", 0.2)), ("range", ["a"], mergeable.Extremes()))}
    for g, own in frame.groupby("g"):
        a, b = (np.repeat(own[c].to_numpy(), own["w"]) for c in "ab")
        assert got["ratio"][g] == pytest.approx(a.sum() / b.sum())
        assert got["mean"][g] == pytest.approx(trimmed(a, 0.2))
        assert got["range"][g] == pytest.approx(a.max() - a.min())


def test_cuts_bound_the_error(rows):
    frame, df = rows
    exact = trimmed(frame["b"].to_numpy(), 0.1)
    for bins in (16, 64, 512):
        s = mergeable.TrimmedMean.of(df, "b", 0.1, bins)
        assert len(s.cuts) < bins
        value = s.finish(s.add(s.create(), [frame["b"].to_numpy()], np.ones(len(frame))))
        assert abs(value - exact) <= 2 / bins


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(0, None, 1.0), (0, 3.0, float("nan")), (1, 3.0, 2.0), (2, 1.0, 0.0)], "g int, a double, b double").withColumn("w", F.lit(1))
    assert {r["g"]: r["stat"] for r in mergeable.aggregate(df, "g", ["a", "b"], "w", mergeable.Ratio()).collect()} == {1: 1.5, 2: None}
    assert mergeable.aggregate(df.filter("g > 5"), "g", ["a"], "w", mergeable.Extremes()).count() == 0
    with pytest.raises(ValueError):
        mergeable.aggregate(df, "g", ["a"], "w", mergeable.Ratio())
    with pytest.raises(ValueError):
        mergeable.TrimmedMean([1.0], 0.5)


def test_intervals_of_mergeable_statistics(rows):
    frame, df = rows
    for resample in ("exact", "poisson"):
        ci = inference.bootstrap_ci(df.withColumn("id", F.monotonically_increasing_id()), ["a", "b"], mergeable.Ratio(), n_boot=60, keys=["id"], resample=resample)
        assert ci["point_estimate"] == pytest.approx(frame["a"].sum() / frame["b"].sum())
        assert ci["ci_lower"] < ci["point_estimate"] < ci["ci_upper"]
