"""Attributions of resamples against their closed form, and the whole analysis."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.functions.side_by_side import side_by_side
from plumbline.operators import models


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(9)
    n = 500
    b, c = r.integers(0, 2, n), r.normal(size=n)
    y = (r.random(n) < 0.25 + 0.4 * b).astype(int)
    frame = pd.DataFrame({"id": np.arange(n), "b": b.astype(float), "c": c, "colour": r.choice(["r", "g", "u"], n), "y": y})
    return spark.createDataFrame(frame).persist()


def analysis(**more):
    return models.AttributionStability(**{"n_resamples": 3, "n_points": 2, "model_factory": lambda: DecisionTreeRegressor(maxDepth=1, seed=1)} | more)


@pytest.mark.parametrize("strategy", ["holdout", "full", "pool"])
@pytest.mark.parametrize("retrain", [False, True])
def test_attributions_are_the_closed_form(spark, table, strategy, retrain):
    """A tree of one cut of one 0/1 feature gives the side's mean less the mean of the rows that it was fitted to."""
    a = analysis(eval_set_strategy=strategy, retrain_per_bootstrap=retrain)
    hold = Written(spark)
    rows, train, held, reference, model = a._reference(hold, table, ["b"], "y", ["id"])
    n_train, n_held = train.count(), held.count()
    assert (n_train, n_held) == ((400, 100) if strategy == "holdout" else (500, 500))
    assert strategy != "holdout" or train.join(held, "_row").isEmpty()
    pools = [100, 300]
    drawn = a.drawn(train, pools).toPandas()
    assert drawn.groupby(["point", "resample"])["cnt"].sum().to_dict() == {(i, r): int(0.8 * p) for i, p in enumerate(pools) for r in range(3)}
    # each resample draws a pool of its own
    assert len({frozenset(g["_row"]) for _, g in drawn.groupby(["point", "resample"])}) == 6
    phi, lost = a.attributions(hold, train, held, model, ["b"], "y", pools)
    assert lost == {0: 0, 1: 0}
    got = phi.toPandas()
    of = rows.select("_row", "b", "y").toPandas().set_index("_row")
    base = train.toPandas()

    def closed(fitted):
        m = fitted.groupby("b")["y"].mean()
        return m - fitted["y"].mean()

    for (i, r), g in drawn.groupby(["point", "resample"]):
        own = of.loc[np.repeat(g["_row"].to_numpy(), g["cnt"].to_numpy())]
        effect = closed(own) if retrain else closed(base)
        explained = own if strategy == "pool" or not retrain else held.toPandas()
        want = np.sort(effect[explained["b"]].to_numpy())
        have = np.sort(got[(got["point"] == i) & (got["resample"] == r)]["phi"].to_numpy())
        assert np.allclose(have, want, atol=1e-9)
    hold.release()


def test_failures_and_one_class_are_counted(spark, table):
    calls = []

    def factory():
        calls.append(1)
        if len(calls) % 3 == 0:
            raise RuntimeError("no model")
        return DecisionTreeRegressor(maxDepth=1, seed=1)

    a = analysis(retrain_per_bootstrap=True, n_jobs=1, model_factory=factory)
    hold = Written(spark)
    rows = table.withColumn("_row", F.col("id"))
    model = DecisionTreeRegressor(maxDepth=1).fit(models.assemble(rows, ["b"], "y"))
    phi, lost = a.attributions(hold, rows, rows.limit(10), model, ["b"], "y", [200])
    assert lost == {0: 1} and phi.select("resample").distinct().count() == 2
    rare = rows.withColumn("y", (F.col("id") == 3).cast("int"))
    phi, lost = analysis().attributions(hold, rare, rows, model, ["b"], "y", [20])
    assert lost == {0: 3} and phi.isEmpty()


def test_whole_analysis(spark, table):
    got = analysis(model_factory=lambda: LogisticRegression(maxIter=20), retrain_per_bootstrap=True).fit(table, ["b", "c"], "y", ["id"])
    assert set(got["degenerate_rates"].values()) == {0.0} and len(got["pools"]) == 2 and 0 <= got["complexity"] <= 1
    features = {r["feature"]: r for r in got["features"].collect()}
    assert set(features) == {"b", "c"} and features["b"]["magnitude_cv_std"] is not None and features["b"]["complexity_score"] < features["c"]["complexity_score"]
    assert got["points"].count() == 2 * 8


def test_categories_and_unknown_strategy(spark, table):
    got = analysis(categorical_features=["colour"], n_points=1).fit(table, ["colour", "c"], "y", ["id"])
    assert {r["feature"] for r in got["features"].collect()} == {"colour", "c"}
    with pytest.raises(ValueError):
        models.AttributionStability(eval_set_strategy="other")


def test_side_by_side_keeps_order_and_errors():
    got = side_by_side(lambda x: 1 / x, [1, 0, 2, 4], 3)
    assert got[0] == 1 and isinstance(got[1], ZeroDivisionError) and got[2:] == [0.5, 0.25]
