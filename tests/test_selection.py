"""Fold models against Spark ML's, inflations against least squares, and the choice against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from plumbline.operators import importance, models, sampling, selection

COLUMNS = ["a", "b", "twin", "c", "noise", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(4)
    n = 900
    a, b, c = r.normal(size=(3, n))
    y = (r.random(n) < 1 / (1 + np.exp(-(1.5 * a - b + 0.7 * c)))).astype(int)
    frame = pd.DataFrame({"id": np.arange(n), "a": a * 10 + 3, "b": b, "twin": a + 0.05 * r.normal(size=n), "c": c, "noise": r.normal(size=n), "flat": 1.0, "y": y})
    return sampling.kfold(spark.createDataFrame(frame), 3, 1, ["id"]).persist()


def test_fold_models_are_maximum_likelihood(table):
    beta = selection.fold_models(table, ["a", "b", "c"], "y", 3)
    for f in range(3):
        m = LogisticRegression(maxIter=200, tol=1e-12).fit(models.assemble(table.filter(F.col("fold") != f), ["a", "b", "c"], "y"))
        assert beta[f] == pytest.approx([m.intercept, *m.coefficients.toArray()], abs=1e-4)
    auc = models.cross_validated(table.drop("fold"), ["a", "b", "c"], "y", ["id"], 3, 1).agg(F.avg("auc")).first()[0]
    assert selection.fold_auc(table, ["a", "b", "c"], "y", 3) == pytest.approx(auc, abs=1e-4)
    assert selection.fold_auc(table, [], "y", 3) == 0.5


def test_separated_classes_and_nulls_end(spark):
    df = spark.createDataFrame([(i % 2, i % 2, float(i % 2) if i % 5 else None) for i in range(40)], "fold int, y int, x double")
    assert np.isfinite(selection.fold_models(df, ["x"], "y", 2)).all()


def test_inflations(table):
    cross = importance.gram(table, COLUMNS)
    want = dict(importance.vif(table, COLUMNS))
    for c, v in zip(COLUMNS, selection.inflations(cross, range(len(COLUMNS)))):
        assert v == pytest.approx(want[c] if want[c] is not None else np.inf)
    grown = selection.GrowingFactor(cross)
    for i, c in enumerate(COLUMNS):
        assert grown.inflation(i) == pytest.approx(importance.added_vif(table, COLUMNS[:i], c), rel=1e-6)
        if c != "flat":
            grown.admit(i)


def test_choice_is_that_of_brute_force(table):
    known = {}

    def evaluate(columns):
        key = tuple(columns)
        if key not in known:
            known[key] = selection.fold_auc(table, columns, "y", 3)
        return known[key]

    got = selection.forward_selection(table, COLUMNS, evaluate)
    order = sorted(COLUMNS, key=lambda c: (dict(importance.vif(table, COLUMNS))[c] or np.inf, COLUMNS.index(c)))
    chosen, best = [], 0.5
    for c in order:
        need = 0.003 + (0.005 if importance.added_vif(table, chosen, c) > 5 else 0)
        if evaluate([*chosen, c]) - best >= need:
            chosen, best = [*chosen, c], evaluate([*chosen, c])
    while len(chosen) > 1 and (importance.vif(table, chosen)[0][1] or np.inf) > 10:
        chosen.remove(importance.vif(table, chosen)[0][0])
    assert got == chosen and {"b", "c"} <= set(got) and "flat" not in got and len({"a", "twin"} & set(got)) == 1
