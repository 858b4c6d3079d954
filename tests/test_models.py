"""Attributions of fitted trees against the definition: all subsets of features, walked down Spark's own nodes."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from plumbline.operators import categories, models

FEATURES = ["a", "b", "colour", "size"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    colours, sizes = ["red", "green", "blue", "grey", "pink"], [1, 2, 3, 4]
    rows = []
    for i in range(400):
        a, b, c, s = float(r.normal()), float(r.normal()), colours[r.integers(5)], int(sizes[r.integers(4)])
        y = int(a * (c in ("red", "blue")) + 0.5 * b * (s in (1, 4)) + 0.3 * r.normal() > 0)
        rows.append((i, a, b, None if i % 40 == 7 else c, s, y))
    return spark.createDataFrame(rows, "id long, a double, b double, colour string, size int, y int")


def expected(node, row, known, is_probability):
    """The tree's mean over rows that are like `row` in the known features, by the shares of training rows."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if is_probability else node.prediction()
    f, split = int(node.split().featureIndex()), node.split()
    children = node.leftChild(), node.rightChild()
    if f in known:
        if split.getClass().getSimpleName() == "CategoricalSplit":
            left, n = set(split.leftCategories()), int(split.numCategories())
            # as Spark keeps the smaller side's values
            goes_left = row[f] in left if len(left) <= n // 2 else row[f] not in (set(map(float, range(n))) - left)
        else:
            goes_left = row[f] <= split.threshold()
        return expected(children[0 if goes_left else 1], row, known, is_probability)
    n = [c.impurityStats().count() for c in children]
    return sum(k * expected(c, row, known, is_probability) for k, c in zip(n, children)) / sum(n)


@pytest.mark.parametrize("estimator", [lambda: DecisionTreeClassifier(maxDepth=5, seed=1), lambda: RandomForestClassifier(numTrees=4, maxDepth=4, seed=2), lambda: GBTClassifier(maxIter=3, maxDepth=3, seed=3)], ids=["tree", "forest", "boosted"])
def test_attributions_and_interactions_are_the_definition(spark, table, estimator):
    estimator = estimator()
    rows, indices, left_over = categories.prepare_categorical(estimator, table, FEATURES, ["colour", "size"])
    assert indices == [2, 3] and not left_over
    model = estimator.fit(models.assemble(rows, FEATURES, "y"))
    trees = model.trees if hasattr(model, "trees") else [model]
    weights = model.treeWeights if hasattr(model, "treeWeights") else [1.0]
    is_probability = not isinstance(estimator, GBTClassifier)
    kinds = {n.split().getClass().getSimpleName() for t in trees for n in [t._call_java("rootNode")]}
    some = rows.filter("id % 80 < 2").persist()
    phi = {(r["sample"], r["feature"]): r["phi"] for r in models.tree_attributions(some, model, FEATURES, "id").collect()}
    both = {(r["sample"], r["a"], r["b"]): r["phi"] for r in models.tree_interactions(some, model, FEATURES, "id").collect()}
    m = len(FEATURES)
    subsets = [set(s) for k in range(m + 1) for s in combinations(range(m), k)]
    for r in some.collect():
        x = [float(r[f]) for f in FEATURES]
        v = {frozenset(s): sum(w * expected(t._call_java("rootNode"), x, s, is_probability) for t, w in zip(trees, weights)) for s in subsets}
        for i, f in enumerate(FEATURES):
            want = sum(factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (v[frozenset(s | {i})] - v[frozenset(s)]) for s in subsets if i not in s)
            assert phi[r["id"], f] == pytest.approx(want, abs=1e-9)
            assert sum(both[r["id"], f, g] for g in FEATURES) == pytest.approx(phi[r["id"], f], abs=1e-9)
            for j, g in enumerate(FEATURES[:i]):
                own = [s for s in subsets if not s & {i, j}]
                want = sum(factorial(len(s)) * factorial(m - len(s) - 2) / (2 * factorial(m - 1)) * (v[frozenset(s | {i, j})] - v[frozenset(s | {i})] - v[frozenset(s | {j})] + v[frozenset(s)]) for s in own)
                assert both[r["id"], f, g] == pytest.approx(want, abs=1e-9) and both[r["id"], f, g] == both[r["id"], g, f]
    strength = {(r["a"], r["b"]): r["strength"] for r in models.interaction_strength(some, model, FEATURES).collect()}
    n = some.count()
    for (f, g), s in strength.items():
        assert s == pytest.approx(sum(abs(v) for (_, a, b), v in both.items() if (a, b) == (f, g)) / n, abs=1e-12)
    total = {r["feature"]: r["total_interaction"] for r in models.total_interaction(models.interaction_strength(some, model, FEATURES)).collect()}
    assert total["a"] == pytest.approx(sum(s for pair, s in strength.items() if "a" in pair))
    assert kinds
    some.unpersist()


def test_categories(spark, table):
    assert categories.supports_categorical(GBTClassifier()) and not categories.supports_categorical(LogisticRegression()) and not categories.supports_categorical(None)
    assert categories.categorical_indices(["a", "b"], ["b", "z", 0]) == [1, 0] and categories.categorical_indices(["a"], None) is None and categories.categorical_indices(["a"], ["z"]) is None
    same, found, needs = categories.prepare_categorical(LogisticRegression(), table, FEATURES, ["colour"])
    assert same is table and found == [2] and needs
    tree = DecisionTreeClassifier(maxBins=3)
    coded, _, needs = categories.prepare_categorical(tree, table, FEATURES, ["colour"])
    assert tree.getMaxBins() == 6 and not needs and coded.columns == table.columns and categories.is_nominal(coded, "colour") and not categories.is_nominal(coded, "a")
    encoder = categories.CategoryEncoder(["colour"]).fit(table)
    assert encoder.labels()["colour"] == ["blue", "green", "grey", "pink", "red"]
    got = encoder.transform(spark.createDataFrame([(1, "red"), (2, "new"), (3, None)], "id int, colour string"))
    assert {r["id"]: r["colour"] for r in got.collect()} == {1: 4.0, 2: 5.0, 3: 5.0}
    assert categories.CategoryEncoder([]).fit(table).transform(table) is table
