"""Attributions of models, and their stability over pools of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.functions.numeric import clean
from plumbline.functions.rng import draw
from plumbline.functions.side_by_side import side_by_side
from plumbline.operators import attribution, sampling
from plumbline.operators.categories import is_nominal, prepare_categorical, supports_categorical
from plumbline.operators.importance import ranking_metrics
from plumbline.operators.ranking import HASH_ROWS, buckets_for, hash_rank


def linear_attributions(df: DataFrame, coefficients: dict[str, float], sample: str) -> DataFrame:
    """(sample, feature, phi): coefficient times the distance to the feature's mean."""
    means = df.agg(*(F.avg(clean(c)).alias(c) for c in coefficients)).first()
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(float(b)) * (clean(c) - F.lit(means[c]))).alias("phi")) for c, b in coefficients.items()))
    return df.select(F.col(sample).alias("sample"), F.explode(parts).alias("p")).select("sample", "p.feature", "p.phi")


# -- trees: paths to leaves ------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """What one feature must be on the way to a leaf: in (low, high], or one of `values`; and the share
    of rows that it lets through. Among `values`, OTHER stands for all but the split's own."""

    feature: int
    share: float = 1.0
    low: float = -np.inf
    high: float = np.inf
    values: frozenset[int] | None = None
    known: int = 0

    def passes(self, x: np.ndarray) -> np.ndarray:
        own = x[:, self.feature]
        if self.values is None:
            return ((own > self.low) & (own <= self.high)).astype(float)
        code = np.where((own >= 0) & (own < self.known) & (own == np.floor(own)), own, OTHER).astype(np.int64)
        return np.isin(code, list(self.values)).astype(float)


OTHER = -1


def _halves(split) -> Callable[[Step, bool], Step]:
    """Narrows a step by a split, to its left or right."""
    if split.getClass().getSimpleName() == "CategoricalSplit":
        left, n = {int(c) for c in split.leftCategories()}, int(split.numCategories())
        # what the split does not know goes away from the side that it lists
        if len(left) > n // 2:
            left.add(OTHER)
        right = {*range(n), OTHER} - left

        def narrow(step: Step, is_left: bool) -> Step:
            own = frozenset(left if is_left else right)
            return replace(step, values=own if step.values is None else step.values & own, known=n)
    else:
        cut = float(split.threshold())

        def narrow(step: Step, is_left: bool) -> Step:
            return replace(step, high=min(step.high, cut)) if is_left else replace(step, low=max(step.low, cut))

    return narrow


def leaf_paths(model: Model) -> list[tuple[float, list[Step]]]:
    """Per leaf: its weighted value, and a step for each feature on the way."""
    trees = model.trees if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    regression = not hasattr(model, "numClasses") or "GBT" in type(model).__name__
    out = []
    for tree, weight in zip(trees, weights, strict=True):
        stack = [(tree._call_java("rootNode"), {})]
        while stack:
            node, path = stack.pop()
            if node.subtreeDepth() == 0:
                value = float(node.prediction())
                if not regression:
                    stats = list(node.impurityStats().stats())
                    value = stats[1] / sum(stats)
                out.append((weight * value, list(path.values())))
                continue
            f, narrow = int(node.split().featureIndex()), _halves(node.split())
            whole = float(node.impurityStats().count())
            for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
                step = narrow(path.get(f, Step(f)), is_left)
                step = replace(step, share=step.share * float(child.impurityStats().count()) / whole)
                stack.append((child, path | {f: step}))
    return out


def _known(one: list[np.ndarray], zero: list[float], without: tuple[int, ...], rows: int) -> list[np.ndarray]:
    """Sums of the path's products over sets of known features, by the sets' sizes; without some features."""
    poly = [np.ones(rows)]
    for j in range(len(one)):
        if j not in without:
            poly = [(poly[s] * zero[j] if s < len(poly) else 0) + (poly[s - 1] * one[j] if s else 0) for s in range(len(poly) + 1)]
    return poly


def shapley_of_paths(x: np.ndarray, leaves: list[tuple[float, list[Step]]], n_features: int) -> np.ndarray:
    """Path-dependent Shapley values of rows: exact, by the polynomial of each leaf's path."""
    out = np.zeros((len(x), n_features))
    for value, path in leaves:
        m = len(path)
        one, zero = [s.passes(x) for s in path], [s.share for s in path]
        weight = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
        for i in range(m):
            poly = _known(one, zero, (i,), len(x))
            out[:, path[i].feature] += value * (one[i] - zero[i]) * sum(w * p for w, p in zip(weight, poly, strict=True))
    return out


def interactions_of_paths(x: np.ndarray, leaves: list[tuple[float, list[Step]]], n_features: int) -> np.ndarray:
    """Shapley interaction values (rows, feature, feature): symmetric, and each row sums to the feature's
    Shapley value. Off the diagonal each pair's interaction is shared out by halves; what is left is the main effect."""
    out = np.zeros((len(x), n_features, n_features))
    for value, path in leaves:
        m = len(path)
        if m < 2:
            continue
        one, zero = [s.passes(x) for s in path], [s.share for s in path]
        gap = [a - b for a, b in zip(one, zero, strict=True)]
        weight = [factorial(s) * factorial(m - s - 2) / (2 * factorial(m - 1)) for s in range(m - 1)]
        for i in range(m):
            for j in range(i):
                poly = _known(one, zero, (i, j), len(x))
                part = value * gap[i] * gap[j] * sum(w * p for w, p in zip(weight, poly, strict=True))
                a, b = path[i].feature, path[j].feature
                out[:, a, b] += part
                out[:, b, a] += part
    at = np.arange(n_features)
    out[:, at, at] = shapley_of_paths(x, leaves, n_features) - out.sum(2)
    return out


def tree_attributions(df: DataFrame, model: Model, features: list[str], sample: str) -> DataFrame:
    """(sample, feature, phi) of a Spark ML tree ensemble; the model's leaves go to the tasks, the rows stay where they are."""
    leaves = leaf_paths(model)

    @F.pandas_udf("array<double>")
    def values(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(shapley_of_paths(x.to_numpy(float), leaves, len(features))))

    rows = df.select(F.col(sample).alias("sample"), values(F.struct(*(F.coalesce(clean(c), F.lit(0.0)).alias(c) for c in features))).alias("v"))
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), F.col("v")[i].alias("phi")) for i, c in enumerate(features)))
    return rows.select("sample", F.explode(parts).alias("p")).select("sample", "p.feature", "p.phi")


#: Rows whose interactions a task holds at once: a square of the features each.
INTERACTION_ROWS = 1024


def tree_interactions(df: DataFrame, model: Model, features: list[str], sample: str) -> DataFrame:
    """(sample, a, b, phi) for every two features: their shared effect on the row's prediction, a's main effect where a = b."""
    leaves, k = leaf_paths(model), len(features)

    @F.pandas_udf("array<double>")
    def values(x: pd.DataFrame) -> pd.Series:
        own = x.to_numpy(float)
        parts = [interactions_of_paths(own[at : at + INTERACTION_ROWS], leaves, k).reshape(-1, k * k) for at in range(0, len(own), INTERACTION_ROWS)]
        return pd.Series([row for part in parts for row in part])

    rows = df.select(F.col(sample).alias("sample"), values(F.struct(*(F.coalesce(clean(c), F.lit(0.0)).alias(c) for c in features))).alias("v"))
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("v")[i * k + j].alias("phi")) for i, a in enumerate(features) for j, b in enumerate(features)))
    return rows.select("sample", F.explode(parts).alias("p")).select("sample", "p.a", "p.b", "p.phi")


def interaction_strength(df: DataFrame, model: Model, features: list[str]) -> DataFrame:
    """(a, b, strength, n) for a before b: the mean absolute interaction over all rows.

    A batch adds up its rows, so what is shuffled grows with batches and pairs, not with rows times pairs.
    """
    leaves, k = leaf_paths(model), len(features)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    rows = df.select(*(F.coalesce(clean(c), F.lit(0.0)).alias(c) for c in features))

    def run(batches):
        sums, n = np.zeros((k, k)), 0
        for x in batches:
            own = x.to_numpy(float)
            for at in range(0, len(own), INTERACTION_ROWS):
                sums += np.abs(interactions_of_paths(own[at : at + INTERACTION_ROWS], leaves, k)).sum(0)
            n += len(own)
        yield pd.DataFrame([(features[i], features[j], sums[i, j], n) for i, j in pairs], columns=["a", "b", "s", "n"])

    parts = rows.mapInPandas(run, "a string, b string, s double, n long").groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return parts.select("a", "b", F.try_divide("s", F.col("n").cast("double")).alias("strength"), "n")


def total_interaction(strength: DataFrame) -> DataFrame:
    """(feature, total_interaction) of `interaction_strength`: the sum over all pairs that a feature is in."""
    each = strength.select(F.explode(F.array("a", "b")).alias("feature"), "strength")
    return each.groupBy("feature").agg(F.sum("strength").alias("total_interaction"))


def assemble(df: DataFrame, features: list[str], target: str) -> DataFrame:
    ready = df.withColumns({c: F.coalesce(clean(c), F.lit(0.0)) for c in features if not is_nominal(df, c)}).withColumn("label", F.col(target).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(ready)


def explain(df: DataFrame, model: Model, features: list[str], sample: str, explainer: str = "auto") -> DataFrame:
    """explainer: tree, linear, or auto by the model's kind."""
    if explainer == "auto":
        explainer = "linear" if hasattr(model, "coefficients") else "tree"
    if explainer == "linear":
        return linear_attributions(df, dict(zip(features, model.coefficients.toArray().tolist(), strict=True)), sample)
    if explainer == "tree":
        return tree_attributions(df, model, features, sample)
    raise NotImplementedError(f"no {explainer} explainer: Spark ML has no such models; use tree or linear")


def default_model(seed: int = 42) -> GBTClassifier:
    return GBTClassifier(maxIter=20, maxDepth=4, seed=seed)


def logistic(df: DataFrame, features: list[str], target: str) -> Model:
    return LogisticRegression(maxIter=50).fit(assemble(df, features, target))


EVAL_SETS = ("holdout", "full", "pool")


class AttributionStability:
    """Attribution metrics over a ladder of pools; each resample draws a pool of its own.

    One reference model (the default): each row has one attribution whatever the resample,
    so attributions are computed once and resampled as a table. With retrain_per_bootstrap a
    model is fitted for each resample, `n_jobs` at a time, and explains the evaluation rows.
    Resamples of one class, and those whose fit fails, are left out and counted.

    eval_set_strategy: "holdout" keeps a share of the rows from the pools; "full" draws from and
    evaluates on all rows; "pool" draws from all rows and evaluates each model on its own resample.
    """

    def __init__(self, explainer_type: str = "auto", resample_frac: float = 0.8, n_resamples: int = 20, min_pool: int = 100, linear_threshold: int = 1000, n_points: int = 15, eval_set_strategy: str = "holdout", eval_set_size: float = 0.2, retrain_per_bootstrap: bool = False, r2_threshold: float = 0.70, metric_weights: dict | None = None, random_state: int = 42, double_invert: bool = True, model_factory: Callable | None = None, top_k: int = 10, n_bins: int = 50, categorical_features: list[str | int] | None = None, n_jobs: int = 8):
        if eval_set_strategy not in EVAL_SETS:
            raise ValueError(f"unknown eval_set_strategy: {eval_set_strategy}; one of {EVAL_SETS}")
        self.explainer_type, self.resample_frac, self.n_resamples, self.retrain = explainer_type, resample_frac, n_resamples, retrain_per_bootstrap
        self.ladder = (min_pool, linear_threshold, n_points)
        self.eval_set_strategy, self.eval_set_size, self.r2_threshold, self.random_state, self.double_invert = eval_set_strategy, eval_set_size, r2_threshold, random_state, double_invert
        self.weights = metric_weights or attribution.DEFAULT_SHAP_WEIGHTS
        self.model_factory = model_factory or default_model
        self.top_k, self.n_bins, self.categorical, self.n_jobs = top_k, n_bins, categorical_features, n_jobs

    def fit(self, df: DataFrame, features: list[str], target: str, rows_key: list[str]) -> dict:
        """points (pool_size, metric, mean), fits, complexity, features (means and sds over pools), constant, pools, degenerate_rates."""
        if target is None:
            raise ValueError("attributions need a target")
        hold = Written(df.sparkSession)
        rows, train, held, reference, model = self._reference(hold, df, features, target, rows_key)
        n_train = train.count()
        rate = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
        ladder = sampling.pool_ladder(n_train, *self.ladder)
        pools, _ = sampling.enough_events(ladder, rate, max(20, int(20 / max(rate, 0.01))))
        pools = [min(p, n_train) for p in pools]
        if not pools:
            raise ValueError("no pool holds enough events")
        phi, lost = self.attributions(hold, train, held, model, features, target, pools)

        if all(lost.get(i, 0) >= self.n_resamples for i in range(len(pools))):
            raise ValueError("every resample is of one class, or failed")
        # all pools at once: one pass over their attributions for each metric, not one for each pool
        by = ["point"]
        sizes = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(map(int, pools))), "point int, pool_size long"))
        imp = hold(attribution.importances(phi, by))
        own = hold(attribution.feature_metrics(phi, reference, self.n_bins, by, imp).join(sizes, by).drop("point"))
        found = attribution.all_metrics(phi, reference, self.n_bins, self.top_k, ["pool_size"], imp.join(sizes, by).drop("point"), own)
        points = hold(found.select("metric", "mean", "stderr", "pool_size"))
        fits = hold(attribution.fit_curves(points, r2_threshold=self.r2_threshold))
        score = attribution.score(fits, [], self.weights, self.double_invert).first()["complexity"]
        if score is None:
            score = attribution.fallback_score(points, self.weights).first()["complexity"]
        names = [c for c in own.columns if c not in ("feature", "pool_size")]
        per_feature = own.groupBy("feature").agg(*(F.avg(c).alias(c) for c in names), *(F.stddev_samp(c).alias(f"{c}_std") for c in names))
        rates = {int(p): lost.get(i, 0) / self.n_resamples for i, p in enumerate(pools)}
        return {"points": points, "fits": fits, "complexity": score, "features": attribution.feature_complexity(per_feature, self.weights), "constant": attribution.constant_features(reference), "pools": pools, "degenerate_rates": rates}

    def _reference(self, hold: Written, df: DataFrame, features: list[str], target: str, rows_key: list[str]) -> tuple:
        """Numbered rows, those that train, those that are evaluated, their attributions by the reference model, and the model."""
        if self.categorical:
            probe = self.model_factory()
            df, _, _ = prepare_categorical(probe, df, features, self.categorical)
            self._bins = probe.getMaxBins() if supports_categorical(probe) else 0  # as many as there are categories
        df = df.select(*dict.fromkeys([*rows_key, *features, target]))
        rows = hold(sampling.number_rows(df, rows_key, name="_row"))
        train = held = rows
        if self.eval_set_strategy == "holdout":
            n = rows.count()
            hashed = rows.withColumn("_h", draw(self.random_state, "eval", F.col("_row")))
            marked = hold(hash_rank(hashed, [], "_h", ["_row"], "_rank", buckets_for(n, HASH_ROWS)).withColumn("_eval", F.col("_rank") < int(n * self.eval_set_size)).drop("_h", "_rank"))
            train, held = marked.filter(~F.col("_eval")).drop("_eval"), marked.filter("_eval").drop("_eval")
        model = self._model().fit(assemble(train, features, target))
        return rows, train, held, hold(explain(held, model, features, "_row", self.explainer_type)), model

    def _model(self):
        model = self.model_factory()
        if self.categorical and supports_categorical(model):
            model.setMaxBins(max(model.getMaxBins(), self._bins))
        return model

    def attributions(self, hold: Written, train: DataFrame, held: DataFrame, model: Model, features: list[str], target: str, pools: list[int]) -> tuple[DataFrame, dict[int, int]]:
        """(point, resample, sample, feature, phi) of all pools, and per pool how many resamples gave none."""
        drawn = hold(self.drawn(train, pools))
        sides = drawn.join(train.select("_row", F.col(target).cast("double").alias("y")), "_row").groupBy("point", "resample").agg(F.min("y").alias("low"), F.max("y").alias("high"))
        good = [(r["point"], r["resample"]) for r in sides.filter("low < high").orderBy("point", "resample").collect()]  # a row for each resample
        rows_of = lambda rows: rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))))
        if not self.retrain:
            names = [f"p{i}" for i in range(len(features))]
            each = explain(train, model, features, "_row", self.explainer_type).groupBy("sample").pivot("feature", features).agg(F.first("phi"))
            wide = hold(each.toDF("_row", *names))  # a row of all features is dealt once
            use = drawn.sparkSession.createDataFrame(good, "point int, resample int")
            # rows of different resamples meet by their order in the resample, as positions
            copies = rows_of(drawn.join(F.broadcast(use), ["point", "resample"])).withColumn("_h", draw(self.random_state, "place", F.col("_row"), F.col("_copy")))
            placed = hash_rank(copies, ["point", "resample"], "_h", ["_row", "_copy"], "sample", buckets_for(max(pools), HASH_ROWS))
            met = hold(placed.join(wide.hint("shuffle_hash"), "_row").select("point", "resample", "sample", *names))
            pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(n).alias("phi")) for f, n in zip(features, names, strict=True))))
            out = met.select("point", "resample", "sample", pairs.alias("p")).select("point", "resample", "sample", "p.feature", "p.phi")
            failed = []
        else:

            def fit(key: tuple[int, int]) -> None:
                i, r = key
                own = rows_of(train.join(drawn.filter((F.col("point") == i) & (F.col("resample") == r)).select("_row", "cnt"), "_row"))
                seen = own.withColumn("_row", F.xxhash64("_row", "_copy")) if self.eval_set_strategy == "pool" else held
                found = explain(seen, self._model().fit(assemble(own, features, target)), features, "_row", self.explainer_type)
                found.write.mode("overwrite").parquet(f"{hold.path('phi')}/point={i}/resample={r}")

            got = side_by_side(fit, good, self.n_jobs)
            failed = [key for key, x in zip(good, got, strict=True) if isinstance(x, Exception)]
            if len(failed) == len(good):
                raise RuntimeError("no resample's model could be fitted and explained") from next((x for x in got if x), None)
            out = hold.spark.read.parquet(hold.path("phi")).select("point", "resample", "sample", "feature", "phi")
        fine = {key for key in good if key not in failed}
        return out, {i: self.n_resamples - sum(p == i for p, _ in fine) for i in range(len(pools))}

    def drawn(self, train: DataFrame, pools: list[int]) -> DataFrame:
        """(point, resample, _row, cnt): the rows of each resample, from a pool of its own."""
        n = train.count()
        plan = [(n, i * self.n_resamples + r, 0, size) for i, size in enumerate(pools) for r in range(self.n_resamples)]
        numbered = sampling.number_rows(train.select("_row"), ["_row"], name="row_id", buckets=buckets_for(n, HASH_ROWS))
        picked = sampling.resampled_rows(train.sparkSession, plan, 1, self.resample_frac, self.random_state).filter("c0 > 0")
        met = picked.join(numbered.hint("shuffle_hash"), "row_id")  # picked rows come from a row a pool: not to be broadcast
        return met.select(F.floor(F.col("pool") / self.n_resamples).cast("int").alias("point"), (F.col("pool") % self.n_resamples).alias("resample"), "_row", F.col("c0").cast("long").alias("cnt"))


def predictions(model: Model, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The rows with `score`, the probability of label 1."""
    return model.transform(assemble(df, features, target)).withColumn("score", vector_to_array("probability")[1])


def cross_validated(df: DataFrame, features: list[str], target: str, keys: list[str], k: int = 5, seed: int = 42, factory: Callable | None = None) -> DataFrame:
    """Ranking metrics of held-out folds, one row for each fold; without features auc .5, gini 0, ks 0, brier 1."""
    if not features:
        return df.sparkSession.createDataFrame([(f, 0.5, 0.0, 1.0, 0.0) for f in range(k)], "fold int, auc double, ks double, brier double, gini double")
    folds = sampling.kfold(df, k, seed, keys).persist()
    out = None
    for f in range(k):
        model = (factory or (lambda: LogisticRegression(maxIter=50)))().fit(assemble(folds.filter(F.col("fold") != f), features, target))
        part = predictions(model, folds.filter(F.col("fold") == f), features, target).select("fold", F.col(target).cast("int").alias("label"), "score")
        out = part if out is None else out.unionByName(part)
    return ranking_metrics(out, ["fold"], "label", "score")


def permutation_importance(df: DataFrame, model: Model, features: list[str], target: str, row_id: str, n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """Per feature: mean and sd of the auc lost by dealing its values anew, and mean -/+ 1.96 sd. row_id numbers rows from 0."""
    base = ranking_metrics(predictions(model, df, features, target), [], target, "score").first()["auc"]
    out = None
    for f in features:
        dealt = sampling.permuted(df, f, n_repeats, seed, row_id)
        part = ranking_metrics(predictions(model, dealt, features, target), ["permutation"], target, "score").withColumn("feature", F.lit(f))
        out = part if out is None else out.unionByName(part)
    loss = F.lit(base) - F.col("auc")
    got = out.groupBy("feature").agg(F.avg(loss).alias("importance"), F.stddev_samp(loss).alias("sd"))
    return got.withColumns({"low": F.col("importance") - 1.96 * F.col("sd"), "high": F.col("importance") + 1.96 * F.col("sd")})
