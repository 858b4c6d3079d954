"""Stability of attributions: metrics over a long table (resample, sample, feature, phi)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import curves
from plumbline.operators.marginal import LEAST, wasserstein_to_reference
from plumbline.operators.ranking import average_rank

# -- fixed values: weights of the attribution score ---------------------------------------
DEFAULT_SHAP_WEIGHTS = {"rank_stability": 0.30, "direction_consistency": 0.30, "wasserstein": 0.15, "magnitude_cv": 0.15, "js_divergence": 0.10}
#: Metrics of which more is better.
INVERTED = ("rank_stability", "direction_consistency", "topk_overlap", "per_feature_rank_stability")
# -- end of fixed values --------------------------------------------------------------------

KEYS = ["resample", "sample", "feature", "phi"]


def from_arrays(df: DataFrame, vector: str, sample: str, resample: Column) -> DataFrame:
    """The long table of a column of attribution arrays; features are numbered from 0."""
    rows = df.select(resample.alias("resample"), F.col(sample).alias("sample"), F.posexplode(vector).alias("feature", "phi"))
    return rows.select("resample", "sample", "feature", F.col("phi").cast("double").alias("phi"))


# All metrics take `by`: columns of sets that are measured each by itself, pools for one, with
# one pass over the attributions of all of them.


def importances(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, resample, feature, importance): means of absolute attributions."""
    return phi.groupBy(*by, "resample", "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def _ranks(imp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranks by falling importance; tied ranks' means lose their fraction."""
    return average_rank(imp, [*by, "resample"], "importance", "_r", descending=True).withColumn("rank", F.floor("_r").cast("double")).drop("_r")


def rank_agreement(imp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each of `by`: Kendall's W over resamples, held to [0, 1]; null with fewer than 2 resamples, 1 with one feature."""
    sums = _ranks(imp, by).groupBy(*by, "feature").agg(F.sum("rank").alias("s"), F.count("*").alias("r"))
    s = F.var_pop("s") * F.count("*")
    m, r = F.count("*").cast("double"), F.max("r").cast("double")
    w = 12 * s / (r * r * (m * m * m - m))
    held = F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
    return sums.groupBy(*by).agg(F.when(r < 2, F.lit(None).cast("double")).when(m == 1, F.lit(1.0)).otherwise(held).alias("rank_stability"))


def rank_stability(imp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per feature: 1 - the root of its ranks' variance against that of ranks 1..M, held to [0, 1]."""
    n_features = imp.select("feature").distinct().count()
    whole = n_features * (n_features + 1) / 12.0  # variance of 1..M, by M - 1
    spread = F.coalesce(F.var_samp("rank"), F.lit(0.0))
    value = 1 - F.sqrt(spread / F.lit(whole)) if n_features > 1 else F.lit(1.0)
    return _ranks(imp, by).groupBy(*by, "feature").agg(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("rank_stability"))


def wasserstein(phi: DataFrame, reference: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per feature: distance of each resample's attributions to the reference's (feature, phi), averaged."""
    each = wasserstein_to_reference(phi, reference, [*by, "resample"], "feature", "phi")
    return each.groupBy(*by, "feature").agg(F.avg("wasserstein").alias("wasserstein"))


def js_divergence(phi: DataFrame, reference: DataFrame, n_bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Per feature: divergence of histograms over the joint range of a resample and the reference, averaged."""
    keys = [*by, "resample", "feature"]
    ends = lambda d, a: d.agg(F.min("phi").alias(f"lo{a}"), F.max("phi").alias(f"hi{a}"))
    a, b = ends(phi.groupBy(*keys), 1), ends(reference.groupBy("feature"), 0)
    span = a.join(F.broadcast(b), "feature").select(*keys, F.least("lo0", "lo1").alias("lo"), F.greatest("hi0", "hi1").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("phi") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1))).otherwise(F.lit(0))
    mine = phi.join(F.broadcast(span), keys).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("c1"))
    # a reference value falls in another bin for each range, but most resamples lie within the reference's
    ranges = ["feature", "lo", "hi"]
    theirs = reference.select("feature", "phi").join(F.broadcast(span.select(*ranges).distinct()), "feature").groupBy(*ranges, at.cast("int").alias("bin")).agg(F.count("*").alias("c0"))
    bins = span.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    h = bins.join(mine, [*keys, "bin"], "left").join(theirs, [*ranges, "bin"], "left").fillna(0, ["c1", "c0"])
    whole = Window.partitionBy(*keys)
    norm = lambda c: (F.col(c) / F.sum(c).over(whole) + LEAST) / (1 + n_bins * LEAST)
    h = h.withColumns({"p": norm("c1"), "q": norm("c0")})
    mid = (F.col("p") + F.col("q")) / 2
    h = h.withColumn("t", F.col("p") * F.log(F.col("p") / mid) + F.col("q") * F.log(F.col("q") / mid))
    each = h.groupBy(*keys).agg((F.sum("t") / 2).alias("js"))
    return each.groupBy(*by, "feature").agg(F.avg("js").alias("js_divergence"))


def direction_consistency(phi: DataFrame, how: str = "majority", provided: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per feature: how often a sample's sign is its reference sign; a reference of 0 counts as positive.

    how: "majority" (sign of the mean over resamples), "first" (the first resample's), or
    "provided" (a table sample, feature, sign).
    """
    keys = [*by, "sample", "feature"]
    if how == "majority":
        mean = F.avg("phi").alias("_m")
    elif how == "first":
        mean = F.min_by("phi", "resample").alias("_m")
    elif how == "provided" and provided is not None:
        mean = F.lit(None).cast("double").alias("_m")
    else:
        raise ValueError(f"unknown reference: {how}")
    met = phi.groupBy(*keys).agg(mean, F.count("phi").alias("n"), F.count_if(F.col("phi") > 0).alias("up"), F.count_if(F.col("phi") < 0).alias("down"))
    if how == "provided":
        met = met.drop("_m").join(provided.select("sample", "feature", F.col("sign").cast("double").alias("_m")), ["sample", "feature"])
    share = met.select(*by, "feature", F.try_divide(F.when(F.col("_m") < 0, F.col("down")).otherwise(F.col("up")), F.col("n")).alias("s"))
    return share.groupBy(*by, "feature").agg(F.avg("s").alias("direction_consistency"))


def magnitude_cv(imp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    mean, n = F.avg("importance"), F.count("*")
    cv = F.when(mean > 0, F.when(n > 1, F.stddev_samp("importance")).otherwise(F.lit(0.0)) / mean).otherwise(F.lit(0.0))
    return imp.groupBy(*by, "feature").agg(cv.alias("magnitude_cv"))


def magnitude_iqr(imp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    q = F.percentile("importance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = imp.groupBy(*by, "feature").agg(q.alias("q"))
    return got.select(*by, "feature", F.when(F.col("q")[1] > 0, (F.col("q")[2] - F.col("q")[0]) / F.col("q")[1]).otherwise(F.lit(0.0)).alias("magnitude_iqr"))


def top_k(imp: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Rows (by, feature) of the k most important; ties go to the smaller feature."""
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return imp.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select(*by, "feature")


def topk_overlap(imp: DataFrame, k: int = 10, how: str = "majority", by: Sequence[str] = ()) -> DataFrame:
    """One row for each of `by`: mean overlap (intersection by union) of resamples' top features with the reference set; 1 with fewer than 2.

    how: "majority" takes the features most often among the top, "first" the first resample's.
    """
    tops = top_k(imp, [*by, "resample"], k)
    with_all = lambda d, e: d.join(F.broadcast(e), list(by)) if by else d.crossJoin(F.broadcast(e))
    if how == "first":
        firsts = imp.groupBy(*by).agg(F.min("resample").alias("_r"))
        ref = with_all(tops.groupBy(*by, "feature").agg(F.min("resample").alias("_own")), firsts).filter("_own = _r").select(*by, "feature")
    else:
        seen = tops.groupBy(*by, "feature").agg(F.count("*").alias("importance"))
        ref = top_k(seen, list(by), k)
    size = ref.groupBy(*by).agg(F.count("*").alias("_size"))
    met = tops.join(F.broadcast(ref.withColumn("_in", F.lit(1))), [*by, "feature"], "left").groupBy(*by, "resample").agg(F.count("_in").alias("both"), F.count("*").alias("own"))
    share = F.avg(F.col("both") / (F.col("own") + F.col("_size") - F.col("both")))
    return with_all(met, size).groupBy(*by).agg(F.when(F.count("*") < 2, F.lit(1.0)).otherwise(share).alias("topk_overlap"))


def constant_features(phi: DataFrame, least: float = 1e-10) -> DataFrame:
    return phi.groupBy("feature").agg((F.stddev_pop("phi") < least).alias("constant"))


def feature_metrics(phi: DataFrame, reference: DataFrame, n_bins: int = 50, by: Sequence[str] = (), imp: DataFrame | None = None) -> DataFrame:
    """Per feature: the six metrics that features have one by one. imp: the `importances`, where they are at hand."""
    imp = importances(phi, by) if imp is None else imp
    out = rank_stability(imp, by)
    for part in (wasserstein(phi, reference, by), js_divergence(phi, reference, n_bins, by), direction_consistency(phi, by=by), magnitude_cv(imp, by), magnitude_iqr(imp, by)):
        out = out.join(part, [*by, "feature"])
    return out


def all_metrics(phi: DataFrame, reference: DataFrame, n_bins: int = 50, k: int = 10, by: Sequence[str] = (), imp: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Rows (by, metric, mean, stderr): over features, and the two metrics of the whole set.

    imp, features: the `importances` and `feature_metrics`, where they are at hand.
    """
    imp = importances(phi, by) if imp is None else imp
    features = feature_metrics(phi, reference, n_bins, by, imp) if features is None else features
    f = features.withColumnRenamed("rank_stability", "per_feature_rank_stability")
    names = [c for c in f.columns if c not in ("feature", *by)]
    long = f.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names))).alias("p")).select(*by, "p.*")
    stderr = F.when(F.count("v") > 1, F.stddev_samp("v") / F.sqrt(F.count("v").cast("double"))).otherwise(F.lit(0.0))
    rows = long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), stderr.alias("stderr"))
    whole = rank_agreement(imp, by).select(*by, F.lit("rank_stability").alias("metric"), F.col("rank_stability").alias("mean"), F.lit(0.0).alias("stderr"))
    tops = topk_overlap(imp, k, by=by).select(*by, F.lit("topk_overlap").alias("metric"), F.col("topk_overlap").alias("mean"), F.lit(0.0).alias("stderr"))
    return rows.unionByName(whole).unionByName(tops)


def instability(metrics: DataFrame) -> DataFrame:
    """Metrics of which more is better become 1 - mean."""
    return metrics.withColumn("mean", F.when(F.col("metric").isin(*INVERTED), 1 - F.col("mean")).otherwise(F.col("mean")))


def score(fits: DataFrame, by: list[str], weights: dict[str, float] = DEFAULT_SHAP_WEIGHTS, double_invert: bool = True) -> DataFrame:
    """Weighted mean of accepted floors. Curves are of instability already; with double_invert
    the floors of inverted metrics are turned round once more, as published scores were."""
    floor = F.when(F.col("metric").isin(*INVERTED), 1 - F.col("floor")).otherwise(F.col("floor")) if double_invert else F.col("floor")
    w = F.lit(None).cast("double")
    for m, v in weights.items():
        w = F.when(F.col("metric") == m, v).otherwise(w)
    use = fits.filter(~F.col("fit_failed") & ~F.col("anomalous") & F.col("floor").isNotNull()).withColumns({"_w": w, "_f": floor})
    value = F.try_divide(F.sum(F.col("_w") * F.col("_f")), F.sum("_w")).alias("complexity")
    return use.groupBy(*by).agg(value) if by else use.agg(value)


def fallback_score(points: DataFrame, weights: dict[str, float] = DEFAULT_SHAP_WEIGHTS) -> DataFrame:
    """Without an accepted fit: the last pool's means, each turned to an instability, weighted."""
    last = points.groupBy("metric").agg(F.max_by("mean", "pool_size").alias("mean"))
    w = F.lit(None).cast("double")
    for m, v in weights.items():
        w = F.when(F.col("metric") == m, v).otherwise(w)
    return instability(last).withColumn("_w", w).agg(F.try_divide(F.sum(F.col("_w") * F.col("mean")), F.sum("_w")).alias("complexity"))


def feature_complexity(features: DataFrame, weights: dict[str, float] = DEFAULT_SHAP_WEIGHTS) -> DataFrame:
    """Per feature of a `feature_metrics` table: the weighted mean of its instabilities."""
    terms = [(w, 1 - F.col(m) if m in INVERTED else F.col(m)) for m, w in weights.items()]
    top = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in terms), F.lit(0.0))
    bottom = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in terms), F.lit(0.0))
    return features.withColumn("complexity_score", F.try_divide(top, bottom))


def pool_points(by_pool: DataFrame) -> DataFrame:
    """(pool_size, metric, mean) of several pools as curve points; a pool without metrics has null means."""
    pools, names = by_pool.select("pool_size").distinct(), by_pool.filter("metric is not null").select("metric").distinct()
    return pools.crossJoin(F.broadcast(names)).join(by_pool, ["pool_size", "metric"], "left")  # a row for each pool and metric


def fit_curves(points: DataFrame, **options) -> DataFrame:
    """Learning curves of attribution metrics (pool_size, metric, mean)."""
    return curves.fit(instability(points).withColumn("_all", F.lit(0)), ["_all"], **options).drop("_all")
