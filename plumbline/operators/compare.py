"""Marginal against attribution stability: quadrants, classes and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import spearman


def join_scores(marginal: DataFrame, attribution: DataFrame) -> DataFrame:
    """(feature, marginal_complexity, shap_complexity) of features that have both."""
    a = marginal.select("feature", F.col("complexity_score").alias("marginal_complexity"))
    b = attribution.select("feature", F.col("complexity_score").alias("shap_complexity"))
    return a.join(b, "feature").na.drop()


def thresholds(both: DataFrame, nulls: DataFrame | None = None, marginal: float | None = None, shap: float | None = None, null_percentile: float = 95) -> DataFrame:
    """One row (marginal_threshold, shap_threshold, threshold_source): given, else the percentile
    of pooled null scores, else the median. All null with fewer than 3 features."""
    got = both.agg(F.percentile("marginal_complexity", F.lit(0.5)).alias("m"), F.percentile("shap_complexity", F.lit(0.5)).alias("s"), F.count("*").alias("n"))
    if nulls is not None:
        pooled = nulls.filter(F.col("score").isNotNull() & ~F.isnan("score")).agg(F.percentile("score", F.lit(null_percentile / 100)).alias("p"))
    else:
        pooled = both.sparkSession.range(1).select(F.lit(None).cast("double").alias("p"))
    got = got.crossJoin(pooled)  # one row each
    enough = F.col("n") >= 3
    m = F.lit(marginal) if marginal is not None else F.coalesce("p", "m")
    source = F.lit("user_supplied") if marginal is not None else F.when(F.col("p").isNotNull(), "permutation_calibrated").otherwise("median")
    return got.select(F.when(enough, m).alias("marginal_threshold"), F.when(enough, F.lit(shap) if shap is not None else F.col("s")).alias("shap_threshold"), F.when(enough, source).alias("threshold_source"))


def quadrants(both: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `quadrant`, by strictly greater than the thresholds."""
    met = both.crossJoin(F.broadcast(limits))  # one row
    m, s = F.col("marginal_complexity") > F.col("marginal_threshold"), F.col("shap_complexity") > F.col("shap_threshold")
    name = F.when(m & s, "concordant_unstable").when(m & ~s, "false_alarm").when(~m & s, "missed_risk").when(~m & ~s, "concordant_stable")
    return met.select("feature", "marginal_complexity", "shap_complexity", name.alias("quadrant"))


class MarginalVsAttribution:
    def __init__(self, marginal_threshold: float | None = None, shap_threshold: float | None = None, null_percentile: float = 95):
        self.limits = (marginal_threshold, shap_threshold, null_percentile)

    def compare(self, marginal: DataFrame, attribution: DataFrame, nulls: DataFrame | None = None) -> dict[str, DataFrame]:
        both = join_scores(marginal, attribution).persist()
        m, s, p = self.limits
        limits = thresholds(both, nulls, m, s, p)
        rows = quadrants(both, limits)
        return {"comparison": rows, "thresholds": limits, "counts": rows.groupBy("quadrant").agg(F.count("*").alias("n")), "correlation": spearman(both, [], "marginal_complexity", "shap_complexity")}


def _above(c: Column, limit: float) -> Column:
    return F.coalesce(c > limit, F.lit(False))


def five_way(marginal: Column, shap: Column, drift: Column, high: float = 0.5, drift_high: float = 0.3) -> Column:
    m, s = _above(marginal, high), _above(shap, high)
    return F.when(m & ~s, "FALSE_ALARM").when(s & ~m, "MISSED_RISK").when(m & s, "CONFIRMED_UNSTABLE").when(_above(drift, drift_high), "HOLDOUT_DRIFT").otherwise("STABLE")


def divergence(marginal: Column, shap_drift: Column) -> Column:
    m_high, m_low, s_high, s_low = marginal > 0.3, marginal < 0.15, shap_drift > 0.25, shap_drift < 0.15
    return F.when(m_high & s_low, "FALSE ALARM").when(m_low & s_high, "MISSED RISK").when(m_low & s_low, "Agree (Stable)").when(m_high & s_high, "Agree (Unstable)").otherwise("Mixed")


def stability_tier(complexity: Column) -> Column:
    return F.when(complexity < 0.02, "stable").when(complexity < 0.05, "moderate").when(complexity.isNotNull(), "unstable")


def agreement_band(rho: Column) -> Column:
    r = F.abs(rho)
    bands = ((0.9, "Very strong agreement"), (0.7, "Strong agreement"), (0.5, "Moderate agreement"), (0.3, "Weak agreement"))
    out = F.lit("Very weak / no agreement")
    for least, name in reversed(bands):
        out = F.when(r >= least, name).otherwise(out)
    return F.when(rho.isNotNull(), out)


def rank_conflict(importance_rank: Column, complexity_rank: Column, n: Column) -> Column:
    """Features in opposite thirds of importance and of stability."""
    third, two = F.floor(n / 3), F.floor(2 * n / 3)
    return F.when((importance_rank <= third) & (complexity_rank > two), "important_unstable").when((importance_rank > two) & (complexity_rank <= third), "unimportant_stable").otherwise("none")


def master_table(base: DataFrame, parts: list[DataFrame], key: str = "feature") -> DataFrame:
    """Left joins of summaries, one row for each feature."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, base)


def complexity_shift(dev: DataFrame, holdout: DataFrame) -> DataFrame:
    """(feature, dev, holdout, shift) sorted by the largest change."""
    a = dev.select("feature", F.col("complexity_score").alias("dev_complexity"))
    b = holdout.select("feature", F.col("complexity_score").alias("holdout_complexity"))
    shift = F.abs(F.col("holdout_complexity") - F.col("dev_complexity")).alias("abs_shift")
    return a.join(b, "feature").select("feature", "dev_complexity", "holdout_complexity", shift).orderBy(F.desc_nulls_last("abs_shift"), "feature")


def set_overlap(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sizes of two feature sets' intersection, union and differences, and their ratio."""
    by = by or []
    met = a.select(*by, "feature", F.lit(1).alias("_a")).join(b.select(*by, "feature", F.lit(1).alias("_b")), [*by, "feature"], "full")
    both, either = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)), F.count("*")
    return (met.groupBy(*by) if by else met).agg(both.alias("n_both"), either.alias("n_either"), (F.count("_a") - both).alias("only_a"), (F.count("_b") - both).alias("only_b"), F.try_divide(both.cast("double"), either.cast("double")).alias("jaccard"))
