"""Train against holdout: attribution drift per feature, overall, and graded."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.marginal import wasserstein_two_sample

# -- fixed values: weights, limits and grades of drift ---------------------------------
WEIGHTS = {"rank_correlation": 0.30, "direction_flip_rate": 0.30, "topk_overlap": 0.20, "magnitude_drift": 0.20}
FLAGS = {"rank_correlation": 0.8, "direction_flip_rate": 0.15, "magnitude_drift": 0.30, "topk_overlap": 0.7}
GRADES = ((0.10, "A"), (0.25, "B"), (0.40, "C"), (0.60, "D"))
DRIFTED = 0.25
TINY = 1e-10
# -- end of fixed values -----------------------------------------------------------------


@dataclass(frozen=True)
class DriftSettings:
    top_k: int = 10
    weights: dict = field(default_factory=lambda: WEIGHTS)


def summarise(phi: DataFrame) -> DataFrame:
    """Per feature of (sample, feature, phi): importance, its sd, mean, share positive, ordinal rank (ties: smaller feature first)."""
    s = phi.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("importance"), F.stddev_pop(F.abs("phi")).alias("importance_sd"), F.avg("phi").alias("mean_phi"), F.avg((F.col("phi") > 0).cast("double")).alias("share_positive")
    )
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row for each feature


def feature_drift(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per feature of two tables (sample, feature, phi)."""
    side = lambda d, n: summarise(d).select("feature", F.col("rank").alias(f"rank_{n}"), F.col("importance").alias(f"magnitude_{n}"), F.when(F.col("mean_phi") < 0, -1).otherwise(1).alias(f"sign_{n}"))
    met = side(train, "train").join(side(holdout, "holdout"), "feature")
    met = met.join(wasserstein_two_sample(train, holdout, ["feature"], "phi"), "feature")
    n = F.count("*").over(Window.partitionBy())
    change = F.col("rank_train") - F.col("rank_holdout")
    ratio = F.col("magnitude_holdout") / (F.col("magnitude_train") + TINY)
    same = F.col("sign_train") == F.col("sign_holdout")
    score = F.when(same, 0.0).otherwise(0.4) + 0.3 * F.least(F.abs(change) / n, F.lit(1.0)) + 0.3 * F.least(F.abs(ratio - 1) / 2, F.lit(1.0))
    return met.select("feature", "rank_train", "rank_holdout", change.alias("rank_change"), "magnitude_train", "magnitude_holdout", ratio.alias("magnitude_ratio"), same.alias("direction_consistent"), "wasserstein", score.alias("drift_score"))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for most, name in reversed(GRADES):
        out = F.when(score < most, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def overall_score(rho: Column, flips: Column, overlap: Column, magnitude: Column, weights: dict = WEIGHTS) -> Column:
    parts = {
        "rank_correlation": 1 - F.greatest(rho, F.lit(0.0)),
        "direction_flip_rate": flips,
        "topk_overlap": 1 - overlap,
        "magnitude_drift": F.least(magnitude, F.lit(1.0)),
    }
    score = sum((F.lit(weights[k]) * v for k, v in parts.items()), F.lit(0.0)) / F.lit(sum(weights.values()))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def overall(features: DataFrame, top_k: int = 10, weights: dict = WEIGHTS) -> DataFrame:
    """One row of a `feature_drift` table: the four components, flags, score, grade, and how many features drifted."""
    both = F.count(F.when((F.col("rank_train") <= top_k) & (F.col("rank_holdout") <= top_k), 1))
    either = F.count(F.when((F.col("rank_train") <= top_k) | (F.col("rank_holdout") <= top_k), 1))
    got = features.agg(
        F.when(F.count("*") > 1, F.corr(F.col("rank_train").cast("double"), F.col("rank_holdout").cast("double"))).alias("rank_correlation"),
        F.avg((~F.col("direction_consistent")).cast("double")).alias("direction_flip_rate"),
        F.avg(F.abs(F.col("magnitude_holdout") - F.col("magnitude_train")) / (F.col("magnitude_train") + TINY)).alias("magnitude_drift"),
        F.try_divide(both.cast("double"), either.cast("double")).alias("topk_overlap"),
        F.count(F.when(F.col("drift_score") > DRIFTED, 1)).alias("n_drifted"),
    )
    score = overall_score(F.col("rank_correlation"), F.col("direction_flip_rate"), F.col("topk_overlap"), F.col("magnitude_drift"), weights)
    got = got.withColumn("overall_drift_score", score).withColumn("drift_grade", grade(F.col("overall_drift_score")))
    below, above = ("rank_correlation", "topk_overlap"), ("direction_flip_rate", "magnitude_drift")
    return got.withColumns({f"flag_{c}": F.col(c) < FLAGS[c] for c in below} | {f"flag_{c}": F.col(c) > FLAGS[c] for c in above})


class TrainHoldoutStability:
    """compare: both tables of one call. phi tables have sample, feature, phi."""

    def __init__(self, **settings):
        self.settings = DriftSettings(**settings)

    def compare(self, train: DataFrame, holdout: DataFrame) -> dict[str, DataFrame]:
        features = feature_drift(train, holdout).persist()
        return {"features": features, "overall": overall(features, self.settings.top_k, self.settings.weights)}


def report(features: DataFrame, overall_row: DataFrame, n: int = 10) -> str:
    """Text: the score and the n features that drifted most."""
    o = overall_row.first()
    lines = [f"Overall drift {o['overall_drift_score']:.4f}, grade {o['drift_grade']}; {o['n_drifted']} features drifted"]
    for r in features.orderBy(F.desc("drift_score"), "feature").limit(n).collect():
        lines.append(f"{r['feature']!s:<30} {r['drift_score']:.4f}  rank {r['rank_train']} to {r['rank_holdout']}" + ("" if r["direction_consistent"] else "  sign flips"))
    return "\n".join(lines)
