"""Reliability of features: importance, stability, coverage and consistency in one score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import clean, clip

# -- fixed values: grades -----------------------------------------------------------------
GRADES = ((0.8, "A"), (0.6, "B"), (0.4, "C"), (0.2, "D"))
SIMPLE_GRADES = ((0.1, "A"), (0.05, "B"), (0.02, "C"), (0.01, "D"))
# -- end of fixed values --------------------------------------------------------------------

METHODS = ("minmax", "rank", "zscore")


@dataclass(frozen=True)
class ReliabilityConfig:
    """Weights (summing to 1), how series are normalised, and the bounds of single values."""

    importance_weight: float = 0.30
    stability_weight: float = 0.40
    coverage_weight: float = 0.15
    consistency_weight: float = 0.15
    normalization_method: str = "minmax"
    complexity: tuple[float, float] = (0.0, 1.0)
    importance: tuple[float, float] = (0.0, 1.0)
    coverage: tuple[float, float] = (0.0, 1.0)
    cross_seed_std: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self):
        weights = self.importance_weight + self.stability_weight + self.coverage_weight + self.consistency_weight
        if abs(weights - 1) > 1e-6:
            raise ValueError(f"weights sum to {weights}, not 1")
        if self.normalization_method not in METHODS:
            raise ValueError(f"unknown normalization: {self.normalization_method}")
        for name in ("complexity", "importance", "coverage", "cross_seed_std"):
            low, high = getattr(self, name)
            if high <= low:
                raise ValueError(f"bounds of {name} are empty")

    def formula(self) -> str:
        return f"{self.importance_weight:g} * importance + {self.stability_weight:g} * stability + {self.coverage_weight:g} * coverage + {self.consistency_weight:g} * consistency"


INPUTS = ("complexity_score", "importance_score", "coverage_ratio", "cross_seed_std")


def bounded(c: Column, low: float, high: float, invert: bool = False) -> Column:
    """The value's place between fixed bounds, held to [0, 1]; null gives one half."""
    place = clip((clean(c) - low) / (high - low), 0, 1)
    return F.coalesce(1 - place if invert else place, F.lit(0.5))


def in_series(c: Column, method: str, invert: bool = False) -> Column:
    """The value's place among all rows: a summary has a row for each feature. Constant gives one half, null stays null."""
    c, whole = clean(c), Window.partitionBy()
    low, high = F.min(c).over(whole), F.max(c).over(whole)
    if method == "rank":
        place = (F.rank().over(Window.orderBy(c.asc_nulls_last())) + (F.count(c).over(Window.partitionBy(c)) - 1) / 2.0) / F.count(c).over(whole)
        constant = F.lit(False)
    else:  # a linear map to [0, 1] does not change by shifting and scaling first
        place = F.try_divide(c - low, high - low)
        constant = low == high
        if method == "zscore":
            constant = constant | F.coalesce(F.stddev_samp(c).over(whole) == 0, F.lit(True))
    place = 1 - place if invert else place
    return F.when(F.coalesce(constant, F.lit(True)), 0.5).when(c.isNotNull(), place)


def score(df: DataFrame, config: ReliabilityConfig = ReliabilityConfig(), series: bool = False) -> DataFrame:
    """Adds the four components and reliability_score to rows with the INPUTS columns.

    series True places each value among all rows instead of between the bounds.
    """
    place = (lambda c, _, invert: in_series(F.col(c), config.normalization_method, invert)) if series else (lambda c, b, invert: bounded(F.col(c), *b, invert))
    got = df.withColumns({
        "stability_component": place("complexity_score", config.complexity, True),
        "importance_component": place("importance_score", config.importance, False),
        "coverage_component": place("coverage_ratio", config.coverage, False),
        "consistency_component": place("cross_seed_std", config.cross_seed_std, True),
    })
    c = config
    total = c.importance_weight * F.col("importance_component") + c.stability_weight * F.col("stability_component") + c.coverage_weight * F.col("coverage_component") + c.consistency_weight * F.col("consistency_component")
    return got.withColumn("reliability_score", total)


def grade(c: Column, grades=GRADES) -> Column:
    out = F.lit("F")
    for least, name in reversed(grades):
        out = F.when(c >= least, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def simple_score(importance: Column, complexity: Column) -> Column:
    """Importance, lowered by a complexity between -300 and 200."""
    return importance * (1 - clip((complexity + 300) / 500.0, 0, 1))


class ReliabilityScorer:
    def __init__(self, config: ReliabilityConfig = ReliabilityConfig()):
        self.config = config

    def compute(self, spark, feature_name: str, complexity_score: float, importance_score: float, coverage_ratio: float = 1.0, cross_seed_std: float = 0.0) -> dict:
        row = [(feature_name, complexity_score, importance_score, coverage_ratio, cross_seed_std)]
        df = spark.createDataFrame(row, "feature_name string, complexity_score double, importance_score double, coverage_ratio double, cross_seed_std double")
        return score(df, self.config).withColumn("grade", grade(F.col("reliability_score"))).first().asDict() | {"formula": self.config.formula()}

    def compute_all(self, df: DataFrame, series: bool = False) -> DataFrame:
        got = score(df, self.config, series)
        return got.withColumn("grade", grade(F.col("reliability_score"))).orderBy(F.desc_nulls_last("reliability_score"))
