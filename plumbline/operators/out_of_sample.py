"""A fitted reference as tables, and later samples measured against it without reading its rows again.

`Reference.fit` keeps, per feature, what the metrics need of the reference sample: sizes,
range, bandwidth and scale, the density on its grid, and the counts of its values (which are
its distribution function and its category shares). They can be written and read back.
`Reference.apply` treats a later sample as one resample: the same metrics, the same formulas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.operators import checks, curves, marginal
from plumbline.operators.ranking import buckets_for, running_totals, spearman, value_cuts

PARTS = ("facts", "density", "steps")
METRICS = ("wasserstein", "ks", "js", "spearman", "iv", "monotonicity")
#: The metrics that a composite weighs: all but monotonicity.
COMPOSITE = {m: w for kind in ("distributional", "target_dependent") for m, w in curves.DEFAULT_WEIGHTS[kind].items() if m != "monotonicity"}


@dataclass
class Reference:
    """facts: a row per feature; density: (feature, g, p); steps: (feature, x, cnt) of each value."""

    facts: DataFrame
    density: DataFrame
    steps: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], target: str | None = None, threshold: int = 10) -> Reference:
        """Reads the sample once; what follows works on the counts of its values."""
        hold = Written(df.sparkSession)
        counts = hold(marginal.full_sample(checks.to_long(df, features, target)))
        steps = hold(counts.groupBy("feature", "x").agg(F.sum("cnt").alias("cnt")))
        n = steps.groupBy("feature").agg(F.count("*").alias("n_distinct"))
        buckets = buckets_for(n.agg(F.max("n_distinct")).first()[0] or 0)
        cuts = value_cuts(steps, ["feature"], "x", buckets) if buckets > 1 else None
        values = marginal.value_table(counts.withColumn("y", F.coalesce("y", F.lit(0))), ["feature"], cuts, ["feature"])
        facts = marginal.reference(values, ["feature"]).join(n.withColumn("kind", checks.feature_kind(F.col("n_distinct"), threshold)).drop("n_distinct"), "feature")
        facts = hold(facts)
        return cls(facts, hold(marginal.densities(steps.withColumn("y", F.lit(0)), ["feature"], facts, ["feature"])), steps)

    def write(self, path: str, mode: str = "error") -> None:
        for part in PARTS:
            getattr(self, part).write.mode(mode).parquet(f"{path.rstrip('/')}/{part}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Reference:
        return cls(*(spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in PARTS))

    def apply(self, df: DataFrame, features: list[str] | None = None, target: str | None = None, n_bins: int = 5, by_category: bool = True) -> DataFrame:
        """Per feature that both samples have: kind, degenerate, and the six metrics of the later sample (null if degenerate).

        by_category: features of few values in the reference are measured by shares of
        their values, total variation in the place of wasserstein.
        """
        hold = Written(df.sparkSession)
        features = features or [r["feature"] for r in self.facts.select("feature").collect()]  # a row for each feature
        samples = hold(marginal.full_sample(checks.to_long(df, features, target)).join(F.broadcast(self.facts.select("feature")), "feature"))
        own = samples.groupBy("feature", "x").agg(F.sum("cnt").alias("c"))
        # both samples' counts side by side give the reference's shares below and up to each later value
        both = own.select("feature", "x", "c", F.lit(0).alias("c0")).unionByName(self.steps.select("feature", "x", F.lit(0).alias("c"), F.col("cnt").alias("c0")))
        both = both.groupBy("feature", "x").agg(F.sum("c").alias("c"), F.sum("c0").alias("c0"))
        shares = running_totals(both, ["feature"], "x", ["c0"]).filter("c > 0").join(F.broadcast(self.facts.select("feature", "n")), "feature")
        shares = shares.select("feature", "x", (F.col("below_c0") / F.col("n")).alias("f0_below"), ((F.col("below_c0") + F.col("c0")) / F.col("n")).alias("f0_upto"))
        samples = hold(samples.join(shares, ["feature", "x"]))
        buckets = buckets_for(samples.groupBy("feature").count().agg(F.max("count")).first()[0] or 0)
        cuts = value_cuts(samples, ["feature"], "x", buckets) if buckets > 1 else None
        few = F.col("kind").isin("binary", "categorical") if by_category else F.lit(False)
        kinds = self.facts.select("feature", "kind", few.alias("few"))
        met = samples.join(F.broadcast(kinds), "feature")
        wide, flags = marginal.continuous_metrics(met.filter("not few").drop("kind", "few"), ["feature"], self.facts, self.density, target is not None, n_bins, cuts)
        if by_category:
            some, more = marginal.categorical_metrics(met.filter("few").drop("kind", "few"), ["feature"], self.steps, target is not None, cuts)
            wide, flags = wide.unionByName(some), flags.unionByName(more)
        return kinds.drop("few").join(flags, "feature").join(wide.select("feature", *METRICS), "feature", "left")


def composite(metrics: DataFrame, weights: dict[str, float] | None = None, name: str = "composite") -> DataFrame:
    """Adds the weighted mean of the metrics' absolute values; null and non-finite ones are left out."""
    weights = COMPOSITE if weights is None else weights
    good = {m: F.when(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")), F.abs(m)) for m in weights}
    top = sum((F.coalesce(w * good[m], F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(good[m].isNotNull(), w).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    return metrics.withColumn(name, F.try_divide(top, bottom))


def against_scores(scores: DataFrame, later: DataFrame, score: str = "complexity_score", value: str = "composite") -> DataFrame:
    """One row: how far scores from before rank features as their later shift does: rho, n, and
    the mean later shift of the lower and of the upper half of the scores."""
    met = scores.select("feature", score).join(later.select("feature", value), "feature").filter(F.col(score).isNotNull() & F.col(value).isNotNull())
    middle = met.agg(F.percentile(score, F.lit(0.5)).alias("_mid"))  # a row for each feature
    halves = met.crossJoin(F.broadcast(middle)).agg(F.avg(F.when(F.col(score) <= F.col("_mid"), F.col(value))).alias("stable_mean"), F.avg(F.when(F.col(score) > F.col("_mid"), F.col(value))).alias("unstable_mean"))
    return spearman(met, [], score, value).crossJoin(halves)  # one row each
