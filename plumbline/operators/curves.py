"""Learning curves: metric means by pool size, fitted by k / n^alpha + floor, and scored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values: weights of the score -------------------------------------------------
DEFAULT_WEIGHTS = {
    "target_dependent": {"spearman": 0.40, "monotonicity": 0.30, "iv": 0.30},
    "distributional": {"wasserstein": 0.45, "ks": 0.30, "js": 0.25},
}
# -- end of fixed values -----------------------------------------------------------------

METRICS = ("wasserstein", "ks", "js", "spearman", "iv", "monotonicity")


def instability_long(wide: DataFrame, by: list[str], degenerate_as: float | None = 1.0) -> DataFrame:
    """Rows (by, metric, value) of non-null metrics; monotonicity becomes 1 - score.

    degenerate_as: the monotonicity instability of groups whose values have too few
    quantiles for bins (None leaves them out).
    """
    binless = F.col("iv").isNull() & F.col("spearman").isNotNull() & F.col("woe_profile").isNull()
    mono = F.when(F.col("monotonicity").isNotNull(), 1 - F.col("monotonicity"))
    if degenerate_as is not None and "metric_type" in wide.columns:
        mono = F.when(binless & (F.col("metric_type") == "wasserstein"), F.lit(degenerate_as)).otherwise(mono)
    columns = {m: F.col(m) for m in METRICS if m != "monotonicity"} | {"monotonicity": mono}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in columns.items())))
    return wide.select(*by, rows.alias("p")).select(*by, "p.metric", "p.value").filter("value is not null")


def aggregate(long: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, metric, mean, stderr, n_values)."""
    n = F.count("value")
    stderr = F.when(n > 1, F.stddev_samp("value") / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), stderr.alias("stderr"), n.alias("n_values"))


def _regression(points: DataFrame, by: list[str], alpha: Column, extra: list[str] = ()) -> DataFrame:
    """Least squares of mean on pool_size^-alpha: k, floor, r2 (null if all means are equal), sse."""
    p = points.withColumn("_z", F.pow(F.col("pool_size").cast("double"), -alpha))
    y, z = F.col("mean"), F.col("_z")
    n, vy = F.count("*"), F.var_pop(y)
    k = F.regr_slope(y, z)
    r2 = F.when(vy > 0, F.regr_r2(y, z))
    return p.groupBy(*by, *extra).agg(
        k.alias("k"), F.regr_intercept(y, z).alias("floor"), r2.alias("r2"), F.when(vy > 0, (1 - F.regr_r2(y, z)) * vy * n).otherwise(F.lit(0.0)).alias("sse"),
        n.alias("n_points"), F.min("pool_size").alias("low"), F.max("pool_size").alias("high"),
    )


def fit(curves: DataFrame, by: list[str], fixed_alpha: float = 0.5, estimate_alpha: bool = False, alpha_bounds: tuple[float, float] = (0.1, 1.0), r2_threshold: float = 0.70, extrapolate_to: tuple[int, ...] = (500, 1000)) -> DataFrame:
    """Per (by, metric): k, floor, alpha, alpha_estimated, r2, r2_improvement, anomalous, fit_failed, extrapolations.

    With alpha given, the model is linear in k and floor. An estimated alpha is
    found on a grid of the bounds, each with its exact least squares, refined twice.
    Fewer than 3 points fail; an anomalous fit is one that explains too little or rises.
    """
    by = [*by, "metric"]
    points = curves.filter("mean is not null").select(*by, "pool_size", "mean")
    fixed = _regression(points, by, F.lit(fixed_alpha)).withColumn("alpha", F.lit(float(fixed_alpha)))
    best = fixed.withColumns({"alpha_estimated": F.lit(False), "r2_improvement": F.lit(None).cast("double")})
    if estimate_alpha:
        low, high = alpha_bounds
        step = (high - low) / 90
        centre = None
        for half, size in ((None, step), (20, step / 20), (20, step / 400)):
            if centre is None:
                tried = points.withColumn("_a", F.explode(F.array(*(F.lit(float(a)) for a in np.linspace(low, high, 91)))))
            else:
                grid = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda i: F.least(F.greatest(F.col("_c") + i * F.lit(size), F.lit(low)), F.lit(high)))
                tried = points.join(centre, by).withColumn("_a", F.explode(F.array_distinct(grid))).drop("_c")
            fits = _regression(tried, by, F.col("_a"), ["_a"])
            centre = fits.groupBy(*by).agg(F.min_by("_a", F.struct("sse", "_a")).alias("_c"))
        flexible = _regression(points.join(centre, by), by, F.col("_c"), ["_c"]).withColumnRenamed("_c", "alpha")
        flexible = flexible.join(fixed.select(*by, F.col("r2").alias("_fixed_r2")), by)
        best = flexible.withColumns({"alpha_estimated": F.lit(True), "r2_improvement": F.col("r2") - F.col("_fixed_r2")}).drop("_fixed_r2")
    best = best.filter("n_points >= 3")
    first, second = F.col("low").cast("double"), F.col("low") + (F.col("high") - F.col("low")) / 49.0
    rise = F.col("k") * (F.pow(second, -F.col("alpha")) - F.pow(first, -F.col("alpha")))
    at = lambda n: F.col("k") / F.pow(F.lit(float(n)), F.col("alpha")) + F.col("floor")
    extrapolated = F.map_from_arrays(F.array(*map(F.lit, extrapolate_to)), F.array(*map(at, extrapolate_to)))
    anomalous = F.col("r2").isNull() | (F.col("r2") < r2_threshold) | (rise > 1e-10)
    done = best.select(*by, "k", "floor", "alpha", "alpha_estimated", "r2", "r2_improvement", anomalous.alias("anomalous"), F.lit(False).alias("fit_failed"), extrapolated.alias("extrapolations"))
    groups = curves.select(*by).distinct()
    return groups.join(done, by, "left").withColumns({"fit_failed": F.coalesce("fit_failed", F.lit(True)), "anomalous": F.coalesce("anomalous", F.lit(True))})


def scores(fits: DataFrame, by: list[str], weights: dict[str, dict[str, float]] = DEFAULT_WEIGHTS, has_target: bool = True) -> DataFrame:
    """Per group: overall, target_agnostic, target_dependent: weighted means of the accepted floors."""
    of = {m: ("target_agnostic", w) for m, w in weights["distributional"].items()}
    if has_target:
        of |= {m: ("target_dependent", w) for m, w in weights["target_dependent"].items()}
    weight, kind = F.lit(None).cast("double"), F.lit(None).cast("string")
    for m, (name, w) in of.items():
        weight = F.when(F.col("metric") == m, w).otherwise(weight)
        kind = F.when(F.col("metric") == m, name).otherwise(kind)
    use = ~F.col("fit_failed") & ~F.col("anomalous") & F.col("floor").isNotNull()
    w = fits.withColumns({"_w": F.when(use, weight), "_k": kind})
    mean = lambda name: F.try_divide(
        F.sum(F.when(F.lit(True) if name is None else F.col("_k") == name, F.col("_w") * F.col("floor"))),
        F.sum(F.when(F.lit(True) if name is None else F.col("_k") == name, F.col("_w"))),
    )
    return w.groupBy(*by).agg(mean(None).alias("overall"), mean("target_agnostic").alias("target_agnostic"), mean("target_dependent").alias("target_dependent"))


def woe_stability(profiles: DataFrame, by: list[str], n_bins: int = 5) -> DataFrame:
    """Per (by, bin): mean, sd and flip rate of the evidence over all resamples; and the bin's status."""
    rows = profiles.filter("woe_profile is not null").select(*by, F.posexplode("woe_profile").alias("bin", "woe")).filter(F.col("bin") < n_bins)
    middle = rows.groupBy(*by, "bin").agg(F.percentile("woe", F.lit(0.5)).alias("_mid"))  # pools times resamples values each
    met = rows.join(middle, [*by, "bin"])
    flips = F.avg((F.signum("woe") != F.signum("_mid")).cast("double"))
    n = F.count("*")
    out = met.groupBy(*by, "bin").agg(F.avg("woe").alias("mean"), F.when(n > 1, F.stddev_samp("woe")).otherwise(F.lit(0.0)).alias("sd"), flips.alias("flip_rate"))
    return out.withColumn("status", bin_status(F.col("sd"), F.col("flip_rate")))


def bin_status(sd: Column, flip_rate: Column) -> Column:
    return F.when((sd < 0.15) & (flip_rate < 0.10), "stable").when(flip_rate > 0.30, "unstable").otherwise("noisy")


def degenerate_rates(flags: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the share of degenerate resamples, and whether it is over one half."""
    rate = F.avg(F.col("degenerate").cast("double"))
    return flags.groupBy(*by).agg(rate.alias("degenerate_rate"), (rate > 0.5).alias("high"))
