"""Checks of a feature and its target before any sampling, all features in one aggregation each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import clean, exact_percentile, numeric_columns

# -- fixed values: metric names by what they need ------------------------------------
TARGET_AGNOSTIC_METRICS = ("wasserstein", "ks", "js")
TARGET_DEPENDENT_METRICS = ("spearman", "iv", "monotonicity")
SHAP_TARGET_AGNOSTIC_METRICS = ("rank_stability", "wasserstein", "js_divergence", "magnitude_cv", "magnitude_iqr", "topk_overlap")
SHAP_TARGET_DEPENDENT_METRICS = ("direction_consistency",)
#: Event share below which an imbalance has this name, and its factor on the least events.
IMBALANCE = ((0.01, "critical", 3.0), (0.05, "severe", 2.0), (0.10, "moderate", 1.5))
# -- end of fixed values ---------------------------------------------------------------


class ImbalanceError(ValueError):
    """The rarer class is rarer than the threshold allows."""


def metric_category(name: str) -> str:
    low = name.lower()
    if low in TARGET_AGNOSTIC_METRICS:
        return "target_agnostic"
    return "target_dependent" if low in TARGET_DEPENDENT_METRICS else "unknown"


def to_long_with(df: DataFrame, features: list[str], target: str | None, carried: list[str]) -> DataFrame:
    """Rows (carried..., feature, x, y) of complete pairs: NaN and null are left out per feature."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), clean(f).alias("x")) for f in features)))
    y = clean(target).cast("int") if target else F.lit(None).cast("int")
    rows = df.select(*carried, pairs.alias("p"), y.alias("y")).select(*carried, "p.feature", "p.x", "y")
    keep = F.col("x").isNotNull()
    return rows.filter(keep & F.col("y").isNotNull() if target else keep)


def to_long(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Rows (feature, x, y) of complete pairs."""
    return to_long_with(df, features, target, [])


def severity(minority: Column) -> Column:
    out = F.lit("none")
    for most, name, _ in reversed(IMBALANCE):
        out = F.when(minority < most, name).otherwise(out)
    return out


def imbalance(df: DataFrame, target: str, threshold: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """event_rate, minority_rate, severity and imbalance_flag of a 0/1 target, per group if given."""
    y = clean(target).cast("int")
    rate = df.groupBy(*(by or [])).agg(F.avg(y).alias("event_rate"), F.count(y).alias("n_obs"))
    minority = F.least("event_rate", 1 - F.col("event_rate"))
    return rate.withColumns({"minority_rate": minority, "severity": severity(minority), "imbalance_flag": minority < threshold})


def require_balance(row, allow: bool) -> None:
    if row["imbalance_flag"] and not allow:
        raise ImbalanceError(f"the rarer class is {row['minority_rate']:.4f} of the rows ({row['severity']}); allow_imbalance=True goes on")


def least_events(base: int, severity_name: str) -> int:
    factor = next((f for _, name, f in IMBALANCE if name == severity_name), 1.0)
    return math.ceil(base * factor)


def feature_kind(n_distinct: Column, threshold: int = 10) -> Column:
    return F.when(n_distinct == 2, "binary").when(n_distinct <= threshold, "categorical").otherwise("continuous")


def kinds(long: DataFrame, threshold: int = 10) -> DataFrame:
    """Per feature: n_obs, n_distinct, kind. Exact counts, since the limits are hard."""
    counted = long.groupBy("feature", "x").agg(F.count("*").alias("n")).groupBy("feature").agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_distinct"))
    return counted.withColumn("kind", feature_kind(F.col("n_distinct"), threshold))


def truncation(long: DataFrame, spike: float = 0.10, least_rows: int = 100) -> DataFrame:
    """Per feature: shares at the exact minimum and maximum, mass next to them, flags and severities.

    Two aggregations over value counts: the range first, then the masses.
    """
    values = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    ends = values.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n_obs"), F.count("*").alias("n_distinct"))
    v = values.join(ends.select("feature", "low", "high"), "feature")
    span = F.col("high") - F.col("low")
    near = lambda outer, low: F.col("x") <= F.col("low") + outer * span if low else F.col("x") >= F.col("high") - outer * span
    mass = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    masses = v.groupBy("feature").agg(
        mass(F.col("x") == F.col("low")).alias("at_low"),
        mass(F.col("x") == F.col("high")).alias("at_high"),
        mass(near(0.01, True)).alias("outer_low"),
        mass(near(0.05, True) & ~near(0.01, True)).alias("band_low"),
        mass(near(0.01, False)).alias("outer_high"),
        mass(near(0.05, False) & ~near(0.01, False)).alias("band_high"),
    )
    m = ends.join(masses, "feature")
    enough = (F.col("n_obs") >= least_rows) & (F.col("n_distinct") > 2)
    out = {}
    for side in ("low", "high"):
        share = F.col(f"at_{side}") / F.col("n_obs")
        outer, band = F.col(f"outer_{side}") / F.col("n_obs"), F.col(f"band_{side}") / F.col("n_obs")
        ratio = F.when(band > 0, outer / band).otherwise(F.lit(0.0))
        spiked = enough & ((share > spike) | ((band > 0) & (ratio > 3)))
        severity_ = 0.5 * F.least(share, F.lit(1.0)) + 0.3 * F.least(ratio / 20, F.lit(1.0)) + 0.2 * F.least(outer, F.lit(1.0))
        out |= {f"share_{side}": share, f"flag_{side}": spiked, f"severity_{side}": F.when(spiked, severity_).otherwise(F.lit(0.0))}
    m = m.withColumns(out)
    note = F.when(F.col("n_obs") < least_rows, "insufficient samples").when(F.col("n_distinct") <= 2, "binary").otherwise("checked")
    return m.select(
        "feature", "n_obs", "share_low", "share_high", "flag_low", "flag_high", "severity_low", "severity_high",
        (F.col("flag_low") | F.col("flag_high")).alias("censoring_flag"), F.greatest("severity_low", "severity_high").alias("censoring_severity"), note.alias("note"),
    )


def snapshot(df: DataFrame, features: list[str] | None = None, target: str | None = None, threshold: int = 10) -> DataFrame:
    """One row: rows, features, event rate, and how many features are of each kind."""
    features = features or numeric_columns(df, (target,) if target else ())
    k = kinds(to_long(df, features), threshold)
    counts = k.agg(*(F.count(F.when(F.col("kind") == name, 1)).alias(f"n_{name}") for name in ("binary", "categorical", "continuous")))
    size = df.agg(F.count("*").alias("n_rows"), F.lit(len(features)).cast("long").alias("n_features"), (F.avg(clean(target)) if target else F.lit(None).cast("double")).alias("event_rate"))
    return size.crossJoin(counts)  # one row each


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (name, null_share), NaN counted as null."""
    shares = df.agg(*(F.avg(clean(c).isNull().cast("double")).alias(c) for c in columns))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("null_share")) for c in columns))).alias("p")).select("p.*")


def drop_sparse(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    shares = {r["name"]: r["null_share"] or 0.0 for r in null_shares(df, columns).collect()}  # one row for each column
    return df.drop(*(c for c, s in shares.items() if s > most))


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median."""
    medians = df.agg(*(exact_percentile(clean(c), 0.5).alias(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(clean(c), F.lit(medians[c])) for c in columns})


def winsorise(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond the two exact quantiles become them."""
    ends = df.agg(*(exact_percentile(clean(c), low, high).alias(c) for c in columns)).first()
    return df.withColumns({c: F.when(clean(c).isNotNull(), F.least(F.greatest(clean(c), F.lit(ends[c][0])), F.lit(ends[c][1]))) for c in columns if ends[c]})

