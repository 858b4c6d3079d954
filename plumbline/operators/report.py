"""Texts, plot data and exports of results. Inputs have a row for each feature, pool or bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import reliability
from plumbline.operators.analyzer import Panel


def panel_report(panel: Panel, n: int = 20) -> str:
    """The most stable features first, then the evidence bins that are not stable."""
    lines = [f"{'feature':<30} {'complexity':>12} {'kind':<12} flags"]
    for r in panel.summary.limit(n).collect():
        flags = ", ".join(f for f in ("imbalance", "censoring") if r[f"{f}_flag"])
        score = "-" if r["complexity_score"] is None else f"{r['complexity_score']:.4f}"
        lines.append(f"{r['feature']:<30} {score:>12} {r['feature_type']:<12} {flags}")
    for r in panel.woe_profiles.filter("status <> 'stable'").orderBy("feature", "bin").limit(n).collect():
        lines.append(f"{r['feature']} bin {r['bin'] + 1}: {r['status']} (sd {r['sd']:.3f}, flips {r['flip_rate']:.2f})")
    lines += [f"{f}: left out, {why}" for f, why in sorted(panel.skipped.items())]
    return "\n".join(lines)


def curve_plot_data(panel: Panel, n_points: int = 50) -> DataFrame:
    """(feature, metric, series, pool_size, value, low, high): measured points, and the fitted curve with its own exponent."""
    measured = panel.learning_curves.select("feature", "metric", F.lit("measured").alias("series"), F.col("pool_size").cast("double").alias("pool_size"), F.col("mean").alias("value"), (F.col("mean") - F.col("stderr")).alias("low"), (F.col("mean") + F.col("stderr")).alias("high"))
    ends = panel.learning_curves.groupBy("feature", "metric").agg(F.min("pool_size").alias("a"), F.max("pool_size").alias("b"))
    at = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / F.lit(float(n_points - 1))
    grid = panel.fits.filter("not fit_failed").join(ends, ["feature", "metric"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1)))).withColumn("n", at)
    value = F.col("k") / F.pow("n", F.col("alpha")) + F.col("floor")
    fitted = grid.select("feature", "metric", F.lit("fitted").alias("series"), F.col("n").alias("pool_size"), value.alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    return measured.unionByName(fitted)


def panel_plot_data(panel: Panel, n: int = 20) -> DataFrame:
    return panel.summary.filter("complexity_score is not null").select("feature", "complexity_score", "imbalance_flag", "censoring_flag").limit(n)


# -- exports -----------------------------------------------------------------------------------


def tier(complexity: Column, importance: Column) -> Column:
    """Use, watch or review, by complexity on the scale of 0 to 100."""
    return F.when((complexity < 10) & (importance > 0.03), "use").when(complexity.between(10, 100), "watch").when(complexity > 100, "review").otherwise("other")


def stability_export(rows: DataFrame) -> DataFrame:
    """(feature, complexity_score) with `stable` (below 50)."""
    return rows.select("feature", "complexity_score", (F.col("complexity_score") < 50).alias("stable"))


def reliability_export(rows: DataFrame) -> DataFrame:
    """Full: bounds of exported scales (complexity to 100, spread to 5), with score and grade."""
    config = reliability.ReliabilityConfig(complexity=(0.0, 100.0), cross_seed_std=(0.0, 5.0))
    return reliability.ReliabilityScorer(config).compute_all(rows)


def shift_export(dev_holdout: DataFrame) -> DataFrame:
    """(feature, dev_complexity, holdout_complexity): the shift, flagged beyond 50."""
    shift = F.col("holdout_complexity") - F.col("dev_complexity")
    return dev_holdout.withColumns({"shift": shift, "flagged": F.abs(shift) > 50})


def interval_export(rows: DataFrame, width: float = 10.0) -> DataFrame:
    """(feature, complexity_score, cross_seed_std): a stand-in interval of so many spreads."""
    half = F.lit(width) * F.col("cross_seed_std")
    return rows.withColumns({"ci_lower": F.col("complexity_score") - half, "ci_upper": F.col("complexity_score") + half})


def markdown(df: DataFrame, title: str, n: int = 50) -> str:
    """A summary's first rows as a table."""
    rows = df.limit(n).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("document"))
