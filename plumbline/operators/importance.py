"""Model scores, collinearity, and importances of features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import clean
from plumbline.operators.ranking import average_rank, running_totals, spearman


def ranking_metrics(df: DataFrame, by: list[str], label: str, score: str, buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Per group: auc (ties one half), gini, ks, brier. Empty groups do not appear; one class gives auc .5 and ks 0.

    weight: a column of how many rows each row stands for.
    """
    one = F.col(weight) if weight else F.lit(1)
    counts = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(one)).alias("n"),
    )
    totals = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = running_totals(counts, by, score, ["p", "n"], buckets)
    c = c.join(totals, by) if by else c.crossJoin(F.broadcast(totals))  # one row
    c = c.withColumns({"cp": F.col("below_p") + F.col("p"), "cn": F.col("below_n") + F.col("n")})
    u = F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2.0))
    gap = F.max(F.abs(F.try_divide(F.col("cp"), F.col("all_p")) - F.try_divide(F.col("cn"), F.col("all_n"))))
    square = F.sum(F.col("p") * F.pow(1 - F.col(score), 2) + F.col("n") * F.pow(F.col(score), 2))
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    agg = c.groupBy(*by) if by else c
    got = agg.agg(F.when(both, u / (F.max("all_p") * F.max("all_n")).cast("double")).otherwise(F.lit(0.5)).alias("auc"), F.when(both, gap).otherwise(F.lit(0.0)).alias("ks"), (square / (F.max("all_p") + F.max("all_n"))).alias("brier"))
    return got.withColumn("gini", 2 * F.col("auc") - 1)


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Centred cross products of complete rows, from one aggregation (columns squared numbers, whatever the rows)."""
    rows = df.select(*(clean(c).alias(f"c{i}") for i, c in enumerate(columns))).na.drop()
    n = len(columns)
    means = rows.agg(*(F.avg(f"c{i}") for i in range(n))).first()
    means = [m or 0.0 for m in means]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.agg(*(F.sum((F.col(f"c{i}") - means[i]) * (F.col(f"c{j}") - means[j])) for i, j in pairs)).first()
    out = np.zeros((n, n))
    for (i, j), v in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def vif(df: DataFrame, columns: list[str]) -> list[tuple[str, float | None]]:
    """Variance inflation of each column, largest first; None for one that the others determine."""
    g = gram(df, columns)
    scale = np.sqrt(np.diag(g))
    out = []
    for i, c in enumerate(columns):
        rest = [j for j in range(len(columns)) if j != i and scale[j] > 0]
        if scale[i] == 0:
            out.append((c, None))
            continue
        if not rest:
            out.append((c, 1.0))
            continue
        a = g[np.ix_(rest, rest)] / np.outer(scale[rest], scale[rest])
        b = g[rest, i] / (scale[rest] * scale[i])
        r2 = float(b @ np.linalg.lstsq(a, b, rcond=1e-12)[0])
        out.append((c, 1 / (1 - r2) if r2 < 1 - 1e-10 else None))
    return sorted(out, key=lambda x: -(x[1] if x[1] is not None else math.inf))


def added_vif(df: DataFrame, chosen: list[str], candidate: str) -> float:
    """Variance inflation of a candidate next to chosen columns; 1 without any, or for a constant."""
    if not chosen:
        return 1.0
    g = gram(df, [*chosen, candidate])
    total = g[-1, -1]
    if total <= 0:
        return 1.0
    r2 = float(g[-1, :-1] @ np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]) / total
    return 1 / (1 - min(r2, 1 - 1e-9))


def entropy(importances: DataFrame, by: list[str] | None = None, value: str = "importance") -> DataFrame:
    """entropy, its maximum, their ratio, and a word for the concentration; features without importance are left out."""
    by = by or []
    w = Window.partitionBy(*by)
    p = importances.filter(F.col(value) > 0).withColumn("_p", F.col(value) / F.sum(value).over(w))
    agg = p.groupBy(*by) if by else p
    e = agg.agg((-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"), F.log(F.count("*").cast("double")).alias("max_entropy"))
    e = e.withColumn("normalized_entropy", F.when(F.col("max_entropy") > 0, F.col("entropy") / F.col("max_entropy")).otherwise(F.lit(0.0)))
    n = F.col("normalized_entropy")
    return e.withColumn("concentration", F.when(n > 0.85, "distributed").when(n > 0.65, "moderate").otherwise("concentrated"))


def shape(phi: DataFrame, by: list[str], value: str = "phi") -> DataFrame:
    """Per group: skew, excess kurtosis (both biased), Sarle's coefficient, and whether it is over .555."""
    got = phi.groupBy(*by).agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))
    got = got.withColumn("bimodality", (F.col("skew") * F.col("skew") + 1) / (F.col("kurtosis") + 3))
    return got.withColumn("bimodal", F.col("bimodality") > 0.555)


def dispersion(phi: DataFrame, by: list[str], value: str = "phi") -> DataFrame:
    sd, size = F.stddev_pop(value), F.avg(F.abs(value))
    return phi.groupBy(*by).agg(sd.alias("sd"), size.alias("mean_abs"), F.when(size > 0, sd / size).alias("cv"))


def seed_ranks(importances: DataFrame) -> DataFrame:
    """(seed, feature, importance) to each feature's mean, sd (by n) and range of ranks over seeds."""
    r = average_rank(importances, ["seed"], "importance", "_r", descending=True).withColumn("rank", F.floor("_r"))
    return r.groupBy("feature").agg(F.avg("rank").alias("rank_mean"), F.stddev_pop("rank").alias("rank_std"), (F.max("rank") - F.min("rank")).cast("long").alias("rank_range"))


def rank_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `{c}_rank`: ranks by falling value among non-null rows; null stays null."""
    for c in columns:
        rank = F.rank().over(Window.partitionBy(F.col(c).isNull()).orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
        df = df.withColumn(f"{c}_rank", F.when(F.col(c).isNotNull(), rank))
    return df


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, rho, n): rank correlations of every two columns of a summary table over rows that have both."""
    rows = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            part = spearman(df.select(F.lit(a).alias("a"), F.lit(b).alias("b"), clean(a).alias("_x"), clean(b).alias("_y")), ["a", "b"], "_x", "_y")
            rows = part if rows is None else rows.unionByName(part)
    return rows.filter("n >= 3")


def importance_gap(split_share: Column, gain_share: Column, least: float = 0.005) -> Column:
    gap = gain_share - split_share
    return F.when(gap > least, "gain_heavy").when(gap < -least, "split_heavy").otherwise("balanced")


# -- trees of Spark ML models ---------------------------------------------------------------


def tree_nodes(model) -> list[tuple[int, int, int, float, float]]:
    """(tree, depth, feature, gain, rows) of a tree ensemble's splits; bounded by the model's size."""
    trees = model.trees if hasattr(model, "trees") else [model]
    out = []
    for k, tree in enumerate(trees):
        stack = [(tree._call_java("rootNode"), 0)]
        while stack:
            node, depth = stack.pop()
            if node.subtreeDepth() == 0:
                continue
            out.append((k, depth, int(node.split().featureIndex()), float(node.gain()), float(node.impurityStats().count())))
            stack += [(node.leftChild(), depth + 1), (node.rightChild(), depth + 1)]
    return out


def tree_importances(spark, model, names: list[str]) -> DataFrame:
    """Per feature: n_splits, gain (weighted by rows), coverage (share of trees), and depths of its splits."""
    nodes = [(*n, names[n[2]]) for n in tree_nodes(model)]
    n_trees = len(model.trees) if hasattr(model, "trees") else 1
    df = spark.createDataFrame(nodes, "tree int, depth int, index int, gain double, n double, feature string")
    base = spark.createDataFrame([(n,) for n in names], "feature string")
    got = df.groupBy("feature").agg(
        F.count("*").alias("n_splits"), F.sum(F.col("gain") * F.col("n")).alias("gain"), (F.countDistinct("tree") / F.lit(float(n_trees))).alias("coverage"),
        F.avg("depth").alias("depth_mean"), F.percentile("depth", F.lit(0.5)).alias("depth_median"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"),
    )
    return base.join(got, "feature", "left").fillna(0, ["n_splits", "gain", "coverage"])
