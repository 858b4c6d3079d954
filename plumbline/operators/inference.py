"""Intervals, meta-bootstrap over splits, and permutation nulls."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.functions.numeric import clean, t_quantile
from plumbline.functions.rng import draw
from plumbline.operators import checks, mergeable, sampling
from plumbline.operators.analyzer import StabilityAnalyzer
from plumbline.operators.mergeable import Statistic
from plumbline.operators.ranking import HASH_ROWS, average_rank_of_rows, buckets_for, dealt

#: Statistics that stay in SQL, from a resample's counts.
STATISTICS = ("mean", "median", "std", "sum", "min", "max")


def _statistic(name: str) -> Column:
    x, c = F.col("x"), F.col("cnt")
    n = F.sum(c)
    mean = F.sum(c * x) / n
    if name == "mean":
        return mean
    if name == "sum":
        return F.sum(c * x)
    if name == "std":
        return F.sqrt(F.greatest((F.sum(c * x * x) - n * mean * mean) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))
    if name in ("min", "max"):
        return getattr(F, name)("x")
    if name == "median":
        return F.percentile("x", F.lit(0.5), c)
    raise ValueError(f"unknown statistic: {name}; one of {STATISTICS}, or a function of a numpy array")


def bootstrap_values(df: DataFrame, value: str | Sequence[str], stat: str | Statistic | Callable = "mean", n_boot: int = 2000, seed: int = 42, keys: list[str] | None = None, backend: str = "xxhash64", resample: str = "exact") -> DataFrame:
    """Rows (r, stat): a statistic of each full-size resample. Rows with NaN or null are left out.

    stat: a name of STATISTICS, a `mergeable.Statistic` (of one or several columns), or a
    function. A function gets a resample's values as one numpy array, in one task each; the
    others never need a whole resample in a task. resample "poisson" gives each row a
    Poisson count instead of a draw: for mean, sum and mergeable statistics no row is
    shuffled at all.
    """
    names, rows = _complete(df, value, keys)
    n = rows.count()
    if n == 0:
        raise ValueError("no values to resample")
    if resample == "poisson":
        hashed = [F.col(k) for k in keys or []] or [*map(F.col, names), F.monotonically_increasing_id()]
        each = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        drawn = each.withColumn("cnt", sampling.poisson_weight(1.0, seed, "ci", F.col("r"), *hashed)).filter("cnt > 0").select("r", *names, "cnt")
    else:
        numbered = sampling.number_rows(rows, keys or names, buckets=buckets_for(n, HASH_ROWS), name="slot", backend=backend)
        blocks = df.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("r"))
        blocks = dealt(blocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 65536)))), "r", "b")
        draws = blocks.withColumn("i", F.explode(F.sequence(F.col("b") * 65536, F.least(F.lit(n - 1), (F.col("b") + 1) * 65536 - 1))))
        slot = F.pmod(draw(seed, "ci", F.col("r"), F.col("i"), backend=backend), F.lit(n)).cast("long")
        # without the hint, the planner takes the draws for as few as the resamples, and broadcasts them
        drawn = draws.select("r", slot.alias("slot")).join(numbered.select("slot", *names).hint("shuffle_hash"), "slot").select("r", *names, F.lit(1).alias("cnt"))
    return _each(drawn, names, stat)


def _complete(df: DataFrame, value: str | Sequence[str], keys: list[str] | None) -> tuple[list[str], DataFrame]:
    """Names x, x1, ... and the rows that have all values."""
    values = [value] if isinstance(value, str) else list(value)
    names = ["x", *(f"x{i}" for i in range(1, len(values)))]
    rows = df.select(*(clean(v).alias(n) for v, n in zip(values, names, strict=True)), *(keys or []))
    return names, rows.filter(F.expr(" and ".join(f"{n} is not null" for n in names)))


def _each(drawn: DataFrame, names: list[str], stat: str | Statistic | Callable) -> DataFrame:
    """(r, stat) of rows (r, names, cnt)."""
    if isinstance(stat, str):
        return drawn.groupBy("r").agg(_statistic(stat).alias("stat"))
    if isinstance(stat, Statistic):
        return mergeable.aggregate(drawn, "r", names, "cnt", stat).withColumn("r", F.col("r").cast("int"))

    def own(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [g["r"].iloc[0]], "stat": [float(stat(np.repeat(g["x"].to_numpy(), g["cnt"].to_numpy())))]})

    return drawn.groupBy("r").applyInPandas(own, "r int, stat double")


def bootstrap_ci(df: DataFrame, value: str | Sequence[str], stat: str | Statistic | Callable = "mean", n_boot: int = 2000, ci: float = 0.95, seed: int = 42, keys: list[str] | None = None, backend: str = "xxhash64", resample: str = "exact") -> dict:
    """Percentile interval of a statistic."""
    if not 0 < ci < 1:
        raise ValueError("ci must lie between 0 and 1")
    values = bootstrap_values(df, value, stat, n_boot, seed, keys, backend, resample)
    low, high = values.agg(F.percentile("stat", F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))).first()[0]
    names, rows = _complete(df, value, None)
    point = _each(rows.select(F.lit(0).alias("r"), *names, F.lit(1).alias("cnt")), names, stat).first()["stat"]
    return {"point_estimate": point, "ci_lower": low, "ci_upper": high, "n_boot": n_boot, "ci": ci, "seed": seed}


def t_intervals(scores: DataFrame, by: list[str], value: str, ci: float = 0.95, skip_null: bool = True) -> DataFrame:
    """Per group: mean, std, ci_lower, ci_upper, n_splits; one value gives a point.

    skip_null False lets one null score make the group's interval null.
    """
    v = F.col(value)
    n = F.count(v)
    got = scores.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(n > 1, F.stddev_samp(v)).otherwise(F.lit(0.0)).alias("std"), n.alias("n_splits"), F.count("*").alias("_all"))
    sizes = sorted(r["n_splits"] for r in got.select("n_splits").distinct().collect())  # distinct split counts
    t = F.lit(0.0)
    for k in sizes:
        if k > 1:
            t = F.when(F.col("n_splits") == k, F.lit(t_quantile((1 + ci) / 2, k - 1))).otherwise(t)
    half = t * F.col("std") / F.sqrt(F.greatest(F.col("n_splits"), F.lit(1)).cast("double"))
    if not skip_null:
        whole = F.col("n_splits") == F.col("_all")
        got = got.withColumns({"mean": F.when(whole, F.col("mean")), "std": F.when(whole, F.col("std"))})
    return got.select(*by, "mean", "std", (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"), "n_splits")


class SplitStrategy(Enum):
    KFOLD = "kfold"
    REPEATED_RANDOM = "repeated_random"
    BOOTSTRAP = "bootstrap"


class MetaBootstrap:
    """The stability panel over several splits of the rows, and intervals of its scores."""

    def __init__(self, n_splits: int = 10, strategy: SplitStrategy | str = SplitStrategy.REPEATED_RANDOM, random_state: int = 42, ci_level: float = 0.95, train_frac: float = 0.8, skip_null: bool = True):
        self.n_splits, self.strategy, self.random_state = n_splits, SplitStrategy(strategy), random_state
        self.ci_level, self.train_frac, self.skip_null = ci_level, train_frac, skip_null

    def splits(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with `split`; the bootstrap strategy repeats rows."""
        if self.strategy is SplitStrategy.KFOLD:
            folds = sampling.kfold(df, self.n_splits, self.random_state, keys)
            each = folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(self.n_splits - 1))))
            return each.filter("split <> fold").drop("fold")
        if self.strategy is SplitStrategy.REPEATED_RANDOM:
            return sampling.repeated_split(df, self.n_splits, self.train_frac, self.random_state, keys)
        numbered = sampling.number_rows(df, keys, name="_row")
        drawn = sampling.bootstrap_split(numbered, self.n_splits, self.random_state, "_row")
        return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int")))).drop("cnt", "_row")

    def fit(self, df: DataFrame, target: str | None = None, features: list[str] | None = None, rows_key: list[str] | None = None, **settings) -> dict:
        """report: intervals per feature; by_category: per feature and score; scores: per split; skipped: reasons by `split:feature`."""
        features = list(features or checks.numeric_columns(df, (target,) if target else ()))
        keys = list(rows_key or df.columns)
        split = self.splits(df, keys)
        named = [*keys, *(["_copy"] if "_copy" in split.columns else [])]
        # a feature in a split is a key of one panel, with its own rows, ladder, kernels and fits
        hold = Written(df.sparkSession)
        split = hold(split.select("split", *dict.fromkeys([*named, *features, *([target] if target else [])])))
        panel = StabilityAnalyzer(**settings).fit_sets(split.withColumn("_key", F.xxhash64(*named)), target, features, ["_key", *[k for k in named if k not in features]], "split")
        key = F.col("feature")
        scores = panel.complexity_scores.select(
            F.substring_index(key, ":", 1).cast("int").alias("split"), F.expr("substring(feature, instr(feature, ':') + 1)").alias("feature"), "overall", "target_agnostic", "target_dependent"
        )
        scores = Written(df.sparkSession)(scores)
        panel.release()
        hold.release()
        long = scores.select("split", "feature", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in ("overall", "target_agnostic", "target_dependent")))).alias("p")).select("split", "feature", "p.category", "p.score")
        report = t_intervals(scores, ["feature"], "overall", self.ci_level, self.skip_null).orderBy(F.asc_nulls_last("mean"), "feature")
        return {"report": report, "by_category": t_intervals(long, ["feature", "category"], "score", self.ci_level, self.skip_null), "scores": scores, "skipped": panel.skipped}


def null_summary(nulls: DataFrame, observed: DataFrame, by: list[str], alpha: float = 0.05, plus_one: bool = False) -> DataFrame:
    """nulls: (by, score); observed: (by, observed). Per group: null_mean, null_std, p_value, z_score, significant.

    Null scores that are null or not finite are left out; without spread there is no z.
    """
    good = nulls.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(math.inf)))
    met = observed.join(good, by, "left") if by else observed.crossJoin(good)
    n, one = F.count("score"), 1 if plus_one else 0
    hits = F.count(F.when(F.col("score") >= F.col("observed"), 1))
    got = met.groupBy(*by, "observed").agg(F.avg("score").alias("null_mean"), F.stddev_samp("score").alias("null_std"), F.try_divide(hits + one, n + one).alias("p_value"), n.alias("n_nulls"))
    z = F.when(F.col("null_std") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_std"))
    return got.withColumns({"z_score": z, "significant": F.coalesce(F.col("p_value") < alpha, F.lit(False))})


class PermutationBaseline:
    """Scores of permuted features against the observed score; all permutations are keys of one panel."""

    def __init__(self, n_permutations: int = 25, alpha: float = 0.05, random_state: int = 42, plus_one: bool = False):
        self.n_permutations, self.alpha, self.random_state, self.plus_one = n_permutations, alpha, random_state, plus_one

    def fit(self, df: DataFrame, features: Sequence[str] | str, target: str, rows_key: list[str] | None = None, category: str = "target_dependent", **settings) -> DataFrame:
        """Per feature: observed, null_mean, null_std, p_value, z_score, significant."""
        if category != "target_dependent":
            warnings.warn(f"permuting a feature does not change its {category} score as it does the target's", UserWarning, stacklevel=2)
        features = [features] if isinstance(features, str) else list(features)
        settings = {"n_resamples": 10, "random_state": self.random_state} | settings
        keys = rows_key or df.columns
        hold = Written(df.sparkSession)
        rows = df.select(*dict.fromkeys([*keys, *features, target]))
        numbered = hold(sampling.number_rows(rows, keys, name="_row").select(F.col("_row").cast("long").alias("_row"), target, *features))
        # a permutation deals all features alike, so a row's values travel together; a column for each is one more feature of the panel
        every = range(1, self.n_permutations + 1)
        to = sampling.permuted_rows(df.sparkSession, numbered.count(), self.n_permutations, self.random_state)
        dealt = to.join(numbered.select(F.col("_row").alias("source"), *features).hint("shuffle_hash"), "source")
        columns = dealt.repartition("row_id").groupBy(F.col("row_id").alias("_row")).agg(*(F.first(F.when(F.col("permutation") == i, F.col(f)), True).alias(f"{f}@{i}") for f in features for i in every))
        wide = hold(numbered.join(columns, "_row"))
        names = [*features, *(f"{f}@{i}" for f in features for i in range(1, self.n_permutations + 1))]
        panel = StabilityAnalyzer(**settings).fit_panel(wide, target, names, ["_row"])
        scores = panel.complexity_scores.select(F.split("feature", "@")[0].alias("name"), F.split("feature", "@").alias("parts"), F.col(category).alias("score"))
        observed = scores.filter(F.size("parts") == 1).select(F.col("name").alias("feature"), F.col("score").alias("observed"))
        nulls = scores.filter(F.size("parts") == 2).select(F.col("name").alias("feature"), "score")
        return null_summary(nulls, observed, ["feature"], self.alpha, self.plus_one)


def detection(flags: DataFrame, by: list[str], truth: str = "corrupted", flagged: str = "flagged") -> DataFrame:
    """tpr, fpr, precision, recall, f1 of flags against the truth; 0 where there is nothing to divide by."""
    count = lambda t, f: F.count(F.when((F.col(truth) == t) & (F.col(flagged) == f), 1))
    c = flags.groupBy(*by).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tpr, precision = share(F.col("tp"), F.col("tp") + F.col("fn")), share(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.withColumns({"tpr": tpr, "fpr": share(F.col("fp"), F.col("fp") + F.col("tn")), "precision": precision, "recall": tpr, "f1": share(2 * precision * tpr, precision + tpr)})


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Per group of `by`: U of rows whose `group` is true, their number and the others'; ties count one half."""
    ranked = average_rank_of_rows(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()), by, value, "_r")
    n1, n0 = F.count(F.when(F.col(group), 1)), F.count(F.when(~F.col(group), 1))
    agg = ranked.groupBy(*by) if by else ranked
    return agg.agg((F.sum(F.when(F.col(group), F.col("_r"))) - n1 * (n1 + 1) / 2.0).alias("u"), n1.alias("n1"), n0.alias("n0"))
