"""The stability panel: every feature, pool and resample as keys of one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import VERSION
from plumbline.functions.lineage import Written
from plumbline.functions.numeric import clean
from plumbline.functions.rng import draw
from plumbline.operators import checks, curves, marginal, sampling
from plumbline.operators.ranking import BUCKET_ROWS, HASH_ROWS, buckets_for, hash_rank


@dataclass(frozen=True)
class Settings:
    """Defaults of the analysis. rows_key: columns that name a row (all columns, if empty).

    resample: "exact" draws with replacement; "poisson" gives each row a Poisson
    count, without a shuffle, for tables whose exact resamples are too many rows.
    """

    resample_frac: float = 0.8
    n_resamples: int = 20
    n_bins: int = 5
    min_events: int = 20
    imbalance_threshold: float = 0.05
    allow_imbalance: bool = False
    metric_weights: dict = field(default_factory=lambda: curves.DEFAULT_WEIGHTS)
    min_pool: int = 50
    linear_threshold: int = 1000
    n_points: int = 25
    r2_threshold: float = 0.70
    extrapolate_to: tuple[int, ...] = (500, 1000)
    random_state: int = 42
    estimate_alpha: bool = False
    alpha_bounds: tuple[float, float] = (0.1, 1.0)
    fixed_alpha: float = 0.5
    support_categorical: bool = False
    categorical_cardinality_threshold: int = 10
    n_pool_draws: int = 1
    backend: str = "xxhash64"
    resample: str = "exact"

    def __post_init__(self):
        if self.n_pool_draws < 1:
            raise ValueError("n_pool_draws must be at least 1")
        if self.resample not in ("exact", "poisson"):
            raise ValueError(f"unknown resample: {self.resample}")


@dataclass
class Panel:
    """Results as DataFrames: one row per feature (summary), per point (learning_curves), per fit (fits), and so on."""

    summary: DataFrame
    learning_curves: DataFrame
    fits: DataFrame
    complexity_scores: DataFrame
    woe_profiles: DataFrame
    percentile_stability: DataFrame
    degenerate_rates: DataFrame
    raw: DataFrame
    pools: dict[str, list[int]]
    excluded_pools: dict[str, list[int]]
    skipped: dict[str, str]
    written: Written | None = None

    def release(self) -> None:
        """Deletes the tables that the results are read from; they cannot be read any more."""
        if self.written:
            self.written.release()


class StabilityAnalyzer:
    """fit: one feature's result document; fit_panel: all features at once, in one plan."""

    def __init__(self, **settings):
        self.settings = Settings(**settings)

    def fit_panel(self, df: DataFrame, target: str | None = None, features: list[str] | None = None, rows_key: list[str] | None = None) -> Panel:
        features = features or checks.numeric_columns(df, (target,) if target else ())
        key = rows_key or df.columns
        ties = ["_key", *[k for k in key if k not in features]] if rows_key else ["_key"]
        return self.fit_sets(df.withColumn("_key", F.xxhash64(*key)), target, features, ties)

    def _numbered(self, hold: Written, df: DataFrame, target: str | None, features: list[str], ties: list[str], split: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows (split, own, row_id, y, v0, v1, ...) numbered in each table, the same as (feature, x, y), and rows (split, own, n).

        Features without a missing value are numbered together (own -1); each of the others in a table of
        its own rows, whose other values are null.
        """
        y = clean(target).cast("int") if target else F.lit(None).cast("int")
        names = [f"v{i}" for i in range(len(features))]
        hashed = draw("row", *(F.col(k) for k in ties), backend=self.settings.backend)
        rows = df.select((F.col(split).cast("string") if split else F.lit("")).alias("split"), F.col(ties[0]).alias("_tie"), hashed.alias("_h"), y.alias("y"), *(clean(f).alias(n) for f, n in zip(features, names, strict=True)))
        rows = rows.filter("y is not null") if target else rows
        sizes = rows.groupBy("split").agg(F.count("*").alias("n"), *(F.count(n).alias(n) for n in names)).collect()  # a row for each split
        whole = [i for i, n in enumerate(names) if all(r[n] == r["n"] for r in sizes)]
        tables, plan = [], []
        for own, of in [(-1, whole)] * bool(whole) + [(i, [i]) for i in range(len(features)) if i not in whole]:
            some = rows if own < 0 else rows.filter(F.col(names[own]).isNotNull())
            some = some.select("split", "_tie", "_h", "y", *(F.col(n) if i in of else F.lit(None).cast("double").alias(n) for i, n in enumerate(names)))
            most = max((r["n"] if own < 0 else r[names[own]] for r in sizes), default=1)
            tables.append(hash_rank(some, ["split"], "_h", ["_tie"], "row_id", buckets_for(most, HASH_ROWS)).select("split", F.lit(own).alias("own"), F.col("row_id").cast("long").alias("row_id"), "y", *names))
            plan += [(r["split"], own, int(r["n"] if own < 0 else r[names[own]])) for r in sizes]
        wide = hold(reduce(DataFrame.unionByName, tables))
        return wide, self._melted(wide, features, bool(split), "y"), wide.sparkSession.createDataFrame(plan, "split string, own int, n long")

    @staticmethod
    def _melted(wide: DataFrame, features: list[str], split: bool, *carried: str) -> DataFrame:
        """(carried, feature, x) of rows of all features; a feature in a split is named split:feature."""
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"v{i}").alias("x")) for i, f in enumerate(features)))).alias("p")
        name = F.concat_ws(":", "split", "p.feature") if split else F.col("p.feature")
        return wide.select("split", pairs, *carried).select(name.alias("feature"), "p.x", *carried).filter("x is not null")

    def fit_sets(self, df: DataFrame, target: str | None, features: list[str], ties: list[str], split: str | None = None) -> Panel:
        """As fit_panel. ties: columns that name a row, the first of them a hash of all of it. split: a column whose
        values are tables of their own; a feature in a split is a feature of the panel, named split:feature."""
        s = self.settings
        spark = df.sparkSession
        hold = Written(spark)
        wide, long, tables = self._numbered(hold, df, target, features, ties, split)
        facts = self._facts(long, target)
        use, pools, excluded, skipped = {}, {}, {}, {}
        for r in facts:  # one row for each feature
            try:
                pools[r["feature"]], excluded[r["feature"]] = self._pools(r, target is not None)
                use[r["feature"]] = r
            except ValueError as e:
                skipped[r["feature"]] = str(e)
                pools.pop(r["feature"], None)
        used = F.broadcast(spark.createDataFrame([(f,) for f in use], "feature string"))
        long = long.join(used, "feature") if skipped else long

        full = hold(marginal.full_sample(long))
        cuts = marginal.cuts_of(full, ["feature"], BUCKET_ROWS)
        cuts = hold(cuts) if cuts else None
        values = marginal.value_table(full, ["feature"], cuts, ["feature"])
        ref = hold(marginal.reference(values, ["feature"]))
        shares = hold(marginal.with_full_shares(values))
        plan = [(f, i, d, int(p)) for f, own in pools.items() for i, p in enumerate(own) for d in range(s.n_pool_draws)]
        drawn = sorted({(int(use[f]["n_obs"]), i, d, p) for f, i, d, p in plan})  # tables of one size share their pools and draws
        plan = F.broadcast(spark.createDataFrame(plan, "feature string, pool int, draw_no int, pool_size long"))
        keys = ["feature", "pool", "draw_no", "pool_size"]
        exact, every = s.resample == "exact", range(s.n_resamples)
        picked = sampling.resampled_rows_by(spark, drawn, s.n_resamples if exact else 0, s.resample_frac, s.random_state, s.backend)
        # a row that is in a pool meets its values once, whatever the features and resamples
        met = picked.join(wide.join(F.broadcast(tables), ["split", "own"]).hint("shuffle_hash"), ["n", "row_id"])
        each = self._melted(met, features, bool(split), "y", *keys[1:], "row_id", *(f"c{r}" for r in every if exact)).join(plan, keys)
        if not exact:
            weight = lambda r: sampling.poisson_weight(s.resample_frac, s.random_state, "poisson", *(F.col(k) for k in keys), F.lit(r), F.col("row_id"))
            each = each.withColumns({f"c{r}": weight(r) for r in every})
        samples = hold(each.groupBy(*keys, "x").agg(*(F.sum(f"c{r}").alias(f"c{r}") for r in every), *(F.sum(F.col(f"c{r}") * F.col("y")).alias(f"e{r}") for r in every), F.count("*").alias("rows")))
        firsts = samples.filter("draw_no = 0").select("feature", "pool", "pool_size", "x", F.col("rows").alias("cnt"), F.lit(0).alias("y"))
        side = samples.drop("rows").join(shares, ["feature", "x"])

        by = [*keys, "r"]
        few = [f for f, r in use.items() if s.support_categorical and r["kind"] == "categorical"]
        is_few = F.col("feature").isin(few) if few else F.lit(False)
        ref_density = hold(marginal.densities(full.filter(~is_few), ["feature"], ref, ["feature"]))
        many = side.filter(~is_few)
        buckets = buckets_for(samples.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        values, density = marginal.values_side_by_side(many, keys, s.n_resamples, buckets), marginal.densities(samples.filter(~is_few), keys, ref, ["feature"], resamples=s.n_resamples)
        wide_metrics, flags = marginal.continuous_metrics(marginal.draws_side_by_side(samples.filter(~is_few), keys, s.n_resamples), by, ref, ref_density, target is not None, s.n_bins, cuts, values, density, hold)
        wide_metrics = wide_metrics.withColumn("metric_type", F.lit("wasserstein"))
        if few:
            more, more_flags = marginal.categorical_metrics(marginal.draws_side_by_side(side.filter(is_few), keys, s.n_resamples), by, full, target is not None, cuts)
            wide_metrics = wide_metrics.unionByName(more.withColumn("metric_type", F.lit("tv_distance")))
            flags = flags.unionByName(more_flags)
        raw = hold(wide_metrics)

        points = hold(curves.aggregate(curves.instability_long(raw, by), ["feature", "pool", "pool_size"]))
        fits = hold(curves.fit(points, ["feature"], s.fixed_alpha, s.estimate_alpha, s.alpha_bounds, s.r2_threshold, s.extrapolate_to))
        scores = curves.scores(fits, ["feature"], s.metric_weights, target is not None)
        first_values = marginal.value_table(firsts, ["feature", "pool", "pool_size"], cuts, ["feature"])
        percentiles = marginal.order_quantiles(first_values, ["feature", "pool", "pool_size"], (0.1, 0.25, 0.5, 0.75, 0.9))
        percentiles = percentiles.select("feature", "pool", "pool_size", *(F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))))
        rates = curves.degenerate_rates(flags, ["feature", "pool", "pool_size"])
        summary = self._summary(spark, use, long, scores, fits, points, target)
        return Panel(summary, points, fits, scores, curves.woe_stability(raw, ["feature"], s.n_bins), percentiles, rates, raw, pools, excluded, skipped, hold)

    def fit(self, df: DataFrame, feature: str, target: str | None = None, rows_key: list[str] | None = None) -> dict:
        """One feature's result document. Raises what fit_panel notes in `skipped`."""
        panel = self.fit_panel(df, target, [feature], rows_key)
        if feature in panel.skipped:
            reason = panel.skipped[feature]
            raise checks.ImbalanceError(reason) if "rarer class" in reason else ValueError(reason)
        return to_dict(panel, feature, target, self.settings)

    def _facts(self, long: DataFrame, target: str | None) -> list:
        k = checks.kinds(long, self.settings.categorical_cardinality_threshold)
        if target:
            k = k.join(checks.imbalance(long, "y", self.settings.imbalance_threshold, ["feature"]).drop("n_obs"), "feature")
        else:
            k = k.withColumns({"event_rate": F.lit(None).cast("double"), "minority_rate": F.lit(None).cast("double"), "severity": F.lit("none"), "imbalance_flag": F.lit(False)})
        return k.collect()

    def _pools(self, r, has_target: bool) -> tuple[list[int], list[int]]:
        s = self.settings
        if r["kind"] == "categorical" and not s.support_categorical:
            raise ValueError(f"{r['feature']} is categorical; support_categorical=True takes it")
        ladder = sampling.pool_ladder(r["n_obs"], s.min_pool, s.linear_threshold, s.n_points)
        if not has_target:
            return [min(p, r["n_obs"]) for p in ladder], []
        checks.require_balance(r, s.allow_imbalance)
        least = checks.least_events(s.min_events, r["severity"]) if r["imbalance_flag"] else s.min_events
        good, out = sampling.enough_events(ladder, r["event_rate"], least)
        return [min(p, r["n_obs"]) for p in good], out

    def _summary(self, spark, use, long, scores, fits, points, target) -> DataFrame:
        rows = [(f, r["n_obs"], r["event_rate"], r["kind"], r["imbalance_flag"], "tv_distance" if self.settings.support_categorical and r["kind"] == "categorical" else "wasserstein") for f, r in use.items()]
        facts = spark.createDataFrame(rows, "feature string, n_obs long, event_rate double, feature_type string, imbalance_flag boolean, distributional_metric string")
        censored = checks.truncation(long).select("feature", "censoring_flag", "censoring_severity")
        floors = fits.groupBy("feature").agg(
            *(F.max(F.when(F.col("metric") == m, F.col("floor"))).alias(f"{m}_floor") for m in curves.METRICS),
            F.max(F.when(F.col("metric") == "wasserstein", F.col("r2"))).alias("wasserstein_r2"),
        )
        last = points.groupBy("feature").agg(*(F.max_by(F.when(F.col("metric") == m, F.col("mean")), F.when(F.col("metric") == m, F.col("pool"))).alias(f"{m}_mean_full") for m in ("spearman", "wasserstein")))
        score = scores.select("feature", F.col("overall").alias("complexity_score"))
        out = facts.join(censored, "feature", "left").join(score, "feature", "left").join(floors, "feature", "left").join(last, "feature", "left")
        out = out.withColumns({"version": F.lit(VERSION), "run_timestamp": F.lit(datetime.now(timezone.utc).isoformat())})
        return out.orderBy(F.asc_nulls_last("complexity_score"), "feature")


def to_dict(panel: Panel, feature: str, target: str | None, settings: Settings) -> dict:
    """The result document of one feature; what it collects has a row for each pool, metric or resample."""
    own = lambda df, *order: [r.asDict() for r in df.filter(F.col("feature") == feature).orderBy(*order).collect()]
    summary = own(panel.summary, "feature")[0]
    points, fits = own(panel.learning_curves, "pool"), own(panel.fits, "metric")
    score = own(panel.complexity_scores, "feature")
    rates = own(panel.degenerate_rates, "pool")
    fit_of = {r["metric"]: {k: v for k, v in r.items() if k not in ("feature", "metric")} for r in fits}
    return {
        "meta": {
            "feature": feature, "target": target, "version": VERSION, "random_state": settings.random_state, "n_obs": summary["n_obs"], "event_rate": summary["event_rate"],
            "imbalance_flag": summary["imbalance_flag"], "censoring_flag": summary["censoring_flag"], "censoring_severity": summary["censoring_severity"],
            "feature_type": summary["feature_type"], "has_target": target is not None, "run_timestamp": summary["run_timestamp"],
            "high_degenerate_pools": [r["pool_size"] for r in rates if r["high"]],
        },
        "pool_sequence": panel.pools[feature],
        "excluded_pools": panel.excluded_pools[feature],
        "learning_curves": {m: {"means": [p["mean"] for p in points if p["metric"] == m], "stderr": [p["stderr"] for p in points if p["metric"] == m], "fit": f} for m, f in fit_of.items()},
        "complexity_score": score[0]["overall"] if score else None,
        "complexity_scores": {k: v for k, v in score[0].items() if k != "feature"} if score else {},
        "per_metric_floors": {m: f["floor"] for m, f in fit_of.items()},
        "degenerate_rates": {r["pool_size"]: r["degenerate_rate"] for r in rates},
        "woe_profiles": {f"bin_{r['bin'] + 1}": {k: r[k] for k in ("mean", "sd", "flip_rate", "status")} for r in own(panel.woe_profiles, "bin")},
        "percentile_stability": {r["pool_size"]: {k: r[k] for k in ("p10", "p25", "p50", "p75", "p90")} for r in own(panel.percentile_stability, "pool")},
        "raw_bootstrap": own(panel.raw, "pool", "draw_no", "r"),
    }


def complexity_score(document: dict, category: str = "overall") -> float | None:
    """A score of a result document by category."""
    if category not in ("overall", "target_agnostic", "target_dependent"):
        raise ValueError(f"unknown category: {category}")
    found = document.get("complexity_scores") or {}
    return found.get(category, document.get("complexity_score") if category == "overall" else None)
