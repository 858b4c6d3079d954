"""Published numbers, closed forms and edge cases of the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import numeric, rng
from plumbline.operators import attribution, checks, compare, curves, drift, importance, inference, marginal, models, ranking, reliability, sampling
from plumbline.sources import tables


def one(df):
    return df.first()[0]


def test_published_drift_score(spark):
    row = spark.createDataFrame([(0.9980237154150198, 0.17391304347826086, 1.0, 0.020149131)], "r double, f double, t double, m double")
    score = one(row.select(drift.overall_score(F.col("r"), F.col("f"), F.col("t"), F.col("m"))))
    assert abs(score - 0.0567966) < 1e-5
    assert one(row.select(drift.grade(F.lit(score)))) == "A"


def test_curve_fits_exact_curves(spark):
    sizes = [50, 80, 120, 200, 300, 450, 600, 800, 900, 1000]
    rows = [("a", n, 2 / math.sqrt(n) + 0.1) for n in sizes] + [("b", n, 2 / n**0.3 + 0.1) for n in sizes]
    rows += [("flat", n, 0.4) for n in sizes] + [("up", n, n / 1000.0) for n in sizes] + [("two", n, 1.0 / n) for n in sizes[:2]]
    points = spark.createDataFrame(rows, "metric string, pool_size long, mean double")
    fits = {r["metric"]: r for r in curves.fit(points, []).collect()}
    a = fits["a"]
    assert abs(a["k"] - 2) < 1e-9 and abs(a["floor"] - 0.1) < 1e-9 and abs(a["r2"] - 1) < 1e-9 and not a["anomalous"]
    assert abs(a["extrapolations"][500] - (2 / math.sqrt(500) + 0.1)) < 1e-9
    assert fits["flat"]["r2"] is None and fits["flat"]["anomalous"] and not fits["flat"]["fit_failed"]
    assert fits["up"]["anomalous"] and fits["two"]["fit_failed"]
    free = {r["metric"]: r for r in curves.fit(points, [], estimate_alpha=True).collect()}
    assert abs(free["b"]["alpha"] - 0.3) < 1e-3 and free["b"]["alpha_estimated"] and free["b"]["r2_improvement"] >= 0


def test_published_extrapolation(spark):
    k, floor = 0.4148109665744892, -0.0027099657485348755
    assert abs(k / math.sqrt(500) + floor - 0.015840944632924143) < 1e-12
    points = spark.createDataFrame([("m", n, k / math.sqrt(n) + floor) for n in (100, 200, 400, 800)], "metric string, pool_size long, mean double")
    assert abs(curves.fit(points, []).first()["extrapolations"][500] - 0.015840944632924143) < 1e-9


def test_scores_leave_out_anomalous_fits(spark):
    rows = [("f", "wasserstein", 0.2, False, False), ("f", "ks", 0.4, False, False), ("f", "js", 9.0, True, False), ("f", "iv", 0.1, False, False), ("f", "spearman", None, False, True)]
    fits = spark.createDataFrame(rows, "feature string, metric string, floor double, anomalous boolean, fit_failed boolean")
    r = curves.scores(fits, ["feature"]).first()
    assert abs(r["target_agnostic"] - (0.45 * 0.2 + 0.3 * 0.4) / 0.75) < 1e-12
    assert abs(r["overall"] - (0.45 * 0.2 + 0.3 * 0.4 + 0.3 * 0.1) / 1.05) < 1e-12
    assert curves.scores(fits, ["feature"], has_target=False).first()["target_dependent"] is None


def test_attribution_score_inverts_floors_again(spark):
    rows = [("rank_stability", 0.0), ("direction_consistency", 0.25), ("wasserstein", 0.1)]
    fits = spark.createDataFrame([(m, f, False, False) for m, f in rows], "metric string, floor double, anomalous boolean, fit_failed boolean")
    assert abs(one(attribution.score(fits, [])) - (0.3 * 1 + 0.3 * 0.75 + 0.15 * 0.1) / 0.75) < 1e-12
    assert abs(one(attribution.score(fits, [], double_invert=False)) - (0.3 * 0.25 + 0.15 * 0.1) / 0.75) < 1e-12


def test_imbalance_ladder(spark):
    for rate, name, least in ((0.005, "critical", 60), (0.03, "severe", 40), (0.07, "moderate", 30), (0.3, "none", 20)):
        df = spark.range(1000).select((F.col("id") < int(rate * 1000)).cast("int").alias("y"))
        r = checks.imbalance(df, "y").first()
        assert r["severity"] == name and checks.least_events(20, name) == least
        if r["imbalance_flag"]:
            with pytest.raises(checks.ImbalanceError):
                checks.require_balance(r, False)


def test_truncated_and_short_features(spark):
    rows = [("spiked", 0.0 if i < 300 else i / 10.0) for i in range(1000)] + [("two", float(i % 2)) for i in range(1000)] + [("short", float(i)) for i in range(99)]
    t = {r["feature"]: r for r in checks.truncation(spark.createDataFrame(rows, "feature string, x double")).collect()}
    assert t["spiked"]["flag_low"] and not t["spiked"]["flag_high"] and t["spiked"]["censoring_severity"] > 0.15
    assert t["two"]["note"] == "binary" and not t["two"]["censoring_flag"]
    assert t["short"]["note"] == "insufficient samples" and not t["short"]["censoring_flag"]


def test_metric_names():
    assert checks.metric_category("Wasserstein") == "target_agnostic" and checks.metric_category("IV") == "target_dependent" and checks.metric_category("x") == "unknown"


def test_ladder():
    assert sampling.pool_ladder(40, n_points=3) [-1] == 40
    assert sampling.pool_ladder(1000, n_points=3) == [50, 525, 1000]
    long = sampling.pool_ladder(60000)
    assert long[0] == 50 and long[-1] == 60000 and len(long) == 25
    assert sampling.enough_events([50, 100, 200], 0.1) == ([200], [50, 100])


def test_ranks_and_running_totals_do_not_depend_on_buckets(spark):
    df = spark.range(5000).select("id", rng.draw(1, F.col("id")).alias("h"), (F.col("id") % 3).alias("g"))
    ranks = [sorted((r["id"], r["rank"]) for r in ranking.hash_rank(df, ["g"], "h", ["id"], buckets=b).collect()) for b in (1, 7)]
    assert ranks[0] == ranks[1]
    v = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 3001).cast("double").alias("x"), (F.col("id") % 5 + 1).alias("w"))
    cuts = ranking.value_cuts(v, ["g"], "x", 6)
    a = sorted((r["g"], r["x"], r["below"]) for r in ranking.running(v, ["g"], "x", "w").collect())
    assert a == sorted((r["g"], r["x"], r["below"]) for r in ranking.running(v, ["g"], "x", "w", cuts, ["g"]).collect())


def test_sampling_is_exact_and_repeatable(spark):
    rows = spark.range(500).withColumnRenamed("id", "row_id")
    plan = spark.createDataFrame([(0, 0, 100), (1, 0, 500)], "pool int, draw_no int, pool_size long")
    pooled = sampling.draw_pools(rows, plan, [], 7)
    assert {r["pool"]: r["n"] for r in pooled.groupBy("pool").agg(F.count("*").alias("n")).collect()} == {0: 100, 1: 500}
    again = sampling.draw_pools(rows.repartition(5), plan, [], 7)
    assert pooled.select("pool", "slot", "row_id").exceptAll(again.select("pool", "slot", "row_id")).isEmpty()
    drawn = sampling.draw_resamples(plan, [], 3, 0.8, 7).groupBy("pool", "r").agg(F.sum("cnt").alias("n"))
    assert {(r["pool"], r["n"]) for r in drawn.collect()} == {(0, 80), (1, 400)}
    assert sampling.kfold(rows, 4, 1, ["row_id"]).groupBy("fold").count().filter("count <> 125").isEmpty()


def test_spread_of_resample_means_follows_theory(spark):
    x = [float(v) for v in np.random.default_rng(42).normal(5, 2, 1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x double")
    sd = inference.bootstrap_values(df, "x", n_boot=400, keys=["id"]).agg(F.stddev_samp("stat")).first()[0]
    assert abs(sd / (np.std(x) / math.sqrt(len(x))) - 1) < 0.15
    poisson = inference.bootstrap_values(df, "x", n_boot=400, keys=["id"], resample="poisson").agg(F.stddev_samp("stat")).first()[0]
    assert abs(poisson / (np.std(x) / math.sqrt(len(x))) - 1) < 0.15


def test_intervals(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, float("nan"), 3.0, 4.0, 5.0])], "id int, x double")
    ci = inference.bootstrap_ci(df, "x", n_boot=200, keys=["id"])
    assert ci["point_estimate"] == 3 and ci["ci_lower"] < 3 < ci["ci_upper"]
    wide, narrow = (inference.bootstrap_ci(df, "x", n_boot=200, ci=c, keys=["id"]) for c in (0.99, 0.8))
    assert wide["ci_upper"] - wide["ci_lower"] > narrow["ci_upper"] - narrow["ci_lower"]
    assert inference.bootstrap_ci(df, "x", "median", 100, keys=["id"])["point_estimate"] == 3
    assert inference.bootstrap_ci(df, "x", lambda a: float(a.max()), 20, keys=["id"])["point_estimate"] == 5
    with pytest.raises(ValueError):
        inference.bootstrap_ci(df.limit(0), "x")
    with pytest.raises(ValueError):
        inference.bootstrap_ci(df, "x", ci=1.0)
    t = inference.t_intervals(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "f string, s double"), ["f"], "s").orderBy("f").collect()
    assert abs(t[0]["ci_upper"] - (2 + 12.706204736174698)) < 1e-6 and t[1]["ci_lower"] == t[1]["ci_upper"] == 2


def test_distributions():
    assert abs(numeric.t_quantile(0.975, 9) - 2.2621571627) < 1e-8
    assert abs(numeric.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(numeric.normal_cdf(1.959963985) - 0.975) < 1e-9


def test_null_summary(spark):
    nulls = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),), (None,)], "score double")
    r = inference.null_summary(nulls, spark.createDataFrame([(18.5,)], "observed double"), [], alpha=0.1).first()
    assert abs(r["p_value"] - 1 / 20) < 1e-12 and r["significant"] and abs(r["z_score"] - (18.5 - 9.5) / np.std(range(20), ddof=1)) < 1e-9
    plus = inference.null_summary(nulls, spark.createDataFrame([(99.0,)], "observed double"), [], plus_one=True).first()
    assert abs(plus["p_value"] - 1 / 21) < 1e-12


def test_two_sample_distances_with_ties(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    b = spark.createDataFrame([(2.0,), (3.0,), (4.0,), (5.0,)], "v double")
    assert abs(marginal.ks_two_sample(a, b, [], "v").first()["ks"] - 0.5) < 1e-12
    assert abs(one(marginal.wasserstein_two_sample(a, b, [], "v")) - 1.25) < 1e-12


def test_reliability_published_row(spark):
    row = reliability.ReliabilityScorer().compute(spark, "x", 0.0, 0.50097, 0.95, 0.03)
    assert abs(row["reliability_score"] - (0.3 * 0.50097 + 0.4 + 0.15 * 0.95 + 0.15 * 0.97)) < 1e-9 and row["grade"] == "A"
    missing = spark.createDataFrame([("a", None, 0.5, 1.0, 0.0), ("b", 0.2, 0.5, None, float("nan"))], "feature_name string, complexity_score double, importance_score double, coverage_ratio double, cross_seed_std double")
    r = {x["feature_name"]: x for x in reliability.score(missing).collect()}
    assert r["a"]["stability_component"] == 0.5 and r["b"]["coverage_component"] == 0.5 and r["b"]["consistency_component"] == 0.5
    with pytest.raises(ValueError):
        reliability.ReliabilityConfig(importance_weight=0.9)
    with pytest.raises(ValueError):
        reliability.ReliabilityConfig(normalization_method="none")


def test_thresholds_and_few_features(spark):
    both = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0)], "feature string, marginal_complexity double, shap_complexity double")
    assert compare.thresholds(both).first()["marginal_threshold"] is None
    three = both.union(spark.createDataFrame([("c", 5.0, 9.0)], both.schema))
    nulls = spark.createDataFrame([(float(i),) for i in range(101)], "score double")
    r = compare.thresholds(three, nulls).first()
    assert r["threshold_source"] == "permutation_calibrated" and r["marginal_threshold"] == 95
    assert compare.thresholds(three, marginal=2.0).first()["threshold_source"] == "user_supplied"
    assert {x["feature"]: x["quadrant"] for x in compare.quadrants(three, compare.thresholds(three)).collect()} == {"a": "concordant_stable", "b": "concordant_stable", "c": "concordant_unstable"}


def test_vif_finds_a_determined_column(spark):
    r = np.random.default_rng(0)
    rows = [(float(a), float(b), float(a + b), 1.0) for a, b in r.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    v = dict(importance.vif(df, ["a", "b", "c", "k"]))
    assert v["a"] is None and v["c"] is None and v["k"] is None
    assert abs(dict(importance.vif(df, ["a", "b"]))["a"] - 1) < 0.1
    assert importance.added_vif(df, [], "a") == 1 and importance.added_vif(df, ["a", "b"], "c") > 1e6


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "id int, a double, b double")
    phi = models.linear_attributions(df, {"a": 2.0, "b": -1.0}, "id").groupBy("sample").agg(F.sum("phi").alias("s"))
    f = df.withColumn("f", 2 * F.col("a") - F.col("b"))
    mean = f.agg(F.avg("f")).first()[0]
    assert all(abs(r["s"] - (r["f"] - mean)) < 1e-9 for r in phi.join(f, phi["sample"] == f["id"]).collect())


def test_tree_attributions_are_shapley_values():
    """Against the definition, over all subsets of features."""
    leaves = [(1.0, [(0, -np.inf, 0.5, 0.6), (1, -np.inf, 2.0, 0.3)]), (4.0, [(0, -np.inf, 0.5, 0.6), (1, 2.0, np.inf, 0.7)]), (-2.0, [(0, 0.5, np.inf, 0.4), (2, -np.inf, 1.0, 0.5)]), (3.0, [(0, 0.5, np.inf, 0.4), (2, 1.0, np.inf, 0.5)])]
    steps = [(v, [models.Step(f, share, low, high) for f, low, high, share in path]) for v, path in leaves]
    x = np.array([[0.1, 3.0, 0.0], [0.9, 1.0, 2.0]])
    got = models.shapley_of_paths(x, steps, 3)

    def value(row, known):
        return sum(v * math.prod((float(lo < row[f] <= hi) if f in known else share) for f, lo, hi, share in path) for v, path in leaves)

    from itertools import combinations

    for row, phi in zip(x, got):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(row, {*s, f}) - value(row, set(s))) for n in range(3) for s in combinations(rest, n))
            assert abs(phi[f] - want) < 1e-12
        assert abs(phi.sum() - (value(row, {0, 1, 2}) - value(row, set()))) < 1e-12


def test_fitted_tree_attributions_add_up(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    r = np.random.default_rng(3)
    rows = [(i, float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(r.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    model = DecisionTreeClassifier(maxDepth=3, seed=1).fit(models.assemble(df, ["a", "b"], "y"))
    phi = models.tree_attributions(df, model, ["a", "b"], "id").groupBy("sample").agg(F.sum("phi").alias("s"))
    p = models.predictions(model, df, ["a", "b"], "y").select("id", "score")
    gap = phi.join(p, phi["sample"] == p["id"]).select((F.col("score") - F.col("s")).alias("g"))
    low, high = gap.agg(F.min("g"), F.max("g")).first()
    assert high - low < 1e-9  # one base value for all rows


def test_unknown_explainer(spark):
    with pytest.raises(NotImplementedError):
        models.explain(spark.range(1), object(), [], "id", "deep")


def test_conversions(spark, tmp_path):
    df = spark.createDataFrame([("",), ("1.5",), ("7",), ("x",), (None,)], "c string")
    assert [r["n"] for r in df.select(tables.number_of("c").alias("n")).collect()] == [None, 1.5, 7.0, None, None]
    tables.write_json({"a": np.float64("nan"), "b": np.arange(2), "c": {1: np.int64(3)}}, f"{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text().split() == ["{", '"a":', "null,", '"b":', "[", "0,", "1", "],", '"c":', "{", '"1":', "3", "}", "}"]
    tables.write_csv(df.withColumn("k", F.lit(1)), f"{tmp_path}/out", single=True)
    assert tables.read_csv(spark, f"{tmp_path}/out", ["c"]).count() == 5
    assert tables.read_csv_if_there(spark, f"{tmp_path}/none.csv") is None
