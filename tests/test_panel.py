"""The panel as a whole, and what is built on it."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.rng import normal, uniform
from plumbline.operators import inference, report, synthetic
from plumbline.operators.analyzer import StabilityAnalyzer, complexity_score
from plumbline.operators.checks import ImbalanceError
from plumbline.sources import tables

KEYS = {"meta", "pool_sequence", "excluded_pools", "learning_curves", "complexity_score", "complexity_scores", "per_metric_floors", "degenerate_rates", "woe_profiles", "percentile_stability", "raw_bootstrap"}


@pytest.fixture(scope="module")
def credit(spark):
    """Incomes, and defaults that are likelier for low ones."""
    rows = spark.range(800).select("id", (60_000 + 15_000 * normal(0, "income", F.col("id"))).alias("income"), uniform(0, "u", F.col("id")).alias("u"))
    return rows.withColumn("default_flag", (F.col("u") < 1 / (1 + F.exp(0.8 * (F.col("income") - 60_000) / 15_000))).cast("int")).drop("u").persist()


def test_document(spark, credit, tmp_path):
    a = StabilityAnalyzer(n_resamples=4, n_points=4)
    d = a.fit(credit, "income", "default_flag", ["id"])
    assert set(d) == KEYS and d["meta"]["n_obs"] == 800 and set(d["learning_curves"]) == {"wasserstein", "ks", "js", "spearman", "iv", "monotonicity"}
    assert len(d["raw_bootstrap"]) == 4 * len(d["pool_sequence"])
    ks = d["learning_curves"]["ks"]["means"]
    assert ks[0] > ks[-1]  # larger pools are closer to the whole
    with pytest.raises(ValueError):
        complexity_score(d, "other")
    tables.write_json(d, f"{tmp_path}/d.json")
    spark.catalog.clearCache()


def test_panel_without_target_and_skipped_features(spark, credit):
    df = credit.withColumn("few", F.col("id") % 5)
    p = StabilityAnalyzer(n_resamples=2, n_points=3).fit_panel(df, None, ["income", "few"], ["id"])
    assert set(p.skipped) == {"few"} and p.fits.filter("metric in ('iv', 'spearman')").isEmpty()
    assert p.complexity_scores.first()["target_dependent"] is None
    assert "income" in report.panel_report(p) and report.curve_plot_data(p).count() > 0
    table = tables.curve_table(p.learning_curves.filter("feature = 'income'"), p.fits.filter("feature = 'income'"))
    assert table.count() == len(p.pools["income"]) and "ks_extrap_500" in table.columns
    spark.catalog.clearCache()


def test_imbalance_raises(credit):
    rare = credit.withColumn("default_flag", (F.col("id") < 8).cast("int"))
    with pytest.raises(ImbalanceError):
        StabilityAnalyzer(n_resamples=2, n_points=3).fit(rare, "income", "default_flag", ["id"])
    with pytest.raises(ValueError):
        StabilityAnalyzer(n_pool_draws=0)


def test_permutation_warns_for_other_categories(credit):
    with pytest.warns(UserWarning):
        inference.PermutationBaseline(1).fit(credit, "income", "default_flag", ["id"], category="overall", n_resamples=2, n_points=3)


def test_synthetic_features_stand_out(spark):
    design = synthetic.Design(n_samples=600, n_features=4, n_corrupted=1)
    for kind in synthetic.InstabilityType:
        table, corrupted = synthetic.generate(spark, kind, design)
        r = table.agg(F.stddev_pop(corrupted[0]).alias("c"), F.stddev_pop("feature_0").alias("p"), F.count(corrupted[0]).alias("n")).first()
        assert r["c"] > 2 * r["p"] and (r["n"] < 600) == (kind is synthetic.InstabilityType.MNAR)


@pytest.mark.parametrize("strategy", ["repeated_random", "bootstrap"])
def test_meta_bootstrap_equals_its_splits_one_by_one(spark, credit, strategy):
    meta = inference.MetaBootstrap(2, strategy)
    settings = {"n_resamples": 2, "n_points": 3}
    df = credit.withColumn("rent", 0.3 * F.col("income") + F.col("id"))
    got = meta.fit(df, "default_flag", ["income", "rent"], ["id"], **settings)
    one_plan = {(r["split"], r["feature"]): (r["overall"], r["target_agnostic"], r["target_dependent"]) for r in got["scores"].collect()}
    split = meta.splits(df, ["id"]).persist()
    copy = [c for c in ("_copy",) if c in split.columns]
    for k in range(2):
        panel = StabilityAnalyzer(**settings).fit_panel(split.filter(F.col("split") == k), "default_flag", ["income", "rent"], ["id", *copy])
        for r in panel.complexity_scores.collect():
            assert one_plan.pop((k, r["feature"])) == pytest.approx((r["overall"], r["target_agnostic"], r["target_dependent"]), rel=1e-9)
        panel.release()
    assert not one_plan and not got["skipped"]
    report = {r["feature"]: r for r in got["report"].collect()}
    assert report["income"]["n_splits"] == 2 and report["income"]["ci_lower"] <= report["income"]["mean"] <= report["income"]["ci_upper"]
    assert got["by_category"].count() == 6
    spark.catalog.clearCache()


def test_injected_columns_and_their_detection(spark, credit):
    df = credit.withColumns({"rent": 0.3 * F.col("income") + F.col("id"), "age": F.col("id") % 60 + 20.0})
    names = ["income", "rent", "age"]
    for kind in synthetic.InstabilityType:
        got = synthetic.inject_into(df, kind, ["age"], names, "default_flag", ["id"])
        met = got.select("id", F.col("age").alias("new"), F.col("_extreme.age").alias("extreme")).join(df, "id")
        r = met.agg(F.count_if("extreme").alias("n"), F.count_if(F.expr("new is null")).alias("gone"), F.count_if(F.expr("extreme and sign(new - 49.5) <> 2 * default_flag - 1")).alias("wrong"), F.count_if(F.expr("not extreme and new <> age")).alias("changed")).first()
        assert 110 < r["n"] < 210 and r["wrong"] == 0 and r["changed"] == 0 and (r["gone"] > 0) == (kind is synthetic.InstabilityType.MNAR)
        gaps = {g["feature"]: g["ks"] for g in synthetic.class_gaps(got, names, "default_flag").collect()}
        assert gaps["age"] > 0.15
    suite = synthetic.SyntheticValidation(spark)
    found = suite.run_on(df, "heteroscedastic", ["age"], names, "default_flag", ["id"], threshold=0.0, use_permutation=False, n_resamples=2, n_points=3)
    flags = {r["feature"]: (r["corrupted"], r["flagged"]) for r in found.flags.collect()}
    assert set(flags) == set(names) and flags["age"][0] and not flags["rent"][0] and set(found.metrics) >= {"tpr", "fpr", "f1"}
