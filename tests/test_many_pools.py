"""All pools and resamples in one pass: the same draws and metrics as one by one."""

import glob

import pytest
from pyspark.sql import functions as F

from plumbline.functions.rng import draw, draws_of_range
from plumbline.functions.lineage import Written
from plumbline.operators import attribution, marginal, sampling, selection
from plumbline.operators.analyzer import StabilityAnalyzer


def test_draws_in_a_task_are_those_of_the_plan(spark):
    prefix = spark.range(1).select(F.xxhash64(F.lit(42), F.lit("pool"), F.lit(3))).first()[0]
    want = [r[0] for r in spark.range(5, 500).select(draw(42, "pool", F.lit(3), F.col("id"))).collect()]
    assert draws_of_range(prefix, 5, 500).tolist() == want


@pytest.mark.parametrize("part_slots", [1 << 23, 500, 7])
def test_resampled_rows_are_the_drawn_pools(spark, monkeypatch, part_slots):
    monkeypatch.setattr(sampling, "PART_SLOTS", part_slots)
    pools = [(0, 0, 60), (1, 0, 900), (2, 1, 400)]
    plan = spark.createDataFrame(pools, "pool int, draw_no int, pool_size long")
    pooled = sampling.draw_pools(spark.range(900).withColumnRenamed("id", "row_id"), plan, [], 7)
    met = pooled.join(sampling.draw_resamples(plan, [], 3, 0.8, 7), ["pool", "draw_no", "pool_size", "slot"])
    want = {tuple(r) for r in met.select("pool", "draw_no", "pool_size", "row_id", "r", "cnt").collect()}
    got = sampling.resampled_rows(spark, [(900, *p) for p in pools], 3, 0.8, 7)
    rows = got.collect()
    assert len(rows) == 1360  # rows that no resample drew are there too
    assert {(r["pool"], r["draw_no"], r["pool_size"], r["row_id"], k, r[f"c{k}"]) for r in rows for k in range(3) if r[f"c{k}"]} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan  # only the pools are dealt out


@pytest.fixture(scope="module")
def phi(spark):
    r = spark.range(1200)
    value = (F.xxhash64("id") % 97).cast("double") / 31
    return r.select((F.col("id") % 2).alias("pool"), (F.floor(F.col("id") / 2) % 3).alias("resample"), F.floor(F.col("id") / 12).alias("sample"), F.concat(F.lit("f"), F.floor(F.col("id") / 6) % 2).alias("feature"), value.alias("phi")).localCheckpoint()


@pytest.mark.parametrize("buckets", [None, 2, 7, 40])
def test_distances_to_one_reference_are_those_of_two_samples(spark, phi, buckets):
    ref = phi.filter("resample = 0 and pool = 0").select("feature", "phi").unionByName(spark.createDataFrame([("f0", -5.0), ("f1", 9.0)], "feature string, phi double"))
    got = marginal.wasserstein_to_reference(phi, ref, ["pool", "resample"], "feature", "phi", buckets)
    sets = phi.select("pool", "resample").distinct()
    want = marginal.wasserstein_two_sample(phi, sets.crossJoin(ref), ["pool", "resample", "feature"], "phi")
    key = lambda d: {(r["pool"], r["resample"], r["feature"]): r["wasserstein"] for r in d.collect()}
    got, want = key(got), key(want)
    assert set(got) == set(want) and len(got) == 12
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-12)


def test_metrics_of_all_pools_are_those_of_each(phi):
    ref = phi.filter("resample = 0 and pool = 0").select("feature", "phi")
    found = attribution.feature_metrics(phi, ref, by=["pool"])
    features = {(r["pool"], r["feature"]): r for r in found.collect()}
    metrics = {(r["pool"], r["metric"]): r["mean"] for r in attribution.all_metrics(phi, ref, k=1, by=["pool"]).collect()}
    for p in (0, 1):
        own = phi.filter(F.col("pool") == p).drop("pool")
        for r in attribution.feature_metrics(own, ref).collect():
            for c in own_columns(r):
                assert features[p, r["feature"]][c] == pytest.approx(r[c], abs=1e-12)
        one = {r["metric"]: r["mean"] for r in attribution.all_metrics(own, ref, k=1).collect()}
        assert {m for q, m in metrics if q == p} == set(one)
        for m, v in one.items():
            assert metrics[p, m] == pytest.approx(v, abs=1e-12)


def own_columns(row) -> list[str]:
    return [c for c in row.asDict() if c != "feature"]


def test_permuted_rows_are_the_dealt_values(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PART_SLOTS", 40)
    rows = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    want = {(r["permutation"], r["row_id"], r["x"]) for r in sampling.permuted(rows, "x", 3, 5).collect()}
    assert {(r["permutation"], r["row_id"], 2 * r["source"]) for r in sampling.permuted_rows(spark, 100, 3, 5).collect()} == want


def test_samples_side_by_side_are_those_one_by_one(spark):
    by = ["feature", "pool"]
    side = spark.range(60).select(F.lit("a").alias("feature"), (F.col("id") % 2).alias("pool"), (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 5).alias("c0"), (F.col("id") % 3).alias("c1"), *(F.lit(v).alias(n) for n, v in (("f0_below", 0.25), ("f0_upto", 0.5))))
    side = side.withColumns({"e0": F.least("c0", F.lit(1)), "e1": F.col("c1") - F.least("c1", F.lit(1))}).localCheckpoint()
    draws = marginal.draws_side_by_side(side, by, 2).localCheckpoint()
    as_rows = lambda d: sorted(tuple(r.asDict().items()) for r in d.collect())
    columns = [*by, "r", "x", "f0_below", "f0_upto", "c", "e", "below", "m", "events", "n_values"]
    want = as_rows(marginal.value_table(draws, [*by, "r"], carry=["f0_below", "f0_upto"]).select(columns))
    for buckets in (1, 4):
        assert as_rows(marginal.values_side_by_side(side, by, 2, buckets).select(columns)) == want
    ref = spark.createDataFrame([("a", 0.0, 30.0, 4.0)], "feature string, low double, high double, bandwidth double")
    key = lambda d: {(r["pool"], r["r"], r["g"]): r["p"] for r in d.collect()}
    assert key(marginal.densities(side, by, ref, ["feature"], 9, 2)) == pytest.approx(key(marginal.densities(draws, [*by, "r"], ref, ["feature"], 9)), abs=1e-12)


def test_features_with_missing_values_keep_rows_of_their_own(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("holes"), (F.col("id") % 50 + 0.5).alias("whole"), (F.col("id") % 2).alias("y"))
    settings = {"n_resamples": 2, "n_points": 3}
    both = StabilityAnalyzer(**settings).fit_panel(df, "y", ["holes", "whole"], ["id"])
    assert both.pools["holes"][-1] == 200 and both.pools["whole"][-1] == 300
    got = {r["feature"]: r["overall"] for r in both.complexity_scores.collect()}
    for f in got:
        one = StabilityAnalyzer(**settings).fit_panel(df, "y", [f], ["id"])
        assert got[f] == pytest.approx(one.complexity_scores.first()["overall"], abs=1e-9)
        one.release()
    both.release()


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    files = lambda: {f for d in glob.glob(f"{spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]}/*") for f in glob.glob(f"{d}/shuffle_*.data")}
    had = files()
    hold = Written(spark)
    table = hold(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert files() <= had
    assert table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    hold.release()


def test_equal_rows_are_counted_once_before_models_are_fitted(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 3).cast("int").alias("fold"), (F.xxhash64("id") % 7 > F.col("id") % 5 - 2).cast("int").alias("y"), (F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("b"))
    rows, kept = selection._counted(df, ["a", "b"], "y", "fold")
    assert kept and rows.count() <= 3 * 2 * 5 * 4 and rows.agg(F.sum("cnt")).first()[0] == 4000
    rows.unpersist()
    some = selection.fold_models(df, ["a", "b"], "y", 3), selection.fold_auc(df, ["a", "b"], "y", 3)
    monkeypatch.setattr(selection, "REPEATS", 10**9)
    assert not selection._counted(df, ["a", "b"], "y", "fold")[1]
    assert some[0] == pytest.approx(selection.fold_models(df, ["a", "b"], "y", 3), abs=1e-9)
    assert some[1] == pytest.approx(selection.fold_auc(df, ["a", "b"], "y", 3), abs=1e-9)
