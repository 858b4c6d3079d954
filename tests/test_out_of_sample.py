"""Two-sample totals in any number of buckets, and fitted references that are written and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import importance, marginal, out_of_sample, ranking


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(11)
    n = 3000
    day = r.integers(0, 100, n)
    data = zip(range(n), day.tolist(), np.round(r.normal(size=n) + 0.01 * day, 2).tolist(), r.integers(0, 6, n).astype(float).tolist(), r.integers(0, 2, n).tolist(), r.choice(["u", "v", "w"], n).tolist())
    return spark.createDataFrame(list(data), "id long, day int, a double, k double, y int, g string").persist()


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_totals_and_next_values_cross_buckets(spark, rows, buckets):
    counts = rows.groupBy("g", "a").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    got = ranking.running_totals(counts, ["g"], "a", ["n", "p"], buckets, "after").collect()
    for g in "uvw":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["a"])
        n = p = 0
        for r, after in zip(own, [*own[1:], None]):
            assert (r["below_n"], r["below_p"], r["after"]) == (n, p, after and after["a"])
            n, p = n + r["n"], p + r["p"]
    alone = ranking.running_totals(rows.groupBy("a").agg(F.count("*").alias("n")), [], "a", ["n"], buckets)
    assert alone.columns == ["a", "n", "below_n"] and alone.agg(F.max(F.col("below_n") + F.col("n"))).first()[0] == 3000


def test_two_sample_statistics_do_not_depend_on_buckets(rows):
    early, late = rows.filter("day < 40"), rows.filter("day >= 40")
    for by in ([], ["g"]):
        for f in (marginal.ks_two_sample, marginal.wasserstein_two_sample):
            one, many = (sorted(map(tuple, f(early, late, by, "a", buckets=b).collect())) for b in (1, 8))
            assert len(one) == (3 if by else 1)
            assert [x[: len(by)] for x in one] == [x[: len(by)] for x in many]
            assert np.allclose([x[len(by) :] for x in one], [x[len(by) :] for x in many], atol=1e-12)
        scored = rows.withColumn("s", 1 / (1 + F.exp(-F.col("a"))))
        one, many = (sorted(map(tuple, importance.ranking_metrics(scored, by, "y", "s", b).collect())) for b in (1, 8))
        assert np.allclose([x[len(by) :] for x in one], [x[len(by) :] for x in many], atol=1e-12)


def test_reference_is_written_once_and_applied_later(spark, rows, tmp_path):
    early, late = rows.filter("day < 40"), rows.filter("day >= 40")
    fitted = out_of_sample.Reference.fit(early, ["a", "k"], "y")
    fitted.write(str(tmp_path / "ref"))
    again = out_of_sample.Reference.read(spark, str(tmp_path / "ref"))
    one = {r["feature"]: r for r in fitted.apply(late, ["a", "k"], "y").collect()}
    two = {r["feature"]: r for r in again.apply(late, target="y").collect()}
    assert one == two and one["k"]["kind"] == "categorical" and one["a"]["kind"] == "continuous"
    ks = marginal.ks_two_sample(early, late, [], "a").first()["ks"]
    assert one["a"]["ks"] == pytest.approx(ks, abs=1e-12)
    assert one["k"]["monotonicity"] is None and not one["a"]["degenerate"]
    # the same sample is at no distance from itself
    same = {r["feature"]: r for r in fitted.apply(early, target="y").collect()}
    assert same["a"]["ks"] == 0 and same["a"]["wasserstein"] == pytest.approx(0, abs=1e-12) and same["k"]["wasserstein"] == 0
    empty = fitted.apply(late.filter("id < 0"), ["a", "k"], "y")
    assert empty.count() == 0
    single = {r["feature"]: r for r in fitted.apply(late.limit(1), target="y").collect()}
    assert single["a"]["degenerate"] and single["a"]["ks"] is None


def test_composite_and_comparison(spark):
    rows = [("a", 0.2, 0.1, None, -0.4, 0.3), ("b", None, None, None, None, None), ("c", 0.0, float("nan"), 0.5, 0.0, 0.0)]
    m = spark.createDataFrame(rows, "feature string, wasserstein double, ks double, js double, spearman double, iv double")
    got = {r["feature"]: r["composite"] for r in out_of_sample.composite(m).collect()}
    assert got["a"] == pytest.approx((0.45 * 0.2 + 0.3 * 0.1 + 0.4 * 0.4 + 0.3 * 0.3) / 1.45)
    assert got["b"] is None and got["c"] == pytest.approx(0.125 / 1.4)
    scores = spark.createDataFrame([(f, float(i)) for i, f in enumerate("abcd")], "feature string, complexity_score double")
    later = spark.createDataFrame([(f, float(i * i)) for i, f in enumerate("abcd")], "feature string, composite double")
    r = out_of_sample.against_scores(scores, later).first()
    assert r["rho"] == pytest.approx(1) and r["n"] == 4 and r["stable_mean"] == 0.5 and r["unstable_mean"] == 6.5
