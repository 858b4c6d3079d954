"""Kinds of instability made in one pass are those made one by one, and their gaps those of two samples."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import marginal, synthetic

KINDS = [k.value for k in synthetic.InstabilityType]


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(2000)
    return r.select("id", (F.col("id") % 2).cast("int").alias("t"), (F.xxhash64("id") % 50).cast("double").alias("a"), F.when(F.col("id") % 11 > 0, F.xxhash64("id", F.lit(1)) % 40).alias("b"))


def test_each_kind_and_one_pass(rows):
    each = synthetic.inject_each(rows, KINDS, ["b"], ["a", "b"], "t", ["id"], backend="md5")
    text = each._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text
    assert sum(line.count("md5(") for line in text.splitlines()) == 3  # a row's draws are made once for all kinds
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    for k in KINDS:
        one = synthetic.inject_into(rows, k, ["b"], ["a", "b"], "t", ["id"], backend="md5")
        for f, extreme in (("a", F.lit(False)), ("b", F.col("_extreme.b"))):
            want = one.select("t", F.col(f).cast("double"), extreme).collect()
            got = each.filter(f"kind = '{k}' and feature = '{f}'").select("y", "x", "extreme").collect()
            assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_gaps_of_counts(rows):
    values = rows.filter("b is not null").groupBy(F.lit("g").alias("g"), F.col("b").cast("double").alias("x")).agg(F.count_if(F.col("t") == 1).alias("ca"), F.count_if(F.col("t") == 0).alias("cb"))
    want = marginal.ks_two_sample(rows.filter("t = 1"), rows.filter("t = 0"), [], "b").first()
    got = marginal.ks_of_counts(values, ["g"]).first()
    assert (got["ks"], got["n_a"], got["n_b"]) == (pytest.approx(want["ks"], abs=1e-12), want["n_a"], want["n_b"])
