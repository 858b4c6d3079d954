"""Steps whose rows multiply: what they broadcast, and that leaving out buckets changes no rank."""

import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import inference, marginal, mergeable, models, sampling
from plumbline.operators.ranking import bucketed, hash_rank, value_cuts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"))


def test_draws_of_an_interval_are_not_broadcast(rows):
    got = inference.bootstrap_values(rows, "x", mergeable.TrimmedMean(range(17)), 5, keys=["k"])
    assert "BroadcastHashJoin" not in plan(got)


def test_draws_of_pools_are_not_broadcast(spark, rows):
    pools = spark.createDataFrame([(0, 0, 100), (1, 0, 3000)], "pool int, draw_no int, pool_size long")
    pooled = sampling.draw_pools(sampling.number_rows(rows, ["k"]), pools, [], 1)
    got = sampling.bootstrap(pooled.localCheckpoint(), pools, [], 3, 0.8, 1, ["x"])
    assert "BroadcastHashJoin" not in plan(got)
    sizes = {(r["pool"], r["r"]): r["n"] for r in got.groupBy("pool", "r").agg(F.sum("cnt").alias("n")).collect()}
    assert sizes == {(p, r): n for p, n in ((0, 80), (1, 2400)) for r in range(3)}


def test_dealt_values_are_not_broadcast(rows):
    numbered = sampling.number_rows(rows, ["k"]).localCheckpoint()
    assert "BroadcastHashJoin" not in plan(sampling.permuted(numbered, "x", 4, 3, buckets=1))


@pytest.mark.parametrize("buckets", [1, 2, 7, 500])
def test_ranks_below_a_size_are_those_of_all(rows, buckets):
    own = rows.withColumns({"g": F.when(F.col("k") % 3 > 0, F.col("k") % 3), "_h": F.shiftrightunsigned(F.xxhash64("k"), 12), "size": F.lit(55)})
    whole = hash_rank(own, ["g", "size"], "_h", ["k"], buckets=1).filter("rank < 55")
    some = hash_rank(own, ["g", "size"], "_h", ["k"], buckets=buckets, below="size")
    assert sorted(map(tuple, some.select("k", "rank").collect())) == sorted(map(tuple, whole.select("k", "rank").collect()))
    assert some.count() == 3 * 55  # a group whose key is null is one


def test_buckets_beyond_a_pool_are_not_shuffled(spark, rows):
    pools = spark.createDataFrame([(0, 0, 40)], "pool int, draw_no int, pool_size long")
    got = sampling.draw_pools(sampling.number_rows(rows, ["k"]).localCheckpoint(), pools, [], 1, buckets=30)
    assert got.count() == 40
    below = plan(got).split("Window [row_number", 1)[1]
    assert re.search(r"BroadcastHashJoin \[[^]]*_bucket", below.split("Exchange", 2)[1])
    assert re.search(r"Filter [^\n]*< (cast\()?pool_size", below)


def test_rows_numbered_in_one_task_leave_it_before_they_multiply(spark, rows):
    """Few rows are numbered in one task, whose partitioning suits any window: all pools would be ranked in it."""
    numbered = sampling.number_rows(rows, ["k"])
    pools = spark.createDataFrame([(i, 0, 3000) for i in range(25)], "pool int, draw_no int, pool_size long")
    pooled = sampling.draw_pools(numbered, pools, [], 1)
    for got, made in ((pooled, "BroadcastNestedLoopJoin"), (sampling.permuted(numbered, "x", 4, 3), "Generate explode")):
        exchange = re.search(r"Exchange (\w+)", plan(got).split(made, 1)[1])
        assert exchange[1] == "hashpartitioning"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {r["task"]: r["count"] for r in pooled.groupBy(F.spark_partition_id().alias("task")).count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks.values()) == 25 * 3000
    assert len(tasks) > 1


@pytest.fixture(scope="module")
def samples(spark):
    r = spark.range(4000)
    return r.select((F.col("id") % 40).cast("string").alias("k"), (F.xxhash64("id") % 1000).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(2).alias("cnt"))


def test_kernels_get_rows_by_group(spark, samples):
    """Else every batch holds rows of most groups, and each gives an array of the grid for nearly every row."""
    ref = spark.createDataFrame([(str(g), -1000.0, 1000.0, 50.0) for g in range(40)], "k string, low double, high double, bandwidth double")
    got = marginal.densities(samples, ["k"], ref, ["k"], grid=20)
    below = plan(got).split("MapInArrow", 1)[1]
    assert "Sort [k" in below.split("Exchange", 1)[0]
    own = {(r["k"], r["g"]): r["p"] for r in got.collect()}
    xs = {}
    for r in samples.collect():
        xs.setdefault(r["k"], []).append(r["x"])
    for g in ("0", "39"):
        k = [sum(math.exp(-0.5 * ((-1000 + 2000 * i / 19 - x) / 50) ** 2) for x in xs[g]) for i in range(20)]
        assert [own[g, i] for i in range(20)] == pytest.approx([v / sum(k) for v in k], rel=1e-9)


def test_cut_groups_give_the_same_totals(samples):
    rows = samples.withColumn("f", F.lit("a"))
    assert marginal.cuts_of(rows, ["f"]) is None
    cuts = marginal.cuts_of(rows, ["f"], each=300)
    by = ["f", "k"]
    as_rows = lambda df: sorted(map(tuple, df.select(*by, "x", "c", "e", "below", "m", "events", "n_values").collect()))
    assert as_rows(marginal.value_table(rows, by, cuts, ["f"])) == as_rows(marginal.value_table(rows, by))


def test_slots_of_attributions_are_not_broadcast(rows):
    numbered = rows.select(F.col("k").alias("_row")).localCheckpoint()
    got = models.AttributionStability(n_resamples=3).drawn(numbered, [100, 3000])
    assert "ShuffledHashJoin" in plan(got)
    sizes = got.groupBy("point", "resample").agg(F.sum("cnt").alias("n")).groupBy("point", "n").count()
    assert sorted(map(tuple, sizes.collect())) == [(0, 80, 3), (1, 2400, 3)]


def test_values_are_not_dealt_by_group(spark, samples):
    """A join of values with a row for each group would bring a group's values to one task."""
    rows, by = samples.withColumn("f", F.lit("a")), ["f", "k"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        values = marginal.value_table(rows, by, marginal.cuts_of(rows, ["f"], each=300), ["f"])
        edges = marginal.order_quantiles(values.localCheckpoint(), by, (0.0, 0.25, 0.5, 0.75, 1.0))
        bins = marginal.binned(rows, edges, by)
        plans = [plan(values), plan(bins), plan(marginal.value_table(rows, by))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [j for p in plans for j in re.findall(r"(?:SortMerge|ShuffledHash)Join (\[[^]]*\])", p)]
    assert joins and all("_bucket" in j or "bin" in j for j in joins)
    xs = {}
    for r in rows.collect():
        xs.setdefault(r["k"], []).append((r["x"], r["y"]))
    q = {r["k"]: r["q"] for r in edges.collect()}
    want = sorted((k, sum(x >= c for c in sorted(set(q[k]))[1:-1]), y) for k, own in xs.items() for x, y in own for _ in range(2))
    got = sorted((r["k"], r["bin"], y) for r in bins.collect() for y in (0, 1) for _ in range(r["events"] if y else r["others"]))
    assert got == want


@pytest.mark.parametrize("buckets", [2, 3, 10, 17, 300])
def test_buckets_found_in_two_steps_are_those_of_all_cuts(samples, buckets):
    cuts = value_cuts(samples, ["y"], "x", buckets)
    got = bucketed(samples.select("y", "x"), cuts, ["y"], "x").join(cuts, "y")
    assert got.filter(F.col("_bucket") != F.size(F.filter("_cuts", lambda c: c < F.col("x")))).count() == 0
    assert got.select("_bucket").distinct().count() == buckets
