"""Fits read the points of the curves; they do not measure the resamples once for each use."""

from plumbline.plans import marginal_queries


def test_points_are_a_written_table(spark, sf_dir):
    points = marginal_queries._points(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.startswith("Relation")
    assert {r["n_values"] for r in points.collect()} <= {1, 2, 3, 4}
