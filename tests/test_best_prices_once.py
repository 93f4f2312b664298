"""Best prices of projects that differ in their key alone."""

from pyspark.sql import functions as F

from lotwright.operators import economics
from lotwright.plans.spatial_queries import TYPES


def test_equal_projects_are_worked_out_once(spark):
    """Their mixes are not sorted for each key: the plan's aggregation of mixes is by the project."""
    names = ["land", "base", "max_coverage", "floors", "max_units", "common_share", "return", "far"]
    one, other = (1400.0, 560.0, 750.0, 6.0, 60.0, 0.2, 1.2, 1.0), (1300.0, 500.0, 750.0, 1.0, 60.0, 0.2, 1.2, 0.0)
    rows = [(k, *one) for k in range(40)] + [(k, *other) for k in range(40, 45)] + [(50, *one[:-1], None), (3, *other)]
    found = economics.best_prices(spark.createDataFrame(rows, f"key bigint, {', '.join(f'`{n}` double' for n in names)}"), "key", TYPES)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [project" in plan
    alone = {r.key: r for r in economics.best_prices(spark.createDataFrame([(1, *one), (2, *other)], f"key bigint, {', '.join(f'`{n}` double' for n in names)}"), "key", TYPES).collect()}
    got = {r.key: r for r in found.collect()}
    assert len(got) == 46 and all(got[k][1:] == alone[1][1:] for k in range(40)) and all(got[k][1:] == alone[2][1:] for k in range(40, 45))
    assert alone[1].feasible and not alone[2].feasible and found.where(F.col("key") == 50).count() == 1
