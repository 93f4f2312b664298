"""Common areas of pairs: in numpy as by the expressions, and each two shapes once."""

import pytest
from pyspark.sql import functions as F

from lotwright.functions import clipping
from lotwright.functions import geometry as g
from lotwright.operators import spatial_join
from lotwright.plans import catalogue


def test_areas_as_by_expressions(spark):
    box, far = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]
    rows = [(1, box, [(1.0, -1.0), (3.0, 1.0), (1.0, 5.0)]), (2, box, box), (3, box, far), (4, far, box), (5, [(x + 3.5, y + 1.5) for x, y in box], box)]
    df = spark.createDataFrame(rows, f"k int, a {g.RING}, b {g.RING}")
    want = {r.k: r.c or 0.0 for r in df.select("k", g.signed_area(clipping.convex_clip(F.col("a"), F.col("b"))).alias("c")).collect()}
    got = {r.k: r.common for r in spatial_join.with_common_area(df, "a", "b").collect()}
    assert got == pytest.approx(want) and got[2] == 8.0 and got[3] == 0.0


def test_pairs_of_stacks_once(spark):
    df = spark.createDataFrame([([1, 5, 3], [1, 5, 3], True), ([4, 2], [1, 3], False)], "a array<int>, b array<int>, same boolean")
    got = sorted(map(tuple, spatial_join.unstacked_once(df, "a", "b", F.col("same")).select("a", "b").collect()))
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (3, 4), (3, 5)]


def test_query_clips_in_numpy(spark):
    plan = catalogue.queries()["clip_area"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
