"""Functions on shapes compute their arguments once, however long the expressions are: a copy for each use multiplies the work."""

import pytest
from pyspark.sql import functions as F

from lotwright.functions import clipping as c
from lotwright.functions import geometry as g


def _times(spark, column, text):
    df = spark.sql("SELECT array(named_struct('x', 0d, 'y', 0d), named_struct('x', 4d, 'y', 0d), named_struct('x', 4d, 'y', 4d), named_struct('x', 0d, 'y', 4d)) AS r")
    return df.select(column.alias("out"))._jdf.queryExecution().analyzed().toString().count(text)


@pytest.mark.parametrize("name", ["following", "signed_area", "bounds", "localise", "orientation", "centroid", "sides", "inner_angles", "diagonals", "is_convex", "with_orientation"])
def test_a_ring_is_computed_once(spark, name):
    assert _times(spark, getattr(g, name)(F.reverse("r")), "reverse(r") == 1


def test_a_point_is_tested_with_one_copy_of_the_ring(spark):
    assert _times(spark, g.contains_point(F.reverse("r"), g.point(1, 1)), "reverse(r") == 1


def test_the_halvings_of_a_shrunk_ring_run_once(spark):
    assert _times(spark, c.convex_shrink(F.col("r"), F.lit(0.64)), "aggregate(sequence(1, 48") == 1


def test_a_rectangles_ring_is_computed_once(spark):
    assert _times(spark, c.best_rectangle(F.reverse("r"), 1.0), "reverse(r") == 1
