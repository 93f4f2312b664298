"""Slices of an envelope at a height."""

from pyspark.sql import functions as F

from lotwright.functions import geometry as g
from lotwright.operators import zoning


def test_neighbours_of_a_height_are_found_once(spark):
    """Two searches, however many corners and uses: before, each coordinate searched again. Below, above, on and between slices, and of other corners."""
    ring = lambda n, z: [(float(k) + z, k * 2.0) for k in range(n)]
    slices = [(0.0, ring(3, 0.0)), (2.0, ring(3, 4.0)), (4.0, ring(4, 8.0))]
    heights = [-1.0, 0.0, 0.5, 2.0, 3.0, 4.0, 9.0, None]
    df = spark.createDataFrame([(h, slices) for h in heights], f"h double, s array<struct<height:double,ring:{g.RING}>>")
    found = df.select("h", zoning.slice_at(F.col("s"), F.col("h")).alias("r"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 2
    got = {r.h: r.r and [p.x for p in r.r] for r in found.collect()}
    # Shares go as where it comes from: that of the lower slice falls with height.
    assert got[-1.0] == got[0.0] == [0.0, 1.0, 2.0] and got[0.5] == [1.0, 2.0, 3.0] and got[2.0] == [4.0, 5.0, 6.0]
    assert got[None] == [0.0, 1.0, 2.0]
    assert got[3.0] == [4.0, 5.0, 6.0] and got[4.0] == [4.0, 5.0, 6.0] and got[9.0] == [8.0, 9.0, 10.0, 11.0]
