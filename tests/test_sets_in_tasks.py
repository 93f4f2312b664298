"""Sets of lots listed in tasks, against those of the rounds."""

import random

import pytest
from pyspark.sql import functions as F

from lotwright.operators import graph, locations


def _blocks(rng, sizes):
    parcels, borders = [], []
    for block, n in enumerate(sizes):
        names = rng.sample(range(-50, 1000), n)
        parcels += [(block, k, float(rng.randint(1, 9))) for k in names]
        pairs = [(a, b) for a in names for b in names if a < b and rng.random() < 2.2 / n]
        borders += [(block, a, b, rng.choice([17.0, 18.0 - 1e-9, 25.0])) for a, b in pairs]
    # Lots that aren't there, a block without lots, nulls, an edge to itself and one seen twice.
    borders += [(0, 5000, 5001, 20.0), (90, 1, 2, 20.0), (None, 1, 2, 20.0), (0, None, 5, 20.0), (0, parcels[0][1], parcels[0][1], 20.0), borders[0]]
    return parcels + [(0, 4000, None), (None, 1, 5.0)], borders


@pytest.mark.parametrize("mode", ["paths", "connected"])
def test_sets_in_tasks_are_those_of_the_rounds(spark, mode):
    """Blocks of one lot to twenty: those of more than sixteen go by rounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    parcels, borders = _blocks(random.Random(5), [6, 1, 2, 9, 12, 20, 16, 7, 3])
    p, b = spark.createDataFrame(parcels, "block int, parcel bigint, area double"), spark.createDataFrame(borders, "block int, a bigint, b bigint, shared double")
    plain, bulk = ({(r.block, *r.lots): r[2:] for r in locations.combinations(p, b, (1, 9), (4, 22), 5, 18, mode, bulk=on).collect()} for on in (False, True))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(plain) > 150 and {len(k) - 1 for k in plain} == {1, 2, 3, 4, 5}
    assert bulk == plain


def test_sets_in_tasks_take_one_exchange_of_graphs(spark):
    """Before, sets were exchanged and written in a round for each size."""
    v = spark.range(4000).select(F.floor(F.col("id") / 4).alias("g"), (F.col("id") % 4).alias("vertex"), F.lit(1.0).alias("weight"))
    e = v.where("vertex < 3").select("g", F.col("vertex").alias("u"), (F.col("vertex") + 1).alias("v"))
    found = graph.weighed_sets(v, e, "g", 4, "paths", 3.0, (2.0, 3.0))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.groupBy("nodes").count().select(F.array_join("nodes", ""), "count").collect()} == {(s, 1000) for s in ("01", "12", "23", "012", "123")}
