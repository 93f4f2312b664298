"""Shared borders worked out block by block in numpy, against the joins on lines."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwright.functions import geometry as g
from lotwright.operators import borders
from lotwright.operators.rounds import whole_groups
from lotwright.plans import parcel_queries

from .test_parcels import parted, placed


def _rows(rng, sizes):
    rows = []
    for block, n in enumerate(sizes):
        for k, b in enumerate(parted(rng, n)):
            rows.append((f"b{block}", f"k{k:03}", placed(b, [0.0, 0.3, math.pi / 2, -0.7][block % 4], 350_000.0 + 500 * block, 6_300_000.0, clockwise=k % 3 == 0)))
    return rows


def _found(df):
    return {(r.block, r.a, r.b): r.shared for r in df.collect()}


def test_bulk_borders_are_those_of_the_joins(spark):
    """Small blocks in tasks, one of more corners by the joins; rows of one parcel, nulls, parcels of several rings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = _rows(random.Random(8), [14, 9, 2, 1, 20, 80])
    rows += [("b0", "k900", rows[3][2] + rows[5][2]), ("b0", "k002", rows[7][2]), ("b1", "k901", None), ("b1", "k902", []), (None, "k1", rows[0][2]), ("b2", None, rows[0][2])]
    df = spark.createDataFrame(rows, f"block string, k string, shape {g.SHAPE}")
    want, got = (_found(borders.shared_borders(df, "k", "block", "shape", bulk=b)) for b in (False, True))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_bulk_borders_within_tolerance(spark):
    boxes = [(0, 0, 10, 10), (10.03, 2, 20, 14), (-10, 0, -0.08, 10), (0, 0, 10, 10), (3, 10.0, 4, 12), (12, 14, 13, 15)]
    df = spark.createDataFrame([(1, k, placed(b, 0.5)) for k, b in enumerate(boxes)], f"block int, k int, shape {g.SHAPE}")
    found = borders.shared_borders(df, "k", "block", "shape", bulk=True)
    assert sorted((a, b, round(v, 3)) for (_, a, b), v in _found(found).items()) == [(0, 1, 8.0), (0, 4, 1.0), (1, 3, 8.0), (1, 5, 1.0), (3, 4, 1.0)]


def test_borders_of_rows_need_one_exchange(spark, tmp_path):
    """Lines are exchanged once, by their order: before, the sides of all lots were, under each of their steps."""
    rows = [(o, n, float(n * 3 + o % 5 + 1)) for o in range(60) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = parcel_queries.QUERIES["row_borders"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert found.groupBy("block").count().agg(F.min("count"), F.count("block")).first() == (7, 60)


def test_groups_are_not_cut():
    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2, 2, 2], [2, 3], [4, 4, 4, 5])]
    assert [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k", 2)] == [[1, 1], [2, 2, 2, 2, 2], [3, 4, 4, 4], [5]]


def test_pieces_of_a_batch_hold_whole_blocks(monkeypatch):
    monkeypatch.setattr(borders, "CORNERS", 10)
    ring = [{"x": 0.0, "y": 0.0}] * 4
    rows = pa.table({"block": [1, 1, 2, 2, 2, 2, 3, 4, 5], "k": range(9), "_shape": [[ring]] * 7 + [None, [ring, ring]]})
    assert [t.column("k").to_pylist() for t in borders._parts(rows)] == [[0, 1], [2, 3, 4, 5], [6, 7], [8]]
