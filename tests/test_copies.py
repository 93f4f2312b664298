"""Copies of one shape, small files of many shapes, and rounds that leave nothing behind."""

from pyspark.sql import functions as F

from lotwright.functions import geometry as g
from lotwright.operators import borders, rounds, spatial_join
from lotwright.plans import spatial_queries
from lotwright.plans.reading import reader


def test_stacks_hold_each_key_once_and_are_parted(spark):
    """900 copies of one box and a null one: lists stay near 100 keys, none is lost or doubled."""
    df = spark.range(900).select(F.col("id").alias("k"), F.lit(1.0).alias("x")).union(spark.createDataFrame([(900, None), (901, None)], "k bigint, x double"))
    s = spatial_join.stacked(df, "k", 100)
    sizes = [len(r["k"]) for r in s.collect()]
    assert max(sizes) < 200 and len(sizes) > 5
    assert sorted(r["k"] for r in spatial_join.unstacked(s, "k").collect()) == list(range(902))


def test_copies_of_a_box_are_tested_once(spark):
    """300 copies of one box meet 300 of another: one pair of stacks, all pairs of keys."""
    b = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") < 300, 0.0).otherwise(1.0).alias("x"))
    bounds = lambda c: F.struct(F.col(c).alias("x0"), F.lit(0.0).alias("y0"), (F.col(c) + 1).alias("x1"), F.lit(1.0).alias("y1"))
    side = lambda n: spatial_join.stacked(b, "k").select(F.col("k").alias(f"{n}k"), F.col("x").alias(f"{n}x"))
    pairs = spatial_join.bounds_join(side("a"), side("b"), bounds("ax"), bounds("bx")).select("ak", "bk")
    assert pairs.count() == 4
    assert spatial_join.unstacked(pairs, "ak", "bk").where("ak < bk").count() == 600 * 599 // 2


def test_sides_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """The estimate of a small file misses that its rows become many: a broadcast of them fills the driver."""
    spark.range(200).select(F.col("id").alias("k"), F.floor(F.col("id") / 50).alias("block"), (F.col("id") % 50 * 10.0).alias("x")).write.parquet(f"{tmp_path}/p")
    shapes = spark.read.parquet(f"{tmp_path}/p").select("k", "block", F.array(g.box(F.col("x"), 0, 10, 10)).alias("shape"))
    found = borders.shared_borders(shapes, "k", "block", "shape")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 4 * 49


def test_rows_of_a_small_file_are_spread(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    read = reader(spark, str(tmp_path))("part")
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and sum(sizes) == 1000 and max(sizes) < 500


def test_kept_rows_release_their_shuffle_files(spark):
    """keep() returns what it wrote; drop() leaves no file."""
    kept = rounds.keep(spark.range(1000).groupBy(F.col("id") % 10).count())
    assert kept.agg(F.sum("count")).first()[0] == 1000
    rounds.drop(kept)
    where = spark._jvm.org.apache.hadoop.fs.Path(kept._kept)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_slices_of_copies_of_a_box_are_worked_out_once(spark, tmp_path):
    """Parts 20,000 apart and of one size are copies of one box: each gets all slices, worked out from one row of both."""
    keys = [(k, 5 + k % 2) for k in (1, 2, 20001, 20004)]
    spark.createDataFrame(keys, "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = spatial_queries.QUERIES["envelope_slices"](spark, str(tmp_path))
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {k: sorted((r.slice_height, r.area) for r in found.where(F.col("k") == k).collect()) for k, _ in keys}
    assert all(len(r) == 101 for r in rows.values()) and rows[1] == rows[20001] != rows[2]
