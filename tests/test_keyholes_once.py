"""Squares cut open to one ring."""

from lotwright.plans import kernel_queries


def test_squares_of_one_size_are_cut_once(spark, tmp_path):
    """Suppliers five apart have squares of one size: before, the kernel cut each."""
    spark.range(1, 23).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    found = kernel_queries.QUERIES["keyholed_ring"](spark, str(tmp_path))
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()
    n = lambda k: k % 5 + 2
    assert sorted((r.k, round(r.area, 6), r.rings) for r in found.collect()) == [(k, round(25.0 * n(k) ** 2 - 0.02 * n(k), 6), 2) for k in range(1, 23)]
