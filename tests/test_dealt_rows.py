"""Exchanges get more tasks as their rows grow, so that what a task sorts or hashes does not grow with the input."""

import pytest

from lotwright.operators import rounds
from lotwright.plans import relational_queries, spatial_queries


def test_tasks_grow_with_the_rows(spark):
    assert rounds.tasks_for(10, spark) == 4
    assert rounds.tasks_for(10 * rounds.TASK_ROWS + 1, spark) == 11


@pytest.mark.parametrize("queries, name", [(relational_queries, "combos_per_lot"), (spatial_queries, "combos_adjacency"), (spatial_queries, "purchase_prob")])
def test_exchanges_of_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch, queries, name):
    """900 lines, at most 100 to a task: nine tasks and more; before, as many as any shuffle has."""
    lines = [(o, n, o * 7 % 50 + n, o * 3 % 11 + n) for o in range(300) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 40) for o in range(300)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted(queries.QUERIES[name](spark, str(tmp_path)).collect())
    monkeypatch.setattr(rounds, "TASK_ROWS", 100)
    found = queries.QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    tasks = [int(line.split("hashpartitioning(")[1].split(")")[0].split(", ")[-1]) for line in plan.splitlines() if "hashpartitioning(" in line]
    assert tasks and min(tasks) >= 9
    assert len(want) > 20 and [r[:2] for r in sorted(found.collect())] == [r[:2] for r in want]
    assert [r[2] for r in sorted(found.collect()) if len(r) > 2] == pytest.approx([r[2] for r in want if len(r) > 2], abs=2e-6)
