"""Hard negatives against brute force, and odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from lotwright.llm import hard_negatives
from lotwright.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def brute(rows, is_anchor, low=80, high=100, most=5):
    """By the definition, pair by pair; rows: (id, label, integers)."""
    out = []
    for a, la, qa in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q, strict=False)), i, lab) for i, lab, q in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:most]:
            band = [(n, i) for n, i, lab in scored if lab != la and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(band[:most])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_intervals_keep_every_pair_that_qualifies():
    rng = np.random.default_rng(3)
    for scale in (1, 3, 200, 1 << 20, 1 << 28):
        a, c = (rng.integers(-scale, scale + 1, (n, 7)) for n in (9, 300))
        allowed = rng.random((9, 300)) < 0.7
        i, j, s = hard_negatives.qualified(a, c, allowed, lambda i, low, high: high >= 0)
        product = (a[:, None, :].astype(object) * c[None].astype(object)).sum(-1)
        assert {(x, y): z for x, y, z in zip(i, j, s, strict=True)} == {(x, y): product[x, y] for x in range(9) for y in range(300) if allowed[x, y] and product[x, y] >= 0}


def test_intervals_tighten():
    rng = np.random.default_rng(4)
    a, c = rng.integers(-50, 51, (4, 16)), rng.integers(-50, 51, (500, 16))
    seen = []

    def rule(i, low, high):
        assert (low <= high).all()
        seen.append(len(i))
        best = hard_negatives._kth(i, low, 3, 4)
        return high >= best[i]

    _, _, score = hard_negatives.qualified(a, c, np.ones((4, 500), bool), rule)
    assert seen[0] == 2000 and seen == sorted(seen, reverse=True) and seen[-1] < 200 and len(score) >= 12


def test_products_beyond_64_bits_raise():
    big = np.full((1, 4), 1 << 40)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.qualified(big, big, np.ones((1, 1), bool), lambda i, low, high: high >= low)


@pytest.mark.parametrize("spread", [1, 4, 400])
def test_against_brute_force(spark, spread):
    random.seed(spread)
    rows = [(k * 10, random.randrange(3), [random.randint(-spread, spread) / 256 for _ in range(6)]) for k in range(250)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(5)
    whole = [(i, lab, [math.floor(256 * x) for x in q]) for i, lab, q in rows]
    assert mined(hard_negatives.hard_negatives(df, "vec_id % 100 = 0")) == brute(whole, lambda i: i % 100 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id bigint, label int, embedding array<float>, rank string, anchor_id int"
    good = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.5]), (3, 2, [0.9, 0.5]), (4, 3, [0.9]), (5, 3, []), (6, 1, [-1.0, -1.0]), (3, 2, [0.9, 0.5])]
    bad = [(7, None, [1.0, 0.5]), (None, 1, [1.0, 0.5]), (8, 2, None), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (11, 2, [None, 1.0]), (12, 2, [-inf])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], schema)
    got = mined(hard_negatives.hard_negatives(df, "vec_id = 0"))
    whole = [(i, lab, [math.floor(256 * x) for x in (*q, 0.0, 0.0)[:2]]) for i, lab, q in [(i, lab, tuple(np.float32(x) for x in q)) for i, lab, q in good]]
    assert got == brute([(i, lab, [int(x) for x in q]) for i, lab, q in whole], lambda i: i == 0)
    assert [r[3] for r in got] == [2, 3, 3]
    # Rows that repeat an anchor are one anchor, and no partners of each other.
    twice = mined(hard_negatives.hard_negatives(df.union(df.where("vec_id = 0")), "vec_id = 0"))
    assert twice == got
    assert mined(hard_negatives.hard_negatives(df.limit(0))) == []
    assert mined(hard_negatives.hard_negatives(df.where("vec_id in (2, 4)"))) == []


def test_query(spark):
    want = duckdb.sql(f"WITH embeddings AS (SELECT * FROM '{SF}/embeddings.parquet') {oracle_sql()['op13_hard_negatives'].replace('WITH v', ', v', 1)}").fetchall()
    got = mined(queries()["op13_hard_negatives"](spark, SF))
    assert got == sorted(want) and len(got) > 50
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * x) for x in r.embedding]) for r in table]
    assert got == brute(rows, lambda i: i % 100 == 0)
