"""Unions of many shapes on one line: the joins that cut their sides grow with the sides, not with their square."""

from pyspark.sql import functions as F

from lotwright.functions import geometry as g
from lotwright.operators import dissolve, overlay


def _boxes(spark, n):
    """Boxes of one height on one line, of places and widths that repeat; 12 different corners along it."""
    k = F.col("id")
    return spark.range(n).select(F.lit(1).alias("k"), F.array(g.box(k % 6, 0, k % 5 + 1, 1)).alias("s"))


def test_sides_on_one_line_are_not_joined_with_each_other(spark, monkeypatch):
    """Of 30 boxes each pair of sides on one line would meet; only those of different directions may, and ends as points."""
    text = []
    cut = overlay._pieces
    monkeypatch.setattr(overlay, "_pieces", lambda s, cuts, keys: text.append((s.count(), cuts.count())) or cut(s, cuts, keys))
    own = _boxes(spark, 30)
    found = overlay.merged(own, ["k"], "s")
    (sides, cuts), = text
    assert sides == 30 * 2 + 16 and cuts < 30 * 2 * 12 * 8
    row = dissolve.measures(dissolve.points_of(found, ["k"]), ["k"]).first()
    assert (round(row.area, 6), round(row.perimeter, 6), row.rings) == (10.0, 22.0, 1)


def test_cut_by_all_is_cut_by_each_other(spark):
    """Boxes, triangles and slanted bars that cross, touch and share lines: the same pieces as from all pairs of sides."""
    shapes = [[[(float(x), 0.0), (x + 4.0, 0.0), (x + 4.0, 3.0), (float(x), 3.0)]] for x in range(6)]
    shapes += [[[(1.0, -1.0), (7.0, 2.0), (2.0, 5.0)]], [[(0.0, 0.0), (6.0, 3.0), (5.0, 5.0)]], [[(-1.0, 1.0), (9.0, 1.5), (9.0, 2.5), (-1.0, 2.0)]]]
    own = spark.createDataFrame([(k % 2, x) for k, x in enumerate(shapes)], f"k int, s {g.SHAPE}")
    s = overlay._sides(own, ["k"], "s", dissolve.GRID)
    rows = [sorted(map(str, x.distinct().collect())) for x in (overlay._cut(s, s, ["k"], 0.5), overlay._cut_by_all(s, ["k"], 0.5))]
    assert rows[0] == rows[1] and len(rows[0]) > 40
