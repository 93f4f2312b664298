"""Kernel operations as vectorised functions over columns of shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SHAPE
from . import kernel


def flat(shape: Column) -> Column:
    """A shape as one array of numbers, each ring's size before its coordinates: rings of different sizes don't fit an array of arrays in pandas."""
    corners = lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.flatten(F.transform(shape, lambda r: F.concat(F.array(F.size(r).cast("double")), corners(r))))


def load(shape) -> kernel.Shape:
    """A flattened shape's cell as a list of arrays; null gives the empty shape."""
    out, at = [], 0
    values = np.asarray(shape if shape is not None else (), float)
    while at < len(values):
        stop = at + 1 + 2 * int(values[at])
        out.append(values[at + 1 : stop].reshape(-1, 2))
        at = stop
    return out


def points(line) -> np.ndarray:
    """A cell of points as an array."""
    return np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)


def store(shape: kernel.Shape) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in shape]


def _shape_udf(f):
    return F.pandas_udf(lambda *cols: pd.Series([store(f(*row)) for row in zip(*cols, strict=True)]), SHAPE)


def _value_udf(f, kind: str):
    return F.pandas_udf(lambda *cols: pd.Series([f(*row) for row in zip(*cols, strict=True)]), kind)


def union(a: Column, b: Column) -> Column:
    return _shape_udf(lambda x, y: kernel.union([load(x), load(y)]))(flat(a), flat(b))


def intersection(a: Column, b: Column) -> Column:
    return _shape_udf(lambda x, y: kernel.intersection(load(x), load(y)))(flat(a), flat(b))


def difference(a: Column, b: Column) -> Column:
    return _shape_udf(lambda x, y: kernel.difference(load(x), load(y)))(flat(a), flat(b))


def keyholed_difference(a: Column, b: Column) -> Column:
    return _shape_udf(lambda x, y: kernel.keyhole(kernel.difference(load(x), load(y))))(flat(a), flat(b))


def intersection_area(a: Column, b: Column) -> Column:
    return _value_udf(lambda x, y: kernel.intersection_area(load(x), load(y)), "double")(flat(a), flat(b))


def union_area(a: Column, b: Column) -> Column:
    return _value_udf(lambda x, y: kernel.union_area([load(x), load(y)]), "double")(flat(a), flat(b))


def contains(a: Column, b: Column) -> Column:
    return _value_udf(lambda x, y: kernel.contains(load(x), load(y)), "boolean")(flat(a), flat(b))


def within(a: Column, b: Column) -> Column:
    return _value_udf(lambda x, y: kernel.within(load(x), load(y)), "boolean")(flat(a), flat(b))


def distance(a: Column, b: Column) -> Column:
    return _value_udf(lambda x, y: kernel.distance(load(x), load(y)), "double")(flat(a), flat(b))


def distances(a: Column, b: Column) -> Column:
    return _value_udf(lambda x, y: kernel.distances(load(x), load(y)).tolist(), "array<array<double>>")(flat(a), flat(b))


def offset(shape: Column, dist: Column) -> Column:
    return _shape_udf(lambda x, d: kernel.offset(load(x), d))(flat(shape), dist)


def offset_edges(shape: Column, dists: Column) -> Column:
    """The first ring's sides moved by their own distances."""
    return _shape_udf(lambda x, d: kernel.offset_edges(load(x)[0], d))(flat(shape), dists)


def buffer(shape: Column, dist: Column, segments: int = 8) -> Column:
    return _shape_udf(lambda x, d: kernel.buffer(load(x), d, segments))(flat(shape), dist)


def hull(shape: Column) -> Column:
    return _shape_udf(lambda x: [kernel.hull(np.vstack(load(x)))])(flat(shape))


def simplify(shape: Column, tolerance: float = 0.05) -> Column:
    return _shape_udf(lambda x: [kernel.simplify(r, tolerance) for r in load(x)])(flat(shape))


def drop_collinear(shape: Column, tolerance: float = 1e-3) -> Column:
    return _shape_udf(lambda x: [kernel.drop_collinear(r, tolerance) for r in load(x)])(flat(shape))


def shrink(shape: Column, ratio: Column) -> Column:
    return _shape_udf(lambda x, r: kernel.shrink(load(x)[0], r))(flat(shape), ratio)


def unique_regions(shape: Column) -> Column:
    return _shape_udf(lambda x: kernel.unique_regions(load(x)))(flat(shape))


def drop_contained(shape: Column) -> Column:
    return _shape_udf(lambda x: kernel.drop_contained(load(x)))(flat(shape))


def crossings(shape: Column) -> Column:
    return _value_udf(lambda x: int(sum(len(kernel.self_crossings(r)) for r in load(x))), "int")(flat(shape))


def clip_line(line: Column, shape: Column) -> Column:
    return _shape_udf(lambda p, x: kernel.clip_line(points(p), load(x)))(line, flat(shape))


def best_rectangle(shape: Column, width: Column) -> Column:
    """The angle and length of the longest rectangle of ``width`` through the centre of the vertices."""

    def one(x, w):
        s = load(x)
        return dict(zip(("angle", "length"), kernel.best_angle(s, s[0].mean(axis=0), w), strict=True))

    f = F.pandas_udf(lambda a, b: pd.DataFrame([one(x, w) for x, w in zip(a, b, strict=True)], columns=["angle", "length"]), "angle double, length double")
    return f(flat(shape), width)


def dissolve(df: DataFrame, keys: list[str], shape: str, tiles: int = 64) -> DataFrame:
    """keys and the union of each group's shapes.

    Groups are dissolved in two steps, by hashed parts and then the parts'
    unions, so that a large group isn't gathered shape by shape in one task.
    """
    schema = ", ".join(f"{df.schema[k].name} {df.schema[k].dataType.simpleString()}" for k in keys)

    def merged(pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        out = kernel.union([load(s) for s in pdf[shape]])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in names}, shape: [store(out)]})

    part = df.select(*keys, flat(F.col(shape)).alias(shape)).withColumn("_part", F.pmod(F.xxhash64(shape), F.lit(tiles)).cast("int"))
    part = part.groupBy(*keys, "_part").applyInPandas(lambda pdf: merged(pdf, [*keys, "_part"]), f"{schema}, _part int, {shape} {SHAPE}")
    part = part.withColumn(shape, flat(F.col(shape)))
    return part.groupBy(*keys).applyInPandas(lambda pdf: merged(pdf, keys), f"{schema}, {shape} {SHAPE}")
