"""The largest legal building on a parcel, by search over footprint templates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SHAPE
from . import geo_udf, kernel

TEMPLATES = ("I", "L", "H", "C", "S", "Z", "T", "II")
#: Fixed values of the objectives and of the status queue.
PENALTY, RESIDUAL_POWER, WIDTH_RATIO, LOW_COVERAGE, TOLERANCE = 1e5, 1.1, 1.6, 0.4, 1e-3
#: The part of a number by which the next stage may change it.
NARROW = 0.1
PENDING, DONE, ERROR, INFEASIBLE, LOW = 0, 1, 191, 192, 193
PROVISIONAL, PROVISIONAL_ERROR, ECONOMIC, ECONOMIC_ERROR = 2, 29, 3, 39


def rectangle(x: float, y: float, w: float, h: float, angle: float = 0.0, about=None) -> np.ndarray:
    """A rectangle from its corner, turned around ``about`` (the corner itself)."""
    return turned(np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]]), angle, (x, y) if about is None else about)


def turned(r: np.ndarray, angle: float, about) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    d = r - np.asarray(about)
    return np.column_stack([d[:, 0] * c - d[:, 1] * s, d[:, 0] * s + d[:, 1] * c]) + about


def footprint(template: str, v: np.ndarray, separation: float) -> list[np.ndarray]:
    """The wings of a building. v: floors, angle, x, y, then the template's own numbers (see limits)."""
    angle, at, own = v[1], np.array([v[2], v[3]]), v[4:]
    x, y = at

    def wing(dx, dy, w, h, tilt=0.0, hinge=None):
        """A rectangle set at (dx, dy), tilted around its hinge, then turned with the whole building."""
        hinge = (x + dx, y + dy) if hinge is None else (x + hinge[0], y + hinge[1])
        return turned(rectangle(x + dx, y + dy, w, h, tilt, hinge), angle, at)

    if template == "I":
        return [wing(0, 0, own[0], own[1])]
    if template == "L":
        tilt, l1, l2, w1, w2 = own
        return [wing(0, 0, l1, w1), wing(0, 0, w2, l2, tilt)]
    if template == "H":
        long, left1, right1, left2, right2, w, w1, w2 = own
        return [wing(0, 0, w, long), wing(-left1, -w1, left1 + w + right1, w1), wing(-left2, long, left2 + w + right2, w2)]
    if template == "T":
        long, shift, l1, w, w1 = own
        return [wing(0, 0, w, long), turned(rectangle(x + w, y + shift, l1, w1), angle, (x + w, y + shift))]
    if template == "II":
        t1, t2, l1, l2, gap, drop, w1, w2 = own
        return [wing(0, 0, w1, l1, t1, (w1, 0)), wing(w1 + gap, -drop, w2, l2, t2)]
    t1, t2, long, l1, l2, w, w1, w2 = own
    if template == "C":
        long = max(long, separation + w1 + w2)
        return [wing(0, 0, long, w), wing(0, 0, w1, l1, t1), wing(long - w2, 0, w2, l2, t2, (long, 0))]
    long = max(long, separation + 2 * w)
    if template == "S":
        return [wing(0, 0, w, long), wing(0, long, w1, l1, t1 - math.pi / 2), wing(w, 0, w2, l2, t2 + math.pi / 2)]
    return [wing(0, 0, w, long), wing(0, 0, l1, w1, -t1), wing(w, long, l2, w2, math.pi - t2)]


def limits(template: str, floors: tuple[int, int], ring: np.ndarray, separation: float, diagonal: float, widths: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of a template's numbers."""
    (w0, w1), right = widths, math.pi / 2
    long, wide, tilt, back = (w0, diagonal), (w0, w1), (0.0, right), (-right, 0.0)
    own = {
        "I": [wide, long],
        "L": [tilt, long, long, wide, wide],
        "H": [(separation, diagonal), long, long, long, long, wide, wide, wide],
        "C": [tilt, back, (separation + 2 * w0, max(separation + 2 * w0, diagonal)), long, long, wide, wide, wide],
        "S": [tilt, tilt, long, long, long, wide, wide, wide],
        "Z": [tilt, tilt, long, long, long, wide, wide, wide],
        "T": [long, (-diagonal, diagonal), long, wide, wide],
        "II": [tilt, back, long, long, (separation, diagonal), (-diagonal, diagonal), wide, wide],
    }[template]
    lo, hi = ring.min(axis=0), ring.max(axis=0)
    every = [(min(floors[0], floors[1] - 1), floors[1]), (-math.pi, math.pi), (lo[0], hi[0]), (lo[1], hi[1]), *own]
    return tuple(np.array(x, float) for x in zip(*every, strict=True))


def width_places(template: str) -> list[int]:
    """Where a template's widths stand among its numbers."""
    return {"I": [4], "L": [7, 8], "H": [9, 10, 11], "T": [7, 8], "II": [10, 11]}.get(template, [9, 10, 11])


def measure(template: str, v: np.ndarray, separation: float, allowed: kernel.Shape) -> tuple[float, float]:
    """The footprint's area, and how much of it lies outside what is allowed."""
    wings = [[w] for w in footprint(template, v, separation)]
    area = kernel.union_area(wings)
    n = len(wings)
    return area, kernel.overlay_area([*wings, allowed], lambda s: any(s[:n]) and not s[n])


def base_objective(template: str, v, separation: float, allowed: kernel.Shape) -> float:
    """To be least: the negative area, residuals penalised by their cube."""
    area, outside = measure(template, v, separation, allowed)
    return -(area - PENALTY * ((1 + outside) ** 3 - 1))


def slice_at(slices: list[tuple[float, kernel.Shape]], height: float) -> kernel.Shape:
    """The shape at a height between slices; the lower one where corners differ."""
    heights = [h for h, _ in slices]
    k = int(np.searchsorted(heights, height))
    if k == 0:
        return slices[0][1]
    if k == len(slices):
        return slices[-1][1]
    (h0, a), (h1, b) = slices[k - 1], slices[k]
    if len(a) == len(b) and all(len(p) == len(q) for p, q in zip(a, b, strict=True)):
        t = (h1 - height) / (h1 - h0)
        return [t * p + (1 - t) * q for p, q in zip(a, b, strict=True)]
    return a


def volume_objective(template, v, separation, slices, floor_height, max_coverage, max_built, common_share, terrace_share) -> float:
    """To be least: the negative floor area, with residual and built area penalised."""
    floors = int(round(v[0]))
    height = min(v[0] * floor_height, slices[-1][0])
    area, outside = measure(template, v, separation, slice_at(slices, height))
    built = area * (floors - 1) + min(area, max_coverage)
    over = max(0.0, built / (1 + common_share + 0.5 * terrace_share) - max_built)
    return -(floors * area - PENALTY * ((1 + outside) ** 3 - 1) - over)


def constrained(template, v, separation, slices, floor_height, max_coverage, max_built, common_share, terrace_share, shadows=None, public=(), streets=()) -> tuple[float, np.ndarray]:
    """The negative floor area and the constraints' violations: residual, built area, shadows, widths."""
    from .zoning import building_shadow

    floors = int(round(v[0]))
    height = min(v[0] * floor_height, slices[-1][0])
    area, outside = measure(template, v, separation, slice_at(slices, height))
    built = area * (floors - 1) + min(area, max_coverage)
    out = [outside**RESIDUAL_POWER, max(0.0, built / (1 + common_share + 0.5 * terrace_share) - max_built)]
    if shadows:
        wings = footprint(template, v, separation)
        out.append(sum(max(0.0, kernel.area(building_shadow(wings, height, k, public, streets)) - most) for k, most in shadows.items()))
    w = v[width_places(template)]
    out.append(max(0.0, float(w.max() / w.min()) - WIDTH_RATIO))
    return -(floors * area), np.array(out)


def differential_evolution(f: Callable, low: np.ndarray, high: np.ndarray, steps: int, restarts: int, seed: int, fix_floors: bool = True) -> tuple[np.ndarray, float]:
    """The best of ``restarts`` searches of ``steps`` trials each; rates adapt to what succeeds. Floors stay at their most."""
    low = low.copy()
    if fix_floors:
        low[0] = high[0]
    best, value = None, np.inf
    for k in range(restarts):
        rng = np.random.default_rng([seed, k])
        n = max(8, 2 * len(low))
        x = low + rng.random((n, len(low))) * (high - low)
        fx = np.array([f(p) for p in x])
        rate, cross = np.full(n, 0.6), np.full(n, 0.8)
        for step in range(max(0, steps - n)):
            i = step % n
            a, b, c = x[rng.choice(n, 3, replace=False)]
            w = rng.uniform(0.1, 1.0) if rng.random() < 0.1 else rate[i]
            p = rng.random() if rng.random() < 0.1 else cross[i]
            y = np.where((rng.random(len(low)) < p) | (np.arange(len(low)) == rng.integers(len(low))), a + w * (b - c), x[i])
            y = np.where((y < low) | (y > high), low + rng.random(len(low)) * (high - low), y)
            fy = f(y)
            if fy <= fx[i]:
                x[i], fx[i], rate[i], cross[i] = y, fy, w, p
        j = int(fx.argmin())
        if fx[j] < value:
            best, value = x[j], float(fx[j])
    return best, value


def pattern_search(f: Callable, low: np.ndarray, high: np.ndarray, x0: np.ndarray, evaluations: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """From x0, smaller and smaller steps; first fewer violations, then a lower objective. The first number stays whole."""
    rng = np.random.default_rng(seed)
    x = np.clip(x0, low, high)
    x[0] = round(x[0])
    value, broken = f(x)
    size, used = 0.25, 1
    worse = lambda b: float(np.maximum(b - TOLERANCE, 0).sum())
    while used < evaluations and size > 1e-5:
        better = False
        d = np.linalg.qr(rng.normal(size=(len(x), len(x))))[0]
        for way in [*np.eye(len(x)), *-np.eye(len(x)), *d]:
            y = np.clip(x + way * size * (high - low), low, high)
            y[0] = round(y[0])
            fy, by = f(y)
            used += 1
            if (worse(by), fy) < (worse(broken), value) and not np.array_equal(x, y):
                x, value, broken, better = y, fy, by, True
                break
            if used >= evaluations:
                break
        size = min(size * 2, 0.5) if better else size / 2
    return x, value, broken


RESULT = "key bigint, status int, template string, floors int, area double, coverage double, residual double, x array<double>"


def slices_of(build: kernel.Shape, gross: kernel.Shape, slope: float | None, max_height: float, count: int = 24) -> list[tuple[float, kernel.Shape]]:
    """The envelope: the build area cut by the gross area, which moves in by height / slope; without a slope a prism."""
    if not slope or not gross:
        return [(0.0, build), (float(max_height), build)]
    out = []
    for h in np.linspace(0.0, float(max_height), count):
        cut = kernel.intersection(kernel.offset(gross, -h / slope), build)
        if not cut or kernel.area(cut) <= 0:
            break
        out.append((float(h), cut))
    return out


def narrowed(x: np.ndarray, low: np.ndarray, high: np.ndarray, share: float = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """The limits within ``share`` of a solution's numbers, small ones within as much of a tenth of their limits."""
    reach = share * np.maximum(np.abs(x), 0.1 * (high - low))
    return np.maximum(low, x - reach), np.minimum(high, x + reach)


def best_building(parcels: DataFrame, templates=("I", "L"), floor_height: float = 2.65, separation: float = 7.0, widths=(8.0, 20.0), steps: int = 200, restarts: int = 2, volume_steps: int = 200, volume_restarts: int = 1, refine: int = 200, tries: int = 2) -> DataFrame:
    """RESULT for each row of (key, build: shape, max_floors, max_height, max_coverage, max_built).

    Rows may also have ``gross`` (shape) and ``slope``: then the envelope has
    sloping sides, and the building's shadows must not exceed the envelope's.
    Three stages: templates are searched for coverage of the build area; the
    best ``tries`` for floor area in the envelope, in limits narrowed around the
    first stage's; then they are refined with all constraints. A best coverage
    of LOW_COVERAGE or less ends the search. The seed comes from the key:
    results don't depend on partitions. Failures are a status, not an error.
    """
    from .zoning import envelope_shadow

    def one(key, build, max_floors, max_height, max_coverage, max_built, gross, slope):
        shape, around = geo_udf.load(build), geo_udf.load(gross)
        nothing = (None,) * 6
        if not shape or kernel.area(shape) <= 0:
            return key, INFEASIBLE, *nothing
        ring = max(shape, key=lambda r: abs(kernel.ring_area(r)))
        diagonal = float(np.linalg.norm(np.ptp(ring, axis=0)))
        slices = slices_of(shape, around, None if slope is None or np.isnan(slope) else slope, max_height)
        if not slices:
            return key, INFEASIBLE, *nothing
        floors = max(1, min(int(max_floors), int(slices[-1][0] // floor_height)))
        shadows = {k: kernel.area(envelope_shadow(slices, k)) for k in "pos"} if len(slices) > 2 else None
        found = []
        for t in templates:
            low, high = limits(t, (1, floors), ring, separation, diagonal, (min(widths[0], diagonal), min(widths[1], diagonal)))
            x, value = differential_evolution(lambda v, t=t: base_objective(t, v, separation, shape), low, high, steps, restarts, int(key) * 31 + len(t))
            found.append((value, t, x, low, high))
        found.sort(key=lambda r: r[0])
        _, t, x, _, _ = found[0]
        area, outside = measure(t, x, separation, shape)
        coverage = area / kernel.area(shape)
        if coverage <= LOW_COVERAGE:
            return key, LOW, t, int(round(x[0])), area, coverage, outside, x.tolist()
        best, told = None, (slices, floor_height, max_coverage, max_built, 0.2, 0.1)
        for _, t, x, low, high in found[:tries]:
            near = narrowed(x, low, high)
            near[0][0], near[1][0] = low[0], high[0]  # floors are the second stage's to choose
            x, _ = differential_evolution(lambda v, t=t: volume_objective(t, v, separation, *told), *near, volume_steps, volume_restarts, int(key) * 37 + len(t), fix_floors=False)
            x, value, broken = pattern_search(lambda v, t=t: constrained(t, v, separation, *told, shadows), *narrowed(x, low, high), x, refine, int(key))
            if (broken <= TOLERANCE).all() and (best is None or value < best[0]):
                best = (value, t, x)
        if best is None:
            return key, INFEASIBLE, *nothing
        _, t, x = best
        area, outside = measure(t, x, separation, slice_at(slices, min(x[0] * floor_height, slices[-1][0])))
        return key, DONE, t, int(round(x[0])), area, area / kernel.area(shape), outside, x.tolist()

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    rows.append(one(*r))
                except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                    rows.append((r[0], ERROR, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["key", "status", "template", "floors", "area", "coverage", "residual", "x"]).astype({"floors": "Int32"})

    given = {"gross": F.lit(None).cast(SHAPE), "slope": F.lit(None).cast("double")} | {c: F.col(c) for c in ("gross", "slope") if c in parcels.columns}
    own = parcels.select(F.col("key").cast("bigint").alias("key"), geo_udf.flat(F.col("build")).alias("build"), F.col("max_floors").cast("int").alias("max_floors"), *[F.col(c).cast("double").alias(c) for c in ("max_height", "max_coverage", "max_built")], geo_udf.flat(given["gross"]).alias("gross"), given["slope"].alias("slope"))
    return own.repartition("key").mapInPandas(run, RESULT)


def reset_queue(df: DataFrame) -> DataFrame:
    """Every combo pending again."""
    return df.withColumn("status", F.lit(PENDING))
