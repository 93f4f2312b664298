"""The decisions in plain form, a location or a project at a time: what the operators on DataFrames are held against."""

from __future__ import annotations

import numpy as np

from lotwright.operators.economics import _PER_SALE, LARGE_UNIT, SPREAD, UNIT_COSTS, VAT


def parking(units_parking: float, visitor_share: float = 0.15, bikes: float = 0.5, per_space: float = 3.0) -> float:
    """The spaces to sell: one for each unit's need, or the normal ones less the bicycles' discount and the visitors'."""
    normal = units_parking * (1 + visitor_share)
    return max(units_parking, normal - normal * bikes / per_space - units_parking * visitor_share)


def disabled_parking(dwellings: float) -> float:
    for most, spaces in ((20, 1), (50, 2), (200, 3), (400, 4), (500, 5)):
        if dwellings <= most:
            return float(spaces)
    return 0.01 * dwellings


def evaluate(units: np.ndarray, types: dict[str, np.ndarray], project: dict, costs: dict | None = None) -> dict:
    """Areas, sales, the costs without land, and the best land price a square metre of one mix."""
    c = UNIT_COSTS | (costs or {})
    total = lambda name: float(units @ types[name])
    land, base, floors = project["land"], project["base"], project["floors"]
    above = base * (floors - 1) + min(base, project["max_coverage"])
    spaces, stores = parking(total("parking")), total("storage")
    below = 30.0 * spaces + 5.0 * stores
    util, sales = total("util"), total("price")
    common = above - total("terrace") - total("interior")
    build = c["slab_above"] * above + c["slab_below"] * below + c["inspection"] * c["duration"]
    per_sale = sum(c[n] for n in _PER_SALE)
    rest = (
        c["demolition"] * land
        + build * (1 + c["financing"])
        + c["architecture"] * util
        + (c["structure"] + c["specialties"]) * (above + below)
        + (c["soil"] + c["topography"]) * land
        + c["connections"] * float(units.sum())
        + c["permits"]
        + per_sale * sales
        + c["sales_room"]
        + c["accounting"] * c["duration"]
        + VAT / (1 + VAT) * sales
    )
    per_price = land * (1 - VAT + c["commission"] + c["other_land"])
    return {"units": float(units.sum()), "util": util, "common": common, "parking": spaces, "storage": stores, "above": above, "below": below, "sales": sales, "rest": rest, "per_price": per_price, "price": (sales / project["return"] - rest) / per_price}


def total_cost(found: dict, price: float) -> float:
    return found["rest"] + found["per_price"] * price


def allowed(units: np.ndarray, types: dict[str, np.ndarray], project: dict, found: dict) -> bool:
    used = types["util"][units > 0]
    return bool(
        units.sum() <= project["max_units"] + 1e-9
        and found["common"] >= found["util"] * project["common_share"] - 1e-9
        and (not len(used) or used.max() <= SPREAD * used.min() + 1e-9)
        and (project.get("far", 1.0) > 0 or not (used >= LARGE_UNIT).any())
    )


def best_mix(types: dict[str, np.ndarray], project: dict, costs: dict | None = None) -> dict | None:
    """The allowed mix of the greatest non-negative price, ties to the first in order of counts; None if there is none."""
    types = {k: np.asarray(v, float) for k, v in types.items()}
    n, factor = len(types["util"]), project["floors"] - 1
    above = project["base"] * factor + min(project["base"], project["max_coverage"])
    # What a floor's units take of the slab: their own area and the common share.
    need = (types["terrace"] + types["interior"] + project["common_share"] * types["util"]) * factor
    best = None
    counts = np.zeros(n, int)

    def go(k: int, area: float, units: int) -> None:
        nonlocal best
        if k == n:
            own = counts * factor
            found = evaluate(own.astype(float), types, project, costs)
            if found["price"] >= 0 and allowed(own, types, project, found) and (best is None or found["price"] > best["price"] + 1e-12):
                best = found | {"per_floor": counts.tolist(), "mix": own.tolist()}
            return
        used = types["util"][:k][counts[:k] > 0]
        while True:
            go(k + 1, area, units)
            counts[k] += 1
            area, units = area + need[k], units + factor
            sizes = np.append(used, types["util"][k])
            if factor < 1 or area > above + 1e-9 or units > project["max_units"] + 1e-9 or sizes.max() > SPREAD * sizes.min() + 1e-9 or project.get("far", 1.0) <= 0 and types["util"][k] >= LARGE_UNIT:
                break
        counts[k] = 0

    go(0, 0.0, 0)
    return best


def strategic(combos: list[int], lots: int) -> int | None:
    """The smallest set of lots (as bits) that meets every combo, and, for each lot outside it, lies whole in a combo without that lot.

    Lots of all combos belong to it. Ties go to the smallest number. Sets are
    tried by size: the definition, for a few lots; strategic_lots() finds the same
    for many locations and lots.
    """
    forced = -1
    for c in combos:
        forced &= c
    forced &= (1 << lots) - 1

    def fits(s: int) -> bool:
        return all(c & s for c in combos) and all(s >> k & 1 or any(not c >> k & 1 and c & s == s for c in combos) for k in range(lots))

    def grow(s: int, left: int, low: int):
        if left == 0:
            if fits(s):
                yield s
            return
        missed = next((c for c in combos if not c & s), None)
        for k in range(lots):
            if not s >> k & 1 and (missed >> k & 1 if missed is not None else k >= low):
                yield from grow(s | 1 << k, left - 1, 0 if missed is not None else k + 1)

    size = bin(forced).count("1")
    for more in range(lots - size + 1):
        found = min(grow(forced, more, 0), default=None)
        if found is not None:
            return found
    return None


def lot_values(c: np.ndarray, area: np.ndarray, combo_value: np.ndarray) -> np.ndarray:
    """Each lot's area times its combos' value by their area."""
    own = c.T.astype(float)
    return own @ combo_value / np.maximum(own @ (c @ area), 1e-12) * area


def bounds(c, market, area, combo_value, d_lots: float, d_combos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prices at which lots surely aren't and are bought, and combos surely are and aren't sold."""
    value = lot_values(c, area, combo_value)
    return np.minimum(market, value) * (1 - d_lots), np.maximum(market, value) * (1 + d_lots), combo_value * (1 - d_combos), combo_value * (1 + d_combos)


def purchase_probabilities(c, lots, low, high) -> np.ndarray:
    """That exactly a combo's lots are bought, for each combo."""
    p = (lots - low) / (high - low)
    return np.prod(np.where(c == 1, p, 1 - p), axis=1)


def expected_utility(lots, combos, c, market, limits) -> float:
    low, high, low_c, high_c = limits
    sold = (high_c - combos) / (high_c - low_c)
    gain = (combos - c @ lots) * sold + c @ (market - lots) * (1 - sold)
    return float(gain @ purchase_probabilities(c, lots, low, high))


def start(limits) -> tuple[np.ndarray, np.ndarray]:
    low, high, low_c, high_c = limits
    return (low + high) / 2, (low_c + high_c) / 2


def blocks_of(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The connected parts of a membership matrix: (rows, columns) of each, by their first column; unused lots are in none."""
    of, out = np.full(c.shape[1], -1), []
    for first in range(c.shape[1]):
        if of[first] >= 0 or not c[:, first].any():
            continue
        columns = np.zeros(c.shape[1], bool)
        columns[first] = True
        while True:
            rows = (c[:, columns] > 0).any(axis=1)
            more = (c[rows] > 0).any(axis=0)
            if (more == columns).all():
                break
            columns = more
        of[columns] = first
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))
    return out


def start_utility(c, market, area, combo_value, d_lots=0.1, d_combos=0.2) -> float:
    """The utility in the middle of the price ranges, summed over the connected parts."""
    total = 0.0
    for rows, columns in blocks_of(c):
        part, own = c[np.ix_(rows, columns)].astype(float), market[columns]
        limits = bounds(part, own, area[columns], combo_value[rows], d_lots, d_combos)
        total += expected_utility(*start(limits), part, own, limits)
    return total


def optimise(c, market, area, combo_value, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Bids, prices and their utility: each connected part by itself, utilities added.

    Whether exactly a combo's lots are bought concerns the lots of its part
    only. Lots without a combo get their market price.
    """
    c = np.asarray(c)
    market, area, combo_value = (np.asarray(v, float) for v in (market, area, combo_value))
    lots, combos, total = market.copy(), np.zeros(len(combo_value)), 0.0
    for rows, columns in blocks_of(c):
        lots[columns], combos[rows], utility = _optimise_part(c[np.ix_(rows, columns)], market[columns], area[columns], combo_value[rows], **options)
        total += utility
    return lots, combos, total


def _optimise_part(c, market, area, combo_value, d_lots=0.1, d_combos=0.2, d_opt_lots=0.0, d_opt_combos=0.2, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """One part, by coordinate ascent in the box, from the middle of the price ranges.

    In one price the utility is a quadratic, so each step is exact: three values
    tell it. The box goes from the market's to the project's value of a lot, the
    deltas wider, and holds the start.
    """
    c = np.asarray(c, float)
    market, area, combo_value = (np.asarray(v, float) for v in (market, area, combo_value))
    limits = bounds(c, market, area, combo_value, d_lots, d_combos)
    lots, combos = start(limits)
    value = lot_values(c, area, combo_value)
    low = np.concatenate([market * (1 - d_opt_lots), combo_value * (1 - d_opt_combos)])
    high = np.concatenate([value * (1 + d_opt_lots), combo_value * (1 + d_opt_combos)])
    x, n = np.concatenate([lots, combos]), len(lots)
    low, high = np.minimum(low, x), np.maximum(high, x)
    f = lambda y: expected_utility(y[:n], y[n:], c, market, limits)
    best = f(x)
    for _ in range(rounds):
        before = best
        for k in range(len(x)):
            a, b = low[k], high[k]
            if b - a < 1e-12:
                continue
            tries = np.array([a, (a + b) / 2, b])
            values = []
            for t in tries:
                y = x.copy()
                y[k] = t
                values.append(f(y))
            q2, q1, _ = np.polyfit(np.array([0, 0.5, 1]), values, 2)
            at = [0.0, 1.0] + ([float(np.clip(-q1 / (2 * q2), 0, 1))] if q2 < -1e-15 else [])
            for s in at:
                y = x.copy()
                y[k] = a + (b - a) * s
                v = f(y)
                if v > best + 1e-9:
                    best, x = v, y
        if best - before < 1e-6 * max(1.0, abs(best)):
            break
    return x[:n], x[n:], best


def marginal_lot_values(c, market, area, combo_value, **options) -> np.ndarray:
    """The utility lost without each lot and its combos."""
    c = np.asarray(c)
    whole = optimise(c, market, area, combo_value, **options)[2]
    out = []
    for j in range(c.shape[1]):
        rows = c[:, j] == 0
        used = c[rows].sum(axis=0) > 0
        rest = optimise(c[rows][:, used], np.asarray(market)[used], np.asarray(area)[used], np.asarray(combo_value)[rows], **options)[2] if rows.any() else 0.0
        out.append(whole - rest)
    return np.array(out)
