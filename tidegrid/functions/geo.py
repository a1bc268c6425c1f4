"""Areas, distances and point-in-polygon tests as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0  # of the sphere, in metres


def _edges(centres: dict[int, float]) -> dict[int, tuple[float, float]]:
    """Lower and upper boundary of each cell by index: half-way to its neighbours, mirrored where it has none on that side.

    A lone centre is one unit wide. Where indices in between are missing, the spacing is taken to be even there."""
    at = sorted(centres)
    if len(at) == 1:
        return {at[0]: (centres[at[0]] - 0.5, centres[at[0]] + 0.5)}
    half = {i: (centres[j] - centres[i]) / (j - i) / 2 for i, j in zip(at, at[1:])}
    half[at[-1]] = half[at[-2]]
    below = dict(zip(at[1:], at))
    return {i: (centres[i] - half[below.get(i, i)], centres[i] + half[i]) for i in at}


def area_factors(latitudes: Sequence[float] | dict[int, float], longitudes: Sequence[float] | dict[int, float], radius: float = RADIUS):
    """Factors by index whose products are the areas of the cells of a regular grid on a sphere: R^2 (sin b - sin a) and the width
    in radians. Two lists for axes given as lists, else two dicts."""
    lat, lon = (_edges(x if isinstance(x, dict) else dict(enumerate(x))) for x in (latitudes, longitudes))
    rows = {i: radius * radius * abs(math.sin(math.radians(b)) - math.sin(math.radians(a))) for i, (a, b) in lat.items()}
    columns = {i: abs(math.radians(b - a)) for i, (a, b) in lon.items()}
    return (rows, columns) if isinstance(latitudes, dict) else (list(rows.values()), list(columns.values()))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    """Distance in metres along the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def numbers(values: Sequence[float]) -> Column:
    """An array of doubles as one literal: parsed once, when the plan is made, however many they are."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") if len(values) else F.array().cast("array<double>")


def strips(ring: Sequence[tuple[float, float]], most: int = 4096) -> tuple[float, float, list[int], list[tuple[float, float, float, float]]]:
    """Edges of a ring of (x, y) by strips of equal height: lowest y, height, the place of each strip's first edge (and the end), edges.

    An edge is in every strip that it touches. Strips are about as high as the edges are on the mean, so that all strips together hold a few times as many edges as the ring;
    there are ``most`` at most. Level edges are left out: no ray along them counts."""
    points = np.asarray([*ring, ring[0]], np.float64)
    x1, y1, x2, y2 = points[:-1, 0], points[:-1, 1], points[1:, 0], points[1:, 1]
    edges = np.column_stack([x1, y1, x2, y2])[y1 != y2]
    if not len(edges):
        return 0.0, 1.0, [0, 0], []
    low, high = points[:, 1].min(), points[:, 1].max()
    n = max(1, min(most, int((high - low) / np.abs(edges[:, 3] - edges[:, 1]).mean())))
    height = (high - low) / n

    def strip(y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((y - low) / height).astype(np.int64), 0, n - 1)

    a, b = strip(np.minimum(edges[:, 1], edges[:, 3])), strip(np.maximum(edges[:, 1], edges[:, 3]))
    count = b - a + 1
    which = np.repeat(np.arange(len(edges)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(n + 1))
    return float(low), float(height), first.tolist(), [tuple(e) for e in edges[which[order]].tolist()]


def tiles(ring: Sequence[tuple[float, float]], side: int = 128) -> list[list[int]]:
    """Tiles of a ring's box, ``side`` x ``side``, row by row from the lowest: 0 outside, 1 inside, 2 where an edge passes or may pass."""
    points = np.asarray([*ring, ring[0]], np.float64)
    (x0, y0), (x9, y9) = points.min(axis=0), points.max(axis=0)
    w, h = (x9 - x0) / side, (y9 - y0) / side
    x1, y1, x2, y2 = points[:-1, 0], points[:-1, 1], points[1:, 0], points[1:, 1]
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    out = []
    for r in range(side):
        a, b = y0 + (r - 1e-6) * h, y0 + (r + 1 + 1e-6) * h
        on = (low <= b) & (high >= a)
        xa, ya, xb, yb = x1[on], y1[on], x2[on], y2[on]
        with np.errstate(divide="ignore", invalid="ignore"):
            ends = [np.where(ya == yb, e, xa + (np.clip(y, a, b) - ya) * (xb - xa) / (yb - ya)) for y, e in ((ya, xa), (yb, xb))]
        c, d = (np.clip(np.floor((e - x0) / w + s * 1e-6).astype(np.int64), 0, side - 1) for e, s in ((np.minimum(*ends), -1), (np.maximum(*ends), 1)))
        steps = np.zeros(side + 1, np.int64)
        np.add.at(steps, c, 1)
        np.add.at(steps, d + 1, -1)
        middle = y0 + (r + 0.5) * h
        over = (ya > middle) != (yb > middle)
        xs = np.sort((xb[over] - xa[over]) * (middle - ya[over]) / (yb[over] - ya[over]) + xa[over])
        inside = (len(xs) - np.searchsorted(xs, x0 + (np.arange(side) + 0.5) * w, "right")) % 2
        out.append(np.where(np.cumsum(steps[:-1]) > 0, 2, inside).tolist())
    return out


#: A ring of no more edges is one expression, which Spark compiles; in one of more than ``MANY`` whole tiles are decided first. All give the same.
FEW, MANY = 16, 256


def compared(ring: Sequence[tuple[float, float]]) -> float:
    """With how many edges :func:`in_polygon` compares a point of the ring's box, on the mean."""
    if len(ring) <= FEW:
        return float(len(ring))
    _, _, first, edges = strips(ring)
    open_tiles = np.mean(np.equal(tiles(ring), 2)) if len(edges) > MANY and len({p[0] for p in ring}) > 1 else 1.0
    return float(open_tiles) * len(edges) / (len(first) - 1)


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test against a ring of (x, y): the number of edges that a ray to the right crosses is odd.

    An edge counts its lower end and not its upper one, so that a shared vertex counts once. The edges are data, in literals by
    strips of y (see :func:`strips`), so that the plan has one size whatever the ring, and a point meets only the edges of its strip; in a ring of many edges
    those points that no edge is near are decided by their tile (see :func:`tiles`). Null coordinates are nowhere: null."""

    def crosses(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)

    def within(i: Column, n: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), i.cast("double"))).cast("int")

    if len(ring) <= FEW:
        level = [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
        total = sum((crosses(*(F.lit(float(v)) for v in e)) for e in level), F.lit(0))
        return F.when(y.isNotNull() & x.isNotNull(), total % 2 == 1)
    low, height, first, edges = strips(ring)
    if not edges:
        return F.lit(False)
    n = len(first) - 1
    k = within(F.floor((y - F.lit(low)) / F.lit(height)), n)
    at = numbers(first)
    own = F.sequence(F.get(at, k).cast("int"), F.get(at, k + 1).cast("int") - 1)  # a ring has an edge in every strip
    xs, ys, xe, ye = (numbers(c) for c in zip(*edges))
    near = F.transform(own, lambda i: F.struct(F.get(xs, i).alias("x1"), F.get(ys, i).alias("y1"), F.get(xe, i).alias("x2"), F.get(ye, i).alias("y2")))
    inside = F.aggregate(near, F.lit(0), lambda total, e: total + crosses(e["x1"], e["y1"], e["x2"], e["y2"])) % 2 == 1
    xs0, xs9 = min(p[0] for p in ring), max(p[0] for p in ring)
    if len(edges) > MANY and xs0 < xs9:
        known = tiles(ring)
        side = len(known)
        place = lambda v, a, b: within(F.floor((v - F.lit(a)) / F.lit((b - a) / side)), side)
        tile = F.get(numbers([v for row in known for v in row]), place(y, low, max(p[1] for p in ring)) * side + place(x, xs0, xs9))
        box = x.between(xs0, xs9) & y.between(low, max(p[1] for p in ring))
        inside = F.when(~box | (tile == 0), False).when(tile == 1, True).otherwise(inside)
    return F.when(y.isNotNull() & x.isNotNull(), inside)
