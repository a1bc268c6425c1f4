"""Regions: rectangles, polygons and unions of polygons, as predicates on latitude and longitude."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce as fold
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import GridFrame
from ..functions.geo import FEW, compared, in_polygon, numbers

#: Places of a grid in a table that is sent to every task: the axes bound them before it is made.
BROADCAST_PLACES = 100_000
NAME = re.compile(r"^[a-zA-Z0-9-]+$")  # fixed value: what a domain may be called


@dataclass(frozen=True)
class BoundingBox:
    """Ranges of latitude and longitude, and of depth where both ends are known."""

    latitude: tuple[float, float]
    longitude: tuple[float, float]
    depth: tuple[float, float] | None = None

    @staticmethod
    def merge(boxes: Iterable[BoundingBox]) -> BoundingBox:
        """The smallest box around all; without a depth range if any has none. No box at all is a ValueError."""
        boxes = list(boxes)
        if not boxes:
            raise ValueError("there is no box to merge")

        def hull(ranges: list[tuple[float, float]]) -> tuple[float, float]:
            return min(a for a, _ in ranges), max(b for _, b in ranges)

        depths = [b.depth for b in boxes]
        return BoundingBox(hull([b.latitude for b in boxes]), hull([b.longitude for b in boxes]), None if None in depths else hull([d for d in depths if d]))


class Domain:
    """A named region. ``mask`` is true inside; ``depth`` is only used when data are ingested, not when they are analysed."""

    name: str
    depth: tuple[float, float] | None

    def __post_init__(self) -> None:
        if not NAME.match(self.name):
            raise ValueError(f"a domain's name has letters, digits and hyphens only: {self.name!r}")

    def mask(self, latitude: Column, longitude: Column) -> Column:
        raise NotImplementedError

    def corners(self) -> int:
        """The number of its vertices."""
        return 0

    def compared(self) -> float:
        """With how many edges a point of its box is compared, on the mean."""
        return 0.0

    def box(self) -> BoundingBox:
        raise NotImplementedError


@dataclass(frozen=True)
class RectangularDomain(Domain):
    """Bounds are inclusive."""

    name: str
    latitude: tuple[float, float]
    longitude: tuple[float, float]
    depth: tuple[float, float] | None = None

    def mask(self, latitude: Column, longitude: Column) -> Column:
        return latitude.between(*self.latitude) & longitude.between(*self.longitude)

    def box(self) -> BoundingBox:
        return BoundingBox(self.latitude, self.longitude, self.depth)


@dataclass(frozen=True)
class PolygonalDomain(Domain):
    """One outer ring of (longitude, latitude) vertices; what lies inside is found by the even-odd rule."""

    name: str
    ring: tuple[tuple[float, float], ...]
    depth: tuple[float, float] | None = None

    def mask(self, latitude: Column, longitude: Column) -> Column:
        inside = self.box()
        near = latitude.between(*inside.latitude) & longitude.between(*inside.longitude)  # reaches the scan
        return near & in_polygon(longitude, latitude, self.ring)

    def corners(self) -> int:
        return len(self.ring)

    def compared(self) -> float:
        return compared(self.ring)

    def box(self) -> BoundingBox:
        x, y = zip(*self.ring)
        return BoundingBox((min(y), max(y)), (min(x), max(x)), self.depth)


@dataclass(frozen=True)
class MultiPolygonalDomain(Domain):
    """What lies in any of the polygons; nothing, if there are none."""

    name: str
    polygons: tuple[PolygonalDomain, ...]
    depth: tuple[float, float] | None = None

    def mask(self, latitude: Column, longitude: Column) -> Column:
        return fold(or_, [p.mask(latitude, longitude) for p in self.polygons], F.lit(False))

    def corners(self) -> int:
        return sum(p.corners() for p in self.polygons)

    def compared(self) -> float:
        return sum(p.compared() for p in self.polygons)

    def box(self) -> BoundingBox:
        merged = BoundingBox.merge(p.box() for p in self.polygons)
        return replace(merged, depth=self.depth)


def to_geometry(domain: Domain) -> dict:
    """A domain as plain lists and dicts, to be kept as JSON."""
    out: dict = {"name": domain.name, "depth": list(domain.depth) if domain.depth else None}
    if isinstance(domain, RectangularDomain):
        return out | {"type": "rectangle", "latitude": list(domain.latitude), "longitude": list(domain.longitude)}
    if isinstance(domain, PolygonalDomain):
        return out | {"type": "polygon", "ring": [list(p) for p in domain.ring]}
    if isinstance(domain, MultiPolygonalDomain):
        return out | {"type": "polygons", "polygons": [to_geometry(p) for p in domain.polygons]}
    raise ValueError(f"a {type(domain).__name__} can't be kept")


def from_geometry(kept: dict) -> Domain:
    """The domain that :func:`to_geometry` has kept; an unknown type is a ValueError."""
    name, depth = kept["name"], tuple(kept["depth"]) if kept.get("depth") else None
    if kept["type"] == "rectangle":
        return RectangularDomain(name, tuple(kept["latitude"]), tuple(kept["longitude"]), depth)
    if kept["type"] == "polygon":
        return PolygonalDomain(name, tuple(tuple(p) for p in kept["ring"]), depth)
    if kept["type"] == "polygons":
        return MultiPolygonalDomain(name, tuple(from_geometry(p) for p in kept["polygons"]), depth)
    raise ValueError(f"the geometry type {kept['type']!r} is unknown")


def of_rings(name: str, rings: Sequence[Sequence[tuple[float, float]]], depth: tuple[float, float] | None = None) -> Domain:
    """A polygon, or the union of several; none is a ValueError."""
    if not rings:
        raise ValueError(f"{name} has no ring")
    polygons = tuple(PolygonalDomain(name if len(rings) == 1 else f"{name}-{i}", tuple(tuple(p) for p in ring), depth if len(rings) == 1 else None) for i, ring in enumerate(rings))
    return polygons[0] if len(polygons) == 1 else MultiPolygonalDomain(name, polygons, depth)


def _axes_within(frame: GridFrame, box: BoundingBox) -> list[dict[int, float]]:
    """Latitudes and longitudes of a box by index; none where the axis isn't known."""
    return [{i: float(v) for i, v in frame.axes.get(axis, {}).items() if v is not None and low <= v <= high} for axis, (low, high) in (("latitude", box.latitude), ("longitude", box.longitude))]


def _places(spark: SparkSession, axes: list[dict[int, float]], domain: Domain) -> DataFrame:
    """lat_idx, lon_idx, _lat, _lon, _inside: the places of a grid, and whether they lie in the domain."""
    rows, n = len(axes[0]) * len(axes[1]), F.lit(len(axes[1]))
    column = F.col("id") % n
    at = [((F.col("id") - column) / n).cast("int"), column.cast("int")]
    indices = [F.get(numbers(list(axis)), k).cast("int").alias(name) for axis, k, name in zip(axes, at, ("lat_idx", "lon_idx"))]
    values = [F.get(numbers(list(axis.values())), k).alias(name) for axis, k, name in zip(axes, at, ("_lat", "_lon"))]
    out = spark.range(rows).select(*indices, *values).withColumn("_inside", domain.mask(F.col("_lat"), F.col("_lon")))
    return F.broadcast(out) if rows <= BROADCAST_PLACES else out


def _cut_by_place(t: DataFrame, axes: list[dict[int, float]], domain: Domain) -> DataFrame:
    """The domain is asked once for each place of the grid, not for each cell, nor for each row that cells are made of: Spark moves a filter below
    an aggregation, but not one on what an outer join has found. Cells that don't lie where the axes have them are asked themselves."""
    lat, lon, box = F.col("latitude"), F.col("longitude"), domain.box()
    near = t.where(lat.between(*box.latitude) & lon.between(*box.longitude))  # reaches the scan
    found = near.join(_places(t.sparkSession, axes, domain), ["lat_idx", "lon_idx"], "left")
    return found.where(F.when((lat == F.col("_lat")) & (lon == F.col("_lon")), F.col("_inside")).otherwise(domain.mask(lat, lon))).select(*t.columns)


def cut_to(frame: GridFrame, domain: Domain) -> GridFrame:
    """Cells inside the domain; the others have no rows any more, which is how missing cells are stored. All axes stay, time too.

    Tables without latitude and longitude stay. A domain of many vertices is asked by places of the grid, where the axes are known: always if its box has few, else if a place is compared with many edges."""
    axes = _axes_within(frame, domain.box()) if domain.corners() > FEW else [{}, {}]
    by_place = all(axes) and (len(axes[0]) * len(axes[1]) <= BROADCAST_PLACES or domain.compared() > FEW)

    def cut(t: DataFrame) -> DataFrame:
        if not {"latitude", "longitude"} <= set(t.columns):
            return t
        if by_place and {"lat_idx", "lon_idx"} <= set(t.columns):
            return _cut_by_place(t, axes, domain)
        return t.where(domain.mask(F.col("latitude"), F.col("longitude")))

    return frame.map(cut)


def basin_polygons(basins: dict[str, Sequence], name: str) -> list:
    """Polygons of a basin of ``basins`` (name -> vertices of a ring, or names of the basins it is made of), each basin once.

    An unknown name is a ValueError."""
    out, seen, todo = [], set(), [name]
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        if at not in basins:
            raise ValueError(f"there is no basin {at}")
        parts = list(basins[at])
        if parts and isinstance(parts[0], str):
            todo += parts
        else:
            out.append(tuple(tuple(p) for p in parts))
    return out


def basin_domain(basins: dict[str, Sequence], name: str) -> MultiPolygonalDomain:
    """The union of a basin's polygons."""
    plain = re.sub(r"[^a-zA-Z0-9-]+", "-", name)
    return MultiPolygonalDomain(plain, tuple(PolygonalDomain(f"{plain}-{i}", ring) for i, ring in enumerate(basin_polygons(basins, name))))
