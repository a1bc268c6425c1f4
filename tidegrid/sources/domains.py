"""Domains from YAML files, polygons from WKT tables and shapefiles."""

from __future__ import annotations

import csv
import re
from pathlib import Path

import yaml

from ..operators.domain import Domain, PolygonalDomain, RectangularDomain, basin_domain, of_rings
from .shapefile import select_shape

_WKT = re.compile(r"^\s*POLYGON\s*(?:Z\s*)?\(\s*\(([^()]*)\)", re.I)


def ring_of_wkt(text: str) -> tuple[tuple[float, float], ...]:
    """Outer ring of a WKT polygon as (longitude, latitude) vertices; holes are ignored. Anything else is a ValueError."""
    m = _WKT.match(text)
    if not m:
        raise ValueError(f"not a WKT polygon: {text[:60]!r}")
    return tuple((float(x), float(y)) for x, y, *_ in (p.split() for p in m[1].split(",")))


def read_wkt_table(path: str | Path, name: str, column: str = "nome") -> tuple[tuple[float, float], ...]:
    """The ring of the row that is called ``name`` in a CSV file with a column WKT; no such row is a ValueError."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        for row in csv.DictReader(f):
            if row.get(column) == name:
                return ring_of_wkt(row["WKT"])
    raise ValueError(f"{path} has no row {name}")


def read_domain(path: str | Path, basins: dict | None = None, main_dir: str | Path | None = None) -> Domain:
    """The domain that a YAML file describes: name, geometry (of type rectangle, wkt, shapefile or basin), depth (optional).

    A wkt geometry names its ``file_path`` and the row ``polygon_name``, or holds a ``wkt`` text; a shapefile its ``file_path`` (.shp, or a .zip with one)
    and the record whose ``selection_field_name`` has the ``selection_field_value``, of which the outer rings count and holes don't; a basin the ``uuid`` of a
    basin of ``basins``. Paths lie beside the YAML file; ``${MAIN_DIR}`` in them is ``main_dir``, the folder above that of the file if None. A missing geometry, an unknown
    type or record is a ValueError."""
    path = Path(path)
    main = Path(main_dir) if main_dir is not None else path.resolve().parent.parent
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict) or "geometry" not in data:
        raise ValueError(f"{path} describes no geometry")
    geometry, name = data["geometry"], str(data["name"])
    kind = str(geometry.get("type", "")).lower()
    ends = [(data.get("depth") or {}).get(k) for k in ("min_depth", "max_depth")]
    depth = (float(ends[0]), float(ends[1])) if None not in ends else None

    def beside() -> Path:
        return path.parent / str(geometry.get("file_path", geometry.get("file"))).replace("${MAIN_DIR}", str(main))

    if kind == "rectangle":
        return RectangularDomain(name, (float(geometry["min_latitude"]), float(geometry["max_latitude"])), (float(geometry["min_longitude"]), float(geometry["max_longitude"])), depth)
    if kind == "wkt":
        ring = ring_of_wkt(geometry["wkt"]) if "wkt" in geometry else read_wkt_table(beside(), str(geometry.get("polygon_name", geometry.get("polygon", name))))
        return PolygonalDomain(name, ring)
    if kind == "shapefile":
        return of_rings(name, select_shape(beside(), geometry["selection_field_name"], geometry["selection_field_value"]).outer, depth)
    if kind == "basin":
        return basin_domain(basins or {}, str(geometry.get("uuid", geometry.get("basin"))))
    raise ValueError(f"{path}: the geometry type {kind!r} is unknown; known are rectangle, wkt, shapefile, basin")
