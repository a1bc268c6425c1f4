"""Polygons and attributes of ESRI shapefiles, read from their bytes; also of one in a zip archive."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs

from .store import Location, place

Ring = tuple[tuple[float, float], ...]
_POLYGONS = (5, 15, 25)  # plain, with z, with measures: these begin alike
_HEADER = 100


@dataclass(frozen=True)
class Shape:
    """A record: its outer rings of (longitude, latitude), its holes, and its attributes by name."""

    outer: tuple[Ring, ...]
    holes: tuple[Ring, ...]
    attributes: dict[str, object]


def area(ring: Ring) -> float:
    """Signed area: negative for a ring that runs clockwise, as outer rings do."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, (*ring[1:], ring[0]))) / 2


def read_shp(raw: bytes) -> Iterator[list[Ring]]:
    """The rings of each record, none for a null shape. Anything but polygons, or a file that is cut off, is a ValueError."""
    if len(raw) < _HEADER or struct.unpack(">i", raw[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    kind = struct.unpack("<i", raw[32:36])[0]
    if kind not in (0, *_POLYGONS):
        raise ValueError(f"shapes of the type {kind} are not polygons")
    at, size = _HEADER, 2 * struct.unpack(">i", raw[24:28])[0]
    if size > len(raw):
        raise ValueError(f"the file has {len(raw)} of {size} bytes")
    while at + 8 <= size:
        _, words = struct.unpack(">ii", raw[at : at + 8])
        record, at = raw[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        if len(record) < 4 or at > size:
            raise ValueError("a record reaches over the end of the file")
        if struct.unpack("<i", record[:4])[0] == 0:
            yield []
            continue
        parts, points = struct.unpack("<ii", record[36:44])
        first = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), points]
        flat = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
        pairs = list(zip(flat[::2], flat[1::2]))
        yield [tuple(pairs[a:b]) for a, b in zip(first, first[1:])]


def read_dbf(raw: bytes, encoding: str = "utf-8") -> list[dict[str, object]]:
    """Attributes of each record, deleted ones too: text stripped, numbers as int or float, logical values as bool, blank ones as None."""
    count, header, size = struct.unpack("<IHH", raw[4:12])
    fields = []
    for at in range(32, header - 1, 32):
        if raw[at] == 0x0D:
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    out = []
    for r in range(count):
        at, row = header + r * size + 1, {}
        for name, kind, width, decimals in fields:
            text, at = raw[at : at + width].decode(encoding, "replace").strip("\0 "), at + width
            if not text or set(text) == {"*"} or text == "?":
                row[name] = None
            elif kind in "NF":
                row[name] = float(text) if decimals or kind == "F" or "." in text else int(text)
            else:
                row[name] = text in "TtYy" if kind == "L" else text
        out.append(row)
    return out


def _files(path: Location) -> tuple[bytes, bytes | None]:
    """The bytes of the .shp file and of the .dbf file beside it."""
    store, at = place(path)
    with store.open_input_stream(at) as f:
        raw = f.read()
    if not at.lower().endswith(".zip"):
        for tail in (".dbf", ".DBF"):
            beside = at[:-4] + tail
            if store.get_file_info(beside).type == pafs.FileType.File:
                with store.open_input_stream(beside) as f:
                    return raw, f.read()
        return raw, None
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".shp") and not n.endswith("/")]
        if len(names) != 1:
            raise ValueError(f"{path} holds {'no shapefile' if not names else 'more than one shapefile: ' + ', '.join(sorted(names))}")
        beside = [n for n in z.namelist() if n[:-4] == names[0][:-4] and n.lower().endswith(".dbf")]
        return z.read(names[0]), z.read(beside[0]) if beside else None


def read_shapes(path: Location) -> list[Shape]:
    """The records of a .shp file, or of the only one in a .zip file (none, or more than one there, is a ValueError).

    Rings that run clockwise are outer ones, the others holes; a record with holes alone has them as outer ones, as some writers turn rings around."""
    shp, dbf = _files(path)
    rings = list(read_shp(shp))
    rows = read_dbf(dbf) if dbf is not None else [{} for _ in rings]
    if len(rows) != len(rings):
        raise ValueError(f"{path} has {len(rings)} shapes and {len(rows)} rows of attributes")
    out = []
    for own, row in zip(rings, rows):
        outer, holes = tuple(r for r in own if area(r) < 0), tuple(r for r in own if area(r) >= 0)
        out.append(Shape(outer or holes, holes if outer else (), row))
    return out


def select_shape(path: Location, field: str, value: object) -> Shape:
    """The first record whose attribute ``field`` is ``value``; an unknown field, or no such record, is a ValueError."""
    shapes = read_shapes(path)
    if not any(field in s.attributes for s in shapes):
        raise ValueError(f"{path} has no field {field}")
    for s in shapes:
        if s.attributes[field] == value and s.outer:
            return s
    raise ValueError(f"{path} has no shape whose {field} is {value}")
