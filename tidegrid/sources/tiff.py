"""GeoTIFF files of one band: strips of one row each, packed, on geographic coordinates; read by byte range."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Tags of the format, and the types of their values (code -> struct character).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
TILE_WIDTH, SCALE, TIEPOINT, KEYS, NODATA = 322, 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Version 1.1.0 with three keys: a geographic model, cells as areas, and WGS 84.
_GEOGRAPHIC = [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]


@dataclass(frozen=True)
class Raster:
    """``offsets`` and ``counts`` of the strips, each of ``rows`` rows; ``west`` and ``north`` are the outer corner, ``dx`` and ``dy`` the sizes of a cell."""

    width: int
    height: int
    dtype: np.dtype
    samples: int
    packed: bool
    rows: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    west: float
    north: float
    dx: float
    dy: float
    nodata: float | None

    def longitudes(self) -> list[float]:
        return [self.west + (j + 0.5) * self.dx for j in range(self.width)]

    def latitudes(self) -> list[float]:
        """The north one first, as rows are."""
        return [self.north - (i + 0.5) * self.dy for i in range(self.height)]


def encode_row(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<f8").tobytes(), 6)


def file_head(lengths: list[int]) -> bytes:
    """The beginning of a big TIFF, which says where its directory is: behind the strips."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + sum(lengths) + (-sum(lengths)) % 8)


def directory(width: int, lengths: list[int], west: float, north: float, dx: float, dy: float, nodata: str = "nan") -> bytes:
    """What follows the strips: the directory, with the places of the strips from the sums of their lengths, and values too long for it."""
    pad = b"\0" * (-sum(lengths) % 8)
    at = 16 + sum(lengths) + len(pad)
    offsets = (16 + np.concatenate([[0], np.cumsum(lengths)[:-1]])).astype(int).tolist() if lengths else []
    tags = [
        (WIDTH, 4, [width]), (LENGTH, 4, [len(lengths)]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 16, offsets), (SAMPLES, 3, [1]), (ROWS, 4, [1]), (COUNTS, 16, lengths),
        (PLANAR, 3, [1]), (FORMAT, 3, [3]), (SCALE, 12, [dx, dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (KEYS, 3, _GEOGRAPHIC), (NODATA, 2, nodata.encode() + b"\0"),
    ]
    body, more, after = struct.pack("<Q", len(tags)), b"", at + 8 + 20 * len(tags) + 8
    for tag, kind, values in tags:
        raw = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        n = len(values)
        if len(raw) > 8:
            place = struct.pack("<Q", after + len(more))
            more += raw + b"\0" * (-len(raw) % 8)
        else:
            place = raw.ljust(8, b"\0")
        body += struct.pack("<HHQ", tag, kind, n) + place
    return pad + body + struct.pack("<Q", 0) + more


def read_raster(read: Callable[[int, int], bytes]) -> Raster:
    """The first directory of a TIFF (also a big one, of either byte order), from ``read`` (place, length). Tiles, other packings and predictors, and several planes are a ValueError."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or struct.unpack(f"{order}H", start[2:4])[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    big = struct.unpack(f"{order}H", start[2:4])[0] == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, 8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    raw = read(at + (8 if big else 2), n * size)
    if len(raw) != n * size:
        raise ValueError("the file ends within its directory")
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", raw, k * size)
        if kind not in _TYPES:
            continue
        length = count * struct.calcsize(_TYPES[kind])
        field = raw[k * size + size - inline : (k + 1) * size]
        own = field[:length] if length <= inline else read(struct.unpack(f"{order}{'Q' if big else 'I'}", field)[0], length)
        tags[tag] = (own,) if kind == 2 else struct.unpack(f"{order}{count}{_TYPES[kind]}", own)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    samples = one(SAMPLES, 1)
    if TILE_WIDTH in tags or OFFSETS not in tags:
        raise ValueError("the image is not in strips")
    if one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) != 1 or samples > 1 and one(PLANAR, 1) != 1:
        raise ValueError(f"the packing {one(COMPRESSION, 1)} with the predictor {one(PREDICTOR, 1)} can't be read")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS, 1) // 8}")
    dx, dy = tags.get(SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIEPOINT, (0.0,) * 6)
    nodata = tags[NODATA][0].rstrip(b"\0 ").decode() if NODATA in tags else ""
    return Raster(
        one(WIDTH, 0), one(LENGTH, 0), dtype, samples, one(COMPRESSION, 1) != 1, min(one(ROWS, one(LENGTH, 0)), one(LENGTH, 0)), tuple(tags[OFFSETS]), tuple(tags[COUNTS]),
        tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy, float(nodata) if nodata else None,
    )


def read_strip(r: Raster, k: int, read: Callable[[int, int], bytes]) -> np.ndarray:
    """The first band of a strip as doubles, missing values as NaN: rows x width."""
    raw = read(r.offsets[k], r.counts[k])
    values = np.frombuffer(zlib.decompress(raw) if r.packed else raw, r.dtype)
    rows = min(r.rows, r.height - k * r.rows)
    values = values[: rows * r.width * r.samples].reshape(rows, r.width, r.samples)[:, :, 0].astype(np.float64)
    return np.where(values == r.nodata, np.nan, values) if r.nodata is not None else values
