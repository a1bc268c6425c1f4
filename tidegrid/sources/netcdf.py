"""NetCDF files of the classic formats (CDF-1, CDF-2 and CDF-5): their headers, and values by byte range.

A header tells where each variable begins; record variables come interleaved, one record of each after the other. So any stretch of a variable can be
read at its place, and what is to be written has a place that is known before.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np

# The external types by number, big-endian, and their fill values.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {1: -127, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 7: 255, 8: 65535, 9: 4294967295}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
_UNITS = {"seconds": 1, "second": 1, "s": 1, "minutes": 60, "minute": 60, "hours": 3600, "hour": 3600, "h": 3600, "days": 86400, "day": 86400, "d": 86400}


class Short(ValueError):
    """The header reaches over the bytes that were given."""


@dataclass(frozen=True)
class NcVariable:
    name: str
    dims: tuple[str, ...]
    kind: int
    attributes: dict[str, object]
    begin: int
    record: bool

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.kind])


@dataclass
class Header:
    """``dims``: lengths by name (of the record dimension the number of records); ``record_size``: bytes from one record to the next."""

    version: int
    dims: dict[str, int]
    attributes: dict[str, object]
    variables: dict[str, NcVariable]
    record_size: int = 0
    size: int = 0
    unlimited: str | None = None

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in self.variables[name].dims)

    def place(self, name: str, index: tuple[int, ...] = ()) -> int:
        """The byte at which the part of a variable begins that the first indices choose."""
        v, shape = self.variables[name], self.shape(name)
        inner = shape[1:] if v.record else shape
        own = index[1:] if v.record else index
        at, step = 0, v.dtype.itemsize * int(np.prod(inner))
        for i, n in zip(own, inner):
            step //= max(n, 1)
            at += i * step
        return v.begin + (index[0] * self.record_size if v.record and index else 0) + at


def _padded(n: int) -> int:
    return -n % 4


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.wide = raw, 0, False

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise Short(f"the header goes on after {len(self.raw)} bytes")
        self.at += n
        return self.raw[self.at - n : self.at]

    def int4(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else struct.unpack(">i", self.take(4))[0]

    def name(self) -> str:
        n = self.count()
        out = self.take(n).decode("utf-8")
        self.take(_padded(n))
        return out

    def values(self, kind: int) -> object:
        n = self.count()
        if kind not in TYPES:
            raise ValueError(f"the type {kind} is unknown")
        size = n * np.dtype(TYPES[kind]).itemsize
        raw = self.take(size)
        self.take(_padded(size))
        if kind == 2:
            return raw.decode("utf-8", "replace").rstrip("\0")
        x = np.frombuffer(raw, TYPES[kind])
        return x[0].item() if n == 1 else x.tolist()

    def listed(self, tag: int) -> int:
        found, n = self.int4(), self.count()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError(f"a list of the kind {found} where one of {tag} is due")
        return n

    def attributes(self) -> dict[str, object]:
        out = {}
        for _ in range(self.listed(ATTRIBUTE)):
            name = self.name()
            out[name] = self.values(self.int4())
        return out


def parse_header(raw: bytes) -> Header:
    """The header at the beginning of a file; a :class:`Short` if it goes on after ``raw``, another ValueError if it is none of the classic formats."""
    if raw[:3] != b"CDF" or len(raw) > 3 and raw[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF file of a classic format")
    r = _Reader(raw)
    version = r.take(4)[3]
    r.wide = version == 5
    records = r.count()
    names, lengths = [], []
    for _ in range(r.listed(DIMENSION)):
        names.append(r.name())
        lengths.append(r.count())
    unlimited = next((n for n, k in zip(names, lengths) if k == 0), None)
    attributes = r.attributes()
    variables, slices = {}, {}
    for _ in range(r.listed(VARIABLE)):
        name = r.name()
        dims = tuple(names[r.count()] for _ in range(r.count()))
        own = r.attributes()
        kind, _ = r.int4(), r.count()  # the size that the file states is that of one record, and may overflow: it is worked out
        if kind not in TYPES:
            raise ValueError(f"the type {kind} is unknown")
        begin = r.int4() if version == 1 else struct.unpack(">q", r.take(8))[0]
        record = bool(dims) and dims[0] == unlimited
        variables[name] = NcVariable(name, dims, kind, own, begin, record)
        if record:
            slices[name] = np.dtype(TYPES[kind]).itemsize * int(np.prod([lengths[names.index(d)] for d in dims[1:]]))
    sizes = [n if len(slices) == 1 else n + _padded(n) for n in slices.values()]
    out = Header(version, dict(zip(names, lengths)), attributes, variables, sum(sizes), r.at, unlimited)
    if unlimited is not None:
        out.dims[unlimited] = max(records, 0)
    return out


def read_header(read: Callable[[int, int], bytes]) -> Header:
    """The header of a file that ``read`` (place, length) gives bytes of: as many as it takes, twice as many each time. A file that was cut off is a ValueError."""
    n = 1 << 13
    while True:
        raw = read(0, n)
        try:
            return parse_header(raw)
        except Short as e:
            if len(raw) < n:
                raise ValueError("the file ends within its header") from e
            n *= 2


def unpacked(values: np.ndarray, v: NcVariable) -> np.ndarray:
    """Values as doubles: fill values and missing ones are NaN, scale and offset applied."""
    if v.kind == 2:
        raise ValueError(f"{v.name} holds characters, no numbers")
    x = values.astype(np.float64)
    missing = [v.attributes.get("_FillValue", FILLS.get(v.kind)), v.attributes.get("missing_value")]
    for m in missing:
        for one in m if isinstance(m, list) else [m]:
            if isinstance(one, (int, float)):
                x[values == np.asarray(one).astype(values.dtype)] = np.nan
    scale, offset = v.attributes.get("scale_factor", 1), v.attributes.get("add_offset", 0)
    return x * scale + offset if (scale, offset) != (1, 0) else x


def read_values(header: Header, name: str, read: Callable[[int, int], bytes], index: tuple[int, ...] = (), rows: tuple[int, int] | None = None) -> np.ndarray:
    """The part of a variable that the first indices choose, as doubles; of its next dimension only ``rows`` (from, to), if given. One range of bytes is read, or one for each record."""
    v, shape = header.variables[name], header.shape(name)
    if v.record and not index:
        a, b = rows or (0, shape[0])
        parts = [read_values(header, name, read, (i,)) for i in range(a, b)]
        return np.stack(parts) if parts else np.empty((0, *shape[1:]))
    rest = shape[len(index) :]
    at = header.place(name, index)
    if rows is not None:
        a, b = rows
        step = v.dtype.itemsize * int(np.prod(rest[1:]))
        at, rest = at + a * step, (b - a, *rest[1:])
    size = v.dtype.itemsize * int(np.prod(rest))
    raw = read(at, size)
    if len(raw) != size:
        raise ValueError(f"the file ends within {name}")
    return unpacked(np.frombuffer(raw, v.dtype), v).reshape(rest)


def times_of(values: np.ndarray, units: str) -> list[datetime]:
    """Times of numbers since a date, as ``units`` says; other units are a ValueError."""
    unit, _, since = units.partition(" since ")
    text = since.strip().removesuffix("UTC").strip().removesuffix("Z").replace("T", " ")
    if unit.strip().lower() not in _UNITS or not text:
        raise ValueError(f"the units of time {units!r} are unknown")
    day, _, clock = text.partition(" ")
    y, m, d = (int(p) for p in day.split("-"))
    h, mi, s = (float(p) for p in ([*clock.split(":"), 0, 0, 0][:3] if clock else (0, 0, 0)))
    start = datetime(y, m, d) + timedelta(hours=h, minutes=mi, seconds=s)
    return [start + timedelta(microseconds=round(float(x) * _UNITS[unit.strip().lower()] * 1e6)) for x in values]


@dataclass
class Layout:
    """A file to be written: ``head``, then ``first`` bytes of coordinates, then each variable at its place. No dimension is unlimited, so that a variable is one stretch."""

    dims: dict[str, int]
    attributes: dict[str, object] = field(default_factory=dict)
    variables: list[tuple[str, tuple[str, ...], int, dict[str, object]]] = field(default_factory=list)

    def size(self, dims: Sequence[str], kind: int) -> int:
        return np.dtype(TYPES[kind]).itemsize * int(np.prod([self.dims[d] for d in dims]))

    def header(self) -> tuple[bytes, dict[str, int]]:
        """The header in CDF-5 (which has no bounds), and the place of each variable."""
        def count(n: int) -> bytes:
            return struct.pack(">q", n)

        def text(s: str) -> bytes:
            raw = s.encode()
            return count(len(raw)) + raw + b"\0" * _padded(len(raw))

        def listed(tag: int, items: list[bytes]) -> bytes:
            return struct.pack(">i", tag if items else 0) + count(len(items)) + b"".join(items)

        def attribute(name: str, value: object) -> bytes:
            if isinstance(value, str):
                raw, kind, n = value.encode(), 2, len(value.encode())
            else:
                raw, kind, n = np.asarray(value, ">f8").tobytes(), 6, np.size(value)
            return text(name) + struct.pack(">i", kind) + count(n) + raw + b"\0" * _padded(len(raw))

        names = list(self.dims)

        def build(at: dict[str, int]) -> bytes:
            own = [
                text(n) + count(len(dims)) + b"".join(count(names.index(d)) for d in dims) + listed(ATTRIBUTE, [attribute(k, v) for k, v in attrs.items()])
                + struct.pack(">i", kind) + count(self.size(dims, kind) + _padded(self.size(dims, kind))) + struct.pack(">q", at.get(n, 0))
                for n, dims, kind, attrs in self.variables
            ]
            return b"CDF\x05" + count(0) + listed(DIMENSION, [text(d) + count(n) for d, n in self.dims.items()]) + listed(ATTRIBUTE, [attribute(k, v) for k, v in self.attributes.items()]) + listed(VARIABLE, own)

        at, places = len(build({})), {}
        for n, dims, kind, _ in self.variables:
            places[n] = at
            at += self.size(dims, kind) + _padded(self.size(dims, kind))
        return build(places), places
