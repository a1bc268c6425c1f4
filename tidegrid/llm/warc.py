"""Operator 5: legacy ARC archives converted to WARC, with payloads stored once.

Archives are files in a shared folder, written and read by tasks through ``pyarrow.fs`` (any store it knows by URI), record by record; they are written in
gzip members of one record each, and read packed or plain. A task names its files by a random mark, and only the names that successful tasks
return count, so a lost executor leaves at most unused files. Records are found by their declared lengths, never by
searching payloads for separators.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_dir, table

# The fields of a record's header line in each version of ARC.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: What a header line looks like: between url and content type stand an address and a date.
_LINES = {
    1: re.compile(r"(.+?) (\S+) ([0-9]{14}|[0-9]{12}) (.*) ([0-9]+)"),
    2: re.compile(r"(.+?) (\S+) ([0-9]{14}|[0-9]{12}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) ([0-9]+)"),
}
CRLF = b"\r\n"
FILE_BYTES, FILE_RECORDS = 16 << 20, 10_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of names that are URLs


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(ValueError):
    """An archive that can't be read on from a place."""


class _Members(io.RawIOBase):
    """The contents of a gzip file's members one after the other, or of a plain file as it is; what is read at once is all that is held."""

    def __init__(self, stream: BinaryIO, window: int = 1 << 14) -> None:
        self.stream, self.window = stream, window
        self.left = stream.read(window)
        self.packed = self.left[:2] == b"\x1f\x8b"
        self.member: zlib._Decompress | None = None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        size = len(into)
        while True:
            ended = not self.left and not (self.packed and self.member and self.member.unconsumed_tail)
            if ended:
                self.left = self.stream.read(self.window)
            if not self.packed:
                made, self.left = self.left[:size], self.left[size:]
                into[: len(made)] = made
                return len(made)
            if self.member is None:
                if not self.left:
                    return 0
                self.member = zlib.decompressobj(31)
            over = not self.left
            made = self.member.decompress(self.left, size)
            self.left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            elif over and not made:
                raise Broken("the archive ends within a member")
            if made:
                into[: len(made)] = made
                return len(made)


class Archive:
    """A file of records, read in order: lines and stretches of bytes, with the place in its (unpacked) contents. For bytes, or a stream of them."""

    def __init__(self, of: bytes | BinaryIO) -> None:
        self.buffer = io.BufferedReader(_Members(io.BytesIO(of) if isinstance(of, bytes) else of), 1 << 16)
        self.at = 0

    def _passed(self, read: Callable[[int], bytes], n: int) -> bytes:
        try:
            made = read(n)
        except zlib.error as e:
            raise Broken(f"a member can't be unpacked: {e}") from e
        self.at += len(made)
        return made

    def line(self, longest: int = 1 << 16) -> bytes:
        """Up to and with the next line end, empty at the end of the file; a line of more than ``longest`` bytes in pieces."""
        return self._passed(self.buffer.readline, longest)

    def take(self, n: int) -> bytes:
        made = self._passed(self.buffer.read, n)
        if len(made) != n:
            raise Broken("the archive ends within a record")
        return made


@contextlib.contextmanager
def _opened(uri: str) -> Iterator[Archive]:
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as f:
        yield Archive(f)


@contextlib.contextmanager
def _written(uri: str) -> Iterator[BinaryIO]:
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        yield f


def _read(uri: str) -> bytes:
    """All contents of a file, unpacked."""
    with _opened(uri) as archive:
        return archive.buffer.read()


def _write(uri: str, members: list[bytes]) -> None:
    with _written(uri) as f:
        f.write(b"".join(members))


def _word(text: str | None) -> str:
    """A url as one word of a header line."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "") or "-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(head).encode() + CRLF * 2 + payload


def http_head(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields of an HTTP block (names in lower case) and where its payload begins; a block of another kind is all payload."""
    end = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    if end is None:
        return {}, 0
    lines = re.split("\r?\n", block[: end.start()].decode("utf-8", "replace"))
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end.end()


def _page(fields: dict[str, str]) -> int | None:
    """The page_id that a header carries, if it carries one."""
    text = fields.get("x-page-id", "")
    return int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None


def arc_records(version: int, name: str, rows: list[tuple[int | None, str | None, bytes]]) -> Iterator[bytes]:
    """Records of an ARC file: the version block, then one for each (page_id, url, payload)."""
    about = f"{version} 0 tidegrid\n{' '.join(ARC_FIELDS[version])}\n".encode()
    date = datetime(2000, 1, 1)

    def line(url: str, when: str, kind: str, code: str, check: str, offset: int, size: int) -> bytes:
        extra = f" {code} {check} - {offset} {name}" if version == 2 else ""
        return f"{url} 0.0.0.0 {when} {kind}{extra} {size}\n".encode()

    first = line(f"filedesc://{name}", date.strftime("%Y%m%d%H%M%S"), "text/plain", "200", "-", 0, len(about)) + about + b"\n"
    yield first
    at = len(first)
    for page_id, url, payload in rows:
        block = http_block(page_id, payload)
        when = (date + timedelta(seconds=(page_id or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
        record = line(_word(url), when, "text/html", "200", hashlib.md5(payload).hexdigest(), at, len(block)) + block + b"\n"
        at += len(record)
        yield record


def parse_arc(archive: Archive | bytes, strict: bool = True) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record after the version block.

    The version block, whose header line has the fields of version 1 unless it declares more, says by the number at
    its beginning how the header lines of the others are read; each block is as long as its line declares. A url and a content
    type may hold spaces: the date, of 12 or 14 digits, tells them apart. Line ends between records may be missing or more than one.

    What can't be read is a :class:`Broken`, or, if not ``strict``, gives (offset, {"fault": reason}, b""): a stretch of lines that are no header lines, after which reading goes on at the next one that is;
    an archive that ends within a record or a member; one without a version block of a known version, of which nothing else is read."""
    archive = Archive(archive) if isinstance(archive, bytes) else archive
    fields, lost = None, None

    def fault(at: int, reason: str) -> tuple[int, dict[str, str], bytes]:
        if strict:
            raise Broken(reason)
        return at, {"fault": reason}, b""

    while True:
        at = archive.at
        try:
            raw = archive.line()
            if not raw:
                break
            if fields and not raw.strip(b"\r\n"):
                continue
            line = raw.decode("utf-8", "replace").rstrip("\r\n")
            names = fields or (ARC_FIELDS[2] if _LINES[2].fullmatch(line) else ARC_FIELDS[1])
            values = _LINES[1 if names == ARC_FIELDS[1] else 2].fullmatch(line) if raw.endswith(b"\n") else None
            if values is None:
                if lost is None:
                    lost = at
                    yield fault(at, f"not a header line with the {len(names)} fields that are declared: {line[:200]!r}")
                if fields is None:
                    break
                continue
            head = dict(zip(names, values.groups()))
            block = archive.take(int(head["Archive-length"]))
        except Broken as e:
            yield fault(at, str(e))
            break
        lost = None
        if fields is None:
            version = block.split(b" ", 1)[0]
            fields = ARC_FIELDS.get(int(version) if version.isdigit() and len(version) < 9 else -1)
            if fields is None:
                yield fault(at, f"ARC version {version[:20].decode('utf-8', 'replace')} is unknown")
                break
        else:
            yield at, head, block


def warc_record(kind: str, name: str, head: dict[str, str], block: bytes, digest: str, refers: tuple[str, dict[str, str]] | None) -> bytes:
    """The WARC record equivalent to an ARC record: a response with its block, or a revisit with its HTTP header only.

    What isn't HTTP (a name lookup, a file) is a resource of its own content type. A date that is none is that of the epoch."""
    try:
        date = datetime.strptime(head["Archive-date"].ljust(14, "0"), "%Y%m%d%H%M%S")
    except ValueError:
        date = datetime(1970, 1, 1)
    start = http_head(block)[1]
    if not start:
        kind = "resource"
    lines = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date.strftime("%Y-%m-%dT%H:%M:%SZ"), "WARC-Target-URI": head["URL"],
        "WARC-IP-Address": head["IP-address"], "Content-Type": "application/http; msgtype=response" if start else head["Content-type"],
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Bytes": str(len(block) - start),
    }
    if refers:
        block = block[:start]
        lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{refers[0]}>"} | refers[1]
    lines |= {"WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + CRLF + block + CRLF * 2


def parse_warc(archive: Archive | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    archive = Archive(archive) if isinstance(archive, bytes) else archive
    while first := archive.line():
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := archive.line()) != CRLF:
            if not line:
                raise Broken("the archive ends within a record")
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            head[name] = value
        block = archive.take(int(head["Content-Length"]))
        archive.take(4)
        yield head, block


def record_name(path: str, offset: int) -> str:
    """The identifier of a record: the same for a place in an archive whenever it is converted."""
    return str(uuid.uuid5(_SPACE, f"{path}#{offset}"))


def _to_arc(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = n_files = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size, n_files
            name = f"{uuid.uuid4().hex}.arc.gz"
            with _written(f"{folder}/{name}") as f:
                for r in arc_records(1 + n_files % 2, name, rows):
                    f.write(_gzip(r))
            n_files += 1
            out = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])
            rows, size = [], 0
            return out

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = (html.as_py() or "").encode()
                rows.append((page_id, url, payload))
                size += len(payload)
                if size >= FILE_BYTES or len(rows) >= FILE_RECORDS:
                    yield flush()
        if rows:
            yield flush()

    return run


_ROWS = 4096  # records that a task describes at once
_FOUND = {"path": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "http": pa.bool_(), "digest": pa.string(), "fault": pa.string()}
_BACK = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "warc_date": pa.string(), "target_uri": pa.string()}


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds.values())], list(kinds))


def _scan_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(path: str) -> Iterator[tuple]:
        with _opened(path) as archive:
            for offset, head, block in parse_arc(archive, strict=False):
                if "fault" in head:
                    yield path, offset, None, None, False, None, head["fault"]
                    continue
                fields, start = http_head(block)
                yield path, offset, _page(fields), len(block) - start, start > 0, hashlib.sha1(memoryview(block)[start:]).hexdigest(), None

    for batch in batches:
        for path in batch.column(0).to_pylist():
            yield from _batches(rows(path), _FOUND)


def _to_warc(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {x["offset"]: x for x in known}
                out = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                with _opened(path) as archive, _written(out) as f:
                    for offset, head, block in parse_arc(archive, strict=False):
                        if "fault" in head:
                            continue
                        k = known[offset]
                        refers = None
                        if k["of_path"] is not None:
                            refers = record_name(k["of_path"], k["of_offset"]), {} if k["of_page"] is None else {"X-Refers-To-Page-Id": str(k["of_page"])}
                        digest = base64.b32encode(bytes.fromhex(k["digest"])).decode()
                        f.write(_gzip(warc_record("revisit" if refers else "response", record_name(path, offset), head, block, digest, refers)))
                yield pa.RecordBatch.from_arrays([pa.array([out])], ["path"])

    return run


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(path: str) -> Iterator[tuple]:
        with _opened(path) as archive:
            for head, block in parse_warc(archive):
                fields, start = http_head(block)
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = int(head["X-Payload-Bytes"])
                if head["WARC-Type"] != "revisit" and (len(block) - start, hashlib.sha1(memoryview(block)[start:]).hexdigest()) != (size, digest):
                    raise ValueError(f"{path}: a payload differs from its digest")
                of = head.get("X-Refers-To-Page-Id")
                yield _page(fields), size, digest, head["WARC-Type"], None if of is None else int(of), head["WARC-Record-ID"], head["WARC-Date"], head["WARC-Target-URI"]

    for batch in batches:
        for path in batch.column(0).to_pylist():
            yield from _batches(rows(path), _BACK)


def _tasks(files: DataFrame) -> int:
    """Tasks for these files: one for each, up to a few for each core, and from there on sixteen files to a task."""
    n = files.count()
    return max(1, min(n, max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-n // 16))))


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(_tasks(files))


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Pages (page_id, url, html) as ARC files of versions 1 and 2 in turn; returns their paths."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(rows.mapInArrow(_to_arc(folder), "path string"), "arc-files")


def _scanned(files: DataFrame) -> DataFrame:
    return _dealt(files).mapInArrow(_scan_arc, "path string, offset long, page_id long, payload_bytes long, http boolean, digest string, fault string")


def broken_records(files: DataFrame) -> DataFrame:
    """path, offset, fault: what of the ARC files at ``path`` can't be read, from which place on (see :func:`parse_arc`)."""
    return _scanned(files).where("fault is not null").select("path", "offset", "fault")


def arc_to_warc(files: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """WARC files equivalent to the ARC files at ``path``; returns their paths.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id (then the last by
    file and place) is a response and the others are revisits that refer to it; a null page_id is smaller than any. Records that aren't
    HTTP are resources, each with its payload. What can't be read of a file is left out (:func:`broken_records` tells what), and stops nothing. Files may be gzip or plain, and of any size: one record
    is held at a time.
    """
    records = cut(_scanned(files).where("fault is null").drop("fault"), "arc-records")
    shared = F.col("http") & (F.col("payload_bytes") >= least)
    last = records.where(shared).groupBy("digest").agg(F.max(F.struct("page_id", "path", "offset")).alias("m"))
    last = cut(last.select("digest", F.col("m.page_id").alias("of_page"), F.col("m.path").alias("of_path"), F.col("m.offset").alias("of_offset")), "arc-last")
    big = records.where(shared).join(last, "digest")
    same = (F.col("path") == F.col("of_path")) & (F.col("offset") == F.col("of_offset"))
    big = big.select("path", "offset", "digest", *[F.when(~same, F.col(c)).alias(c) for c in ("of_page", "of_path", "of_offset")])
    small = records.where(~shared).select("path", "offset", "digest", F.lit(None).cast("long").alias("of_page"), F.lit(None).cast("string").alias("of_path"), F.lit(None).cast("long").alias("of_offset"))
    known = big.union(small).groupBy("path").agg(F.collect_list(F.struct("offset", "digest", "of_page", "of_path", "of_offset")).alias("known"))  # at most FILE_RECORDS of a file
    return cut(known.repartition(_tasks(files)).mapInArrow(_to_warc(folder), "path string"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """Records of the WARC files at ``path``: page_id, payload_bytes, payload_digest (lower-case hex SHA-1), record_type,
    refers_to, record_id, warc_date, target_uri. A payload that differs from its digest is an error."""
    return _dealt(files).mapInArrow(_read_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")


def convert(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) written as ARC, converted to WARC and read back: one row for each row of ``pages``.

    A null html is an empty payload, a null url is written as -, a null page_id stays null; repeated rows are records of
    their own; without pages there are no archives and no rows. Other columns are ignored."""
    folder = new_dir(pages.sparkSession, "archives")
    return read_warc(arc_to_warc(write_arc(pages, f"{folder}/arc"), f"{folder}/warc"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
