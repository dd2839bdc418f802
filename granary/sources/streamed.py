"""Large sequence, feature and archive files as tables, read by workers in bounded memory.

Each format is a Spark data source whose partitions are files.  A worker reads a file in steps,
unpacks gzip as it goes (all members of a file), digests what it reads, and yields Arrow batches
of bounded size, so a file or a record of any length is never one value.  Files are opened
through Arrow's file systems: plain paths and ``file:`` URIs, and every store Arrow knows.

* ``sequence_chunks``: the symbols of each record in chunks, and a last row for each file with
  its size, compression and digests;
* ``text_lines``: numbered lines, up to a line that begins with a given mark;
* ``archive_members``: members of ZIP files with checksums that were verified by reading them.

A task that is tried again reads its file from the start and yields the same rows.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.plans.policy import CHUNK_LENGTH

#: Bytes read from a file, or unpacked from it, at once.
STEP = 1 << 20
#: Text of a batch, about.
BATCH = 4 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """Files at ``path`` or below it, hidden ones left out, in order of name."""
    store, place = _place(path)
    info = store.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(place, recursive=True))
    kept = [f.path for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    scheme = path[: path.index(":") + 1] + ("//" if "://" in path else "") if store.type_name != "local" else ""
    return sorted(scheme + f for f in kept)


class Source:
    """A file that is read once, in steps; ``sha256``, ``size`` and ``packed`` are complete when it has ended."""

    def __init__(self, path: str):
        store, place = _place(path)
        self.raw = store.open_input_stream(place, compression=None)  # bytes as they are, for the digest
        self.sha256, self.size, self.packed = hashlib.sha256(), 0, False

    def _steps(self) -> Iterator[bytes]:
        while step := self.raw.read(STEP):
            self.sha256.update(step)
            self.size += len(step)
            yield step

    def steps(self) -> Iterator[bytes]:
        """What the file holds, unpacked if it begins as gzip does; no step is much longer than ``STEP``."""
        unpacker, head = None, b""
        for step in self._steps():
            if head is not None:
                head += step
                if len(head) < 2 and head == b"\x1f":  # it takes one more byte to tell
                    continue
                self.packed, step, head = head[:2] == b"\x1f\x8b", head, None
            if not self.packed:
                yield step
                continue
            while step:
                if unpacker is None:
                    if not step.strip(b"\0"):  # padding after the last member
                        break
                    unpacker = zlib.decompressobj(31)
                yield unpacker.decompress(step, STEP)
                step = unpacker.unconsumed_tail
                if unpacker.eof:
                    step, unpacker = unpacker.unused_data, None
        if head:
            yield head
        if unpacker is not None:
            raise EOFError("compressed file ended before its end mark")

    def drain(self) -> None:
        """Reads on to the end, so that the digest covers the whole file."""
        for _ in self._steps():
            pass


def lines(steps: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(part of a line, whether the line ends with it) of steps of any cut; only a line's last part is short of ``STEP``."""
    rest = b""
    for step in steps:
        rest += step
        *whole, rest = rest.split(b"\n")
        for line in whole:
            yield line, True
        if len(rest) >= STEP:
            yield rest, False
            rest = b""
    if rest:
        yield rest, True


_CHUNK = "path string, kind string, record long, name string, header string, chunk long, start long, symbols string, size_bytes long, compression string, file_sha256 string, canonical_sha256 string, error string"
_CHUNK_SCHEMA = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in _CHUNK.split(", "))])


class _Batches:
    """Rows gathered to batches of about ``BATCH`` bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, size: int, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held >= BATCH:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def sequence_rows(path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows of a file's records, each of ``chunk`` symbols but a record's last one, and the file's own row."""
    source, out, canonical = Source(path), _Batches(_CHUNK_SCHEMA), hashlib.sha256()
    record, header, number, start, held, error = -1, b"", 0, 0, bytearray(), None

    def symbols(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number, start
        while len(held) >= chunk or end and (held or not number):  # a record without symbols is one empty chunk
            part = bytes(held[:chunk])
            del held[:chunk]
            words = header.split()
            yield from out.add(len(part), path, "chunk", record, (words[0] if words else b"").decode("utf-8", "replace"), header.decode("utf-8", "replace"), number, start, part.decode("latin-1"), None, None, None, None, None)
            number, start = number + 1, start + len(part)

    try:
        heading, fresh = False, True
        for part, ends in lines(source.steps()):
            if fresh and part.startswith(b">"):
                if record >= 0:
                    yield from symbols(True)
                record, number, start, header, heading = record + 1, 0, 0, b"", True
                canonical.update(b"\0")
                part = part[1:]
            if heading:
                header += part
                if ends:
                    header, heading = header.strip(), False
            elif body := b"".join(part.split()):
                if record < 0:
                    raise ValueError("sequence before first header")
                canonical.update(body.upper())
                held += body
                yield from symbols(False)
            fresh = ends
        if record < 0:
            raise ValueError("no header")
        yield from symbols(True)
    except (ValueError, OSError, EOFError, zlib.error) as e:
        error = str(e)
        source.drain()
    yield from out.add(0, path, "file", None, None, None, None, None, None, source.size, "gzip" if source.packed else "none", source.sha256.hexdigest(), None if error else canonical.hexdigest(), error)
    yield out.flush()


_LINE_SCHEMA = pa.schema([("path", pa.string()), ("line_number", pa.int64()), ("value", pa.string())])


def line_rows(path: str, stop: str) -> Iterator[pa.RecordBatch]:
    """(path, line_number from 0, value) of a text file, up to a line that begins with ``stop``; text is strict UTF-8."""
    out, number, held = _Batches(_LINE_SCHEMA), 0, b""
    for part, ends in lines(Source(path).steps()):
        held += part
        if not ends:
            continue
        if stop and held.startswith(stop.encode()):
            break
        text = held.decode("utf-8")
        yield from out.add(len(text), path, number, text)
        number, held = number + 1, b""
    yield out.flush()


_MEMBER = "path string, file_size_bytes long, file_sha256 string, entries long, member_name string, uncompressed_bytes long, compressed_bytes long, crc32_hex string, compression_method int, encrypted boolean, compression_ratio double, crc_verified boolean, error_type string, error_message string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_MEMBER_SCHEMA = pa.schema([(n, _TYPES[k]) for n, k in (x.split() for x in _MEMBER.split(", "))])


def member_rows(path: str, verify: bool) -> Iterator[pa.RecordBatch]:
    """A row for each file member of an archive; a file that is no archive is one row with an error."""
    source, out = Source(path), _Batches(_MEMBER_SCHEMA)
    source.drain()
    head = (path, source.size, source.sha256.hexdigest())
    store, place = _place(path)
    with store.open_input_file(place) as raw:
        try:
            archive = zipfile.ZipFile(raw)
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is shorter than an archive's end mark
            yield from out.add(0, *head, 0, *[None] * 8, "BadZipFile", "File is not a zip file")
            yield out.flush()
            return
        infos = sorted(archive.infolist(), key=lambda i: i.filename)
        for info in infos:
            if info.is_dir():
                continue
            sealed, fine, error = bool(info.flag_bits & 1), False, ("", "")
            if verify and not sealed:
                try:
                    with archive.open(info) as member:
                        while member.read(STEP):
                            pass
                    fine = True
                except (zipfile.BadZipFile, RuntimeError, EOFError, OSError, zlib.error) as e:
                    error = (type(e).__name__, str(e))
            ratio = round(info.file_size / max(info.compress_size, 1), 6)
            yield from out.add(len(info.filename), *head, len(infos), info.filename, info.file_size, info.compress_size, f"{info.CRC:08x}", info.compress_type, sealed, ratio, fine, *error)
    yield out.flush()


_TEXT_SCHEMA = pa.schema([("path", pa.string()), ("member_name", pa.string()), ("line_number", pa.int64()), ("value", pa.string())])


def member_line_rows(path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Lines from 1 of an archive's members whose name matches; .gz members are unpacked as they are read, text is strict UTF-8."""
    out = _Batches(_TEXT_SCHEMA)
    store, place = _place(path)
    with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
        for name in sorted(n for n in archive.namelist() if re.search(pattern, n)):
            with archive.open(name) as member:
                packed = member.peek(2)[:2] == b"\x1f\x8b"
                text = codecs.getreader("utf-8")(gzip.GzipFile(fileobj=member)) if packed else io.TextIOWrapper(member, "utf-8")
                for number, line in enumerate(text, 1):
                    line = line.rstrip("\r\n")
                    yield from out.add(len(line), path, name, number, line)
    yield out.flush()


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """Reads each file under ``path`` with ``rows``."""

    def __init__(self, path: str, rows, *more):
        self.path, self.rows, self.more = path, rows, more

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition.path, *self.more)


class SequenceChunks(DataSource):
    """``path``, and ``chunk`` symbols a row."""

    @classmethod
    def name(cls) -> str:
        return "sequence_chunks"

    def schema(self) -> str:
        return _CHUNK

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], sequence_rows, int(self.options.get("chunk", CHUNK_LENGTH)))


class TextLines(DataSource):
    """``path``, and ``stop``: how the line begins at which a file's rows end."""

    @classmethod
    def name(cls) -> str:
        return "text_lines"

    def schema(self) -> str:
        return "path string, line_number long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], line_rows, self.options.get("stop", ""))


class ArchiveMembers(DataSource):
    """``path``, and ``verify``: whether members are read to check their checksums."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return _MEMBER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], member_rows, self.options.get("verify", "true") == "true")


class ArchiveLines(DataSource):
    """``path``, and ``pattern``: a regex for names of members."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "path string, member_name string, line_number long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], member_line_rows, self.options["pattern"])


def read(spark: SparkSession, source: type[DataSource], path: str, **options: str) -> DataFrame:
    """The table of a data source of this module."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def sequence_chunks(spark: SparkSession, path: str, chunk: int = CHUNK_LENGTH) -> DataFrame:
    """(path, record, name, header, chunk, start, symbols) of all records; a file with an error is an error."""
    rows = read(spark, SequenceChunks, path, chunk=str(chunk))
    bad = F.raise_error(F.concat("path", F.lit(": "), "error")).cast("boolean")
    return rows.filter(F.when(F.col("error").isNotNull(), bad).otherwise(F.col("kind") == "chunk")).select("path", "record", "name", "header", "chunk", "start", "symbols")
