"""Members of zip archives as rows, read by byte ranges.

A Python data source: the driver reads the archives' central directories only and plans partitions of neighbouring
members up to ``bytes`` of packed data; each task then reads its own ranges and checks every member against its
checksum. Archives lie in storage that ``pyarrow.fs`` opens. Nothing is unpacked to disk.

``spark.dataSource.register(ZipMembers)``, then ``spark.read.format("zipmembers").load("file:///a.zip")``. Options: ``path`` (an
archive, or a folder of ``*.zip``), ``bytes``, ``pattern`` (a regular expression that names must match from the start), ``names``
(a JSON list of names that are expected: those an archive lacks come as rows with the error ``missing``).

Defined cases: folders within an archive are no members; of names that occur twice both come; an encrypted member, a packing other
than stored or deflated, or one whose bytes don't fit its sizes or checksum comes with null content and an error; an archive that
can't be read at all is one row with an error and a null name.
"""

from __future__ import annotations

import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, size long, content binary, error string"
BYTES = 64 << 20
_HEAD = struct.Struct("<IHHHHHIIIHH")


class Members(InputPartition):
    """``(name, flags, packing, offset, packed, size, crc)`` of members of one archive, and names or an error to report."""

    def __init__(self, archive: str, members: list[tuple], missing: list[str] = (), error: str | None = None):
        super().__init__(archive)
        self.archive, self.members, self.missing, self.error = archive, members, list(missing), error


def _open(path: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, base


def unpack(source, packing: int, offset: int, packed: int, size: int, crc: int) -> bytes:
    """A member's bytes from its range; raises where they don't fit."""
    source.seek(offset)
    head = source.read(_HEAD.size)
    if len(head) < _HEAD.size:
        raise ValueError("truncated header")
    magic, *_, name, extra = _HEAD.unpack(head)
    if magic != 0x04034B50:
        raise ValueError("no member at its place")
    source.seek(offset + _HEAD.size + name + extra)
    raw = source.read(packed)
    if len(raw) < packed:
        raise ValueError("truncated")
    if packing == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif packing != zipfile.ZIP_STORED:
        raise ValueError(f"packing {packing} is not read")
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError("size or checksum differs")
    return raw


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("bytes", BYTES))
        self.pattern, self.names = options.get("pattern"), json.loads(options.get("names", "[]"))

    def archives(self) -> list[str]:
        from pyarrow import fs

        store, base = _open(self.path)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return [self.path]
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        return sorted(prefix + f.path for f in found if f.path.endswith(".zip"))

    def partitions(self) -> list[Members]:
        out, fits = [], re.compile(self.pattern).match if self.pattern else None
        for archive in self.archives():
            store, base = _open(archive)
            try:
                with store.open_input_file(base) as f, zipfile.ZipFile(f) as z:
                    every = [i for i in z.infolist() if not i.is_dir()]
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                out.append(Members(archive, [], error=f"{type(e).__name__}: {e}"))
                continue
            held, n, mine = [], 0, []
            for i in sorted(every, key=lambda i: i.header_offset):
                if fits and not fits(i.filename):
                    continue
                if held and n + i.compress_size > self.bytes:
                    mine.append(Members(archive, held))
                    held, n = [], 0
                held.append((i.filename, i.flag_bits, i.compress_type, i.header_offset, i.compress_size, i.file_size, i.CRC))
                n += i.compress_size
            there = {i.filename for i in every}
            missing = [x for x in self.names if x not in there]
            if held or missing:
                mine.append(Members(archive, held, missing))
            out += mine
        return out or [Members(self.path, [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.error:
            yield partition.archive, None, None, None, partition.error
        if partition.members:
            store, base = _open(partition.archive)
            with store.open_input_file(base) as source:
                for name, flags, packing, offset, packed, size, crc in partition.members:
                    try:
                        if flags & 1:
                            raise ValueError("encrypted")
                        yield partition.archive, name, size, unpack(source, packing, offset, packed, size, crc), None
                    except (ValueError, OSError, zlib.error) as e:
                        yield partition.archive, name, size, None, str(e)
        for name in partition.missing:
            yield partition.archive, name, None, None, "missing"


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)
