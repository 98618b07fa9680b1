"""Tar archives as a Spark data source: members are found by their headers and read by offset, in runs of bounded size.

    spark.dataSource.register(TarSource)
    spark.read.format("tar_members").option("path", "file:///images/a.tar").load()

The driver reads headers only (512 bytes for each member and what extended headers hold) and deals the members to runs of
about ``run_bytes``; each run is one partition, whose task opens the archive at its members' offsets. No archive and no run is
held whole, so archives of any size are read. A member of more than ``chunk_bytes`` comes as several rows, numbered by
``chunk``, as a value can't be larger than 2 GB; smaller ones are one row of chunk 0.

Rows: path (with a leading slash), length of the whole member, chunk, content. Only regular files are read; members whose
names are absolute or hold `..` are left out, as they point outside the archive. A name that comes again replaces the earlier
one, as when an archive is unpacked. GNU long names, pax paths and sizes, and sizes in base 256 are understood; a damaged
header ends the archive there with an error, unless ``lenient`` is set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

BLOCK = 512
SCHEMA = "path string, length long, chunk int, content binary"
RUN_BYTES, CHUNK_BYTES = 128 << 20, 256 << 20
#: Rows go to Spark in batches of about so many bytes.
BATCH_BYTES = 16 << 20


@dataclass
class Member:
    name: str
    offset: int  # of its content
    size: int
    regular: bool


def opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs.open_input_file(name)


def number(field: bytes) -> int:
    """A number of a header: octal digits, or base 256 if the first bit is set."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    text = field.split(b"\0")[0].strip()
    return int(text, 8) if text else 0


def extended(raw: bytes) -> dict[str, str]:
    """The records of a pax header: length, blank, key=value, line end."""
    out, at = {}, 0
    while at < len(raw) and raw[at : at + 1].isdigit():
        blank = raw.index(b" ", at)
        end = at + int(raw[at:blank])
        key, _, value = raw[blank + 1 : end - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at = end
    return out


def members(file, lenient: bool = False) -> Iterator[Member]:
    """All members of an archive, by their headers; contents are skipped."""
    size, at = file.size(), 0
    named: str | None = None
    pax: dict[str, str] = {}
    everywhere: dict[str, str] = {}
    while at + BLOCK <= size:
        head = file.read_at(BLOCK, at)
        at += BLOCK
        if head == b"\0" * BLOCK:
            return  # archives end with empty blocks
        try:
            if number(head[148:156]) != sum(head[:148]) + 8 * 32 + sum(head[156:]):
                raise ValueError("a header's sum is wrong")
            n, kind = number(head[124:136]), head[156:157]
        except ValueError:
            if lenient:
                return
            raise ValueError("a header's sum is wrong") from None
        if kind in (b"L", b"K", b"x", b"g"):
            raw = file.read_at(n, at)
            at += -(-n // BLOCK) * BLOCK
            if kind == b"L":
                named = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind == b"x":
                pax = extended(raw)
            elif kind == b"g":
                everywhere |= extended(raw)
            continue
        fields = everywhere | pax
        n = int(fields.get("size", n))
        text = lambda a, b: head[a:b].split(b"\0")[0].decode("utf-8", "replace")  # noqa: E731, B023
        prefix = text(345, 500) if head[257:262] == b"ustar" and head[257:265] != b"ustar  \0" else ""
        name = fields.get("path") or named or (f"{prefix}/" if prefix else "") + text(0, 100)
        yield Member(name, at, n, kind in (b"0", b"\0", b"7") and not name.endswith("/"))
        named, pax = None, {}
        at += -(-n // BLOCK) * BLOCK if kind in (b"0", b"\0", b"7") else 0


def inside(name: str) -> str | None:
    """A member's path with a leading slash; null if it points outside."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    return None if name.startswith("/") or ".." in parts or not parts else "/" + "/".join(parts)


@dataclass
class Run(InputPartition):
    """Members of one archive that one task reads: (path, offset, length, chunk, place in the member)."""

    archive: str
    parts: list[tuple[str, int, int, int, int]]


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.run_bytes, self.chunk_bytes = int(options.get("run_bytes", RUN_BYTES)), int(options.get("chunk_bytes", CHUNK_BYTES))
        self.lenient = str(options.get("lenient", "false")).lower() == "true"

    def partitions(self) -> list[Run]:
        out: list[Run] = []
        for archive in self.paths:
            latest: dict[str, Member] = {}
            with opened(archive) as f:
                for m in members(f, self.lenient):
                    path = inside(m.name)
                    if path is not None and m.regular:
                        latest.pop(path, None)
                        latest[path] = m
            run, held = [], 0
            for path, m in latest.items():
                for chunk, place in enumerate(range(0, max(1, m.size), self.chunk_bytes)):
                    n = min(self.chunk_bytes, m.size - place)
                    if run and held + n > self.run_bytes:
                        out.append(Run(archive, run))
                        run, held = [], 0
                    run.append((path, m.offset, m.size, chunk, place))
                    held += n
            if run:
                out.append(Run(archive, run))
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("path", pa.string()), ("length", pa.int64()), ("chunk", pa.int32()), ("content", pa.binary())])
        rows, held = [], 0
        if partition is None:  # no members at all
            return
        with opened(partition.archive) as f:
            for path, offset, length, chunk, place in partition.parts:
                raw = f.read_at(min(self.chunk_bytes, length - place), offset + place)
                rows.append({"path": path, "length": length, "chunk": chunk, "content": raw})
                held += len(raw)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, names)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(dict(self.options))


def read_tar(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """(path, length, chunk, content) of the members of archives on storage that all executors reach."""
    ship(spark).dataSource.register(TarSource)
    return spark.read.format("tar_members").options(path=",".join(paths), **options).load()


def image_files(members: DataFrame) -> DataFrame:
    """(path, length, content) as scans read files: what needs a whole file gets members of one chunk, and of longer ones
    the first chunk, by which they are still classified."""
    return members.where(F.col("chunk") == 0).select("path", "length", "content")
