"""Installed packages of an image's rpm database (the SQLite form, rpmdb.sqlite), read from the package headers in it.

A header is a count of index entries and a size of its data, both in network order, then the entries (tag, type, offset, count)
and the data that they point into. Names, versions and releases are texts that end with a zero byte.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from .commands import PACKAGES

# fixed values: tags of a header
NAME, VERSION, RELEASE = 1000, 1001, 1002
STRINGS = (6, 8, 9)


def texts(header: bytes, tags: tuple[int, ...] = (NAME, VERSION, RELEASE)) -> dict[int, str]:
    """The texts of a header's tags; ValueError for a header that is cut or points outside."""
    if len(header) < 8:
        raise ValueError("a header ends early")
    entries, size = struct.unpack_from(">II", header)
    start = 8 + 16 * entries
    if start + size > len(header):
        raise ValueError("a header ends early")
    data, out = header[start : start + size], {}
    for i in range(entries):
        tag, kind, offset, _ = struct.unpack_from(">IIiI", header, 8 + 16 * i)
        if tag in tags and kind in STRINGS:
            if not 0 <= offset < size:
                raise ValueError("an entry points outside")
            out[tag] = data[offset : data.index(b"\0", offset)].decode("utf-8", "replace")
    return out


def packages(raw: bytes) -> Iterator[tuple[str, str]]:
    """(name, version-release) of all packages of a database; damaged headers are left out."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(raw)
        for (header,) in db.execute("select blob from Packages order by hnum"):
            try:
                t = texts(header)
            except ValueError:
                continue
            if NAME in t:
                yield t[NAME], "-".join(x for x in (t.get(VERSION, ""), t.get(RELEASE, "")) if x)
    finally:
        db.close()


def database(path: str, raw: bytes) -> Iterator[dict]:
    """Known crypto packages that the database lists."""
    for name, version in packages(raw):
        if name.lower() in PACKAGES:
            library, sure = PACKAGES[name.lower()]
            yield {"artifact_type": "library", "library": library, "dependency_version": version or None, "confidence": sure, "evidence": f"rpm package: {name}", "source_type": "container_image", "detection_method": "package_metadata"}
