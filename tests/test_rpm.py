"""Package headers of rpm databases, generated."""

import sqlite3
import struct

import pytest

from pqledger.operators import rpm
from pqledger.plans import scan


def header(name, version="1.0", release="2.el9", more=()):
    entries, data = [], b""
    for tag, text in ((1004, "summary"), (rpm.NAME, name), (rpm.VERSION, version), (rpm.RELEASE, release), *more):
        if text is not None:
            entries.append((tag, 6, len(data), 1))
            data += text.encode() + b"\0"
    entries.append((1009, 4, 0, 1))  # a number, not a text
    return struct.pack(">II", len(entries), len(data)) + b"".join(struct.pack(">IIiI", *e) for e in entries) + data


def database(tmp_path, blobs):
    path = tmp_path / "rpmdb.sqlite"
    db = sqlite3.connect(path)
    db.execute("create table Packages (hnum integer primary key autoincrement, blob blob not null)")
    db.executemany("insert into Packages (blob) values (?)", [(b,) for b in blobs])
    db.commit()
    db.close()
    return path.read_bytes()


def test_packages(tmp_path):
    bad = [b"", b"\0\0\0\1", header("cut")[:30], struct.pack(">II", 1, 4) + struct.pack(">IIiI", rpm.NAME, 6, 99, 1) + b"abc\0"]
    raw = database(tmp_path, [header("openssl", "3.0.7", "27.el9"), header("bash"), *bad, header("GnuTLS", "3.8", None), header("libsodium", None, None)])
    assert list(rpm.packages(raw)) == [("openssl", "3.0.7-27.el9"), ("bash", "1.0-2.el9"), ("GnuTLS", "3.8"), ("libsodium", "")]
    got = [(r["library"], r["dependency_version"], r["evidence"], r["confidence"]) for r in rpm.database("x", raw)]
    assert got == [("OpenSSL", "3.0.7-27.el9", "rpm package: openssl", 0.9), ("GnuTLS", "3.8", "rpm package: GnuTLS", 0.85), ("libsodium", None, "rpm package: libsodium", 0.9)]
    with pytest.raises(sqlite3.DatabaseError):
        list(rpm.packages(b"rubbish" * 1000))


def test_in_an_image(spark, tmp_path):
    raw = database(tmp_path, [header("openssl", "3.0.7", "27.el9")] * 2 + [header(f"p{i}") for i in range(300)])
    files = {"/var/lib/rpm/rpmdb.sqlite": raw, "/usr/lib/sysimage/rpm/rpmdb.sqlite": b"rubbish" * 100}
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files.items()], "path string, length long, content binary")
    got = [(r.file_path, r.artifact_type, r.library, r.detection_method, r.evidence) for r in scan.container(df).collect() if r.library]
    assert got == [("/var/lib/rpm/rpmdb.sqlite", "library", "OpenSSL", "package_metadata", "rpm package: openssl")] * 2
