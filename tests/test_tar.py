"""Members of tar archives against the standard library, by offset, in runs and chunks."""

import io
import tarfile

import pytest

from pqledger.sources import tar


def archive(path, fmt):
    """Members of many kinds, and what a reader should give: path -> content."""
    want = {}
    with tarfile.open(path, "w", format=fmt) as t:

        def add(name, data=b"", kind=tarfile.REGTYPE, **more):
            i = tarfile.TarInfo(name)
            i.type, i.size = kind, len(data)
            for k, v in more.items():
                setattr(i, k, v)
            t.addfile(i, io.BytesIO(data))

        for name, data in {"etc/a.conf": b"TLSv1.2", "./etc/b.conf": b"", "big.bin": bytes(range(256)) * 20, "deep/" * 30 + "long name é.txt": b"x" * 513}.items():
            if fmt == tarfile.USTAR_FORMAT and len(name) > 100:
                name = "p/" * 60 + "n.txt"
            add(name, data)
            want["/" + name.removeprefix("./")] = data
        add("etc", kind=tarfile.DIRTYPE)
        add("link", kind=tarfile.SYMTYPE, linkname="etc/a.conf")
        add("hard", kind=tarfile.LNKTYPE, linkname="etc/a.conf")
        add("../evil", b"evil")
        add("/abs", b"evil")
        add("x/../../evil", b"evil")
        add("twice", b"first")
        add("twice", b"second")
        want["/twice"] = b"second"
    return want


@pytest.mark.parametrize("fmt", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_members(spark, tmp_path, fmt):
    want = archive(tmp_path / "a.tar", fmt)
    got = tar.read_tar(spark, str(tmp_path / "a.tar"), run_bytes=600, chunk_bytes=1000)
    assert got.rdd.getNumPartitions() > 3
    rows = sorted(got.collect(), key=lambda r: (r.path, r.chunk))
    assert {p: b"".join(bytes(r.content) for r in rows if r.path == p) for p in {r.path for r in rows}} == want
    assert all(r.length == len(want[r.path]) for r in rows) and max(len(r.content) for r in rows) <= 1000
    assert [r.chunk for r in rows if r.path == "/big.bin"] == list(range(6))
    whole = tar.image_files(tar.read_tar(spark, str(tmp_path / "a.tar"), f"file://{tmp_path}/a.tar"))
    assert whole.columns == ["path", "length", "content"] and whole.count() == 2 * len(want)


def test_archives_beyond_two_gigabytes(tmp_path):
    """A member of 9 GB (its size in base 256) and one behind it, in a file without blocks between."""
    size = 9 << 30
    big, last = tarfile.TarInfo("big"), tarfile.TarInfo("last.conf")
    big.size, last.size = size, 3
    with (tmp_path / "a.tar").open("wb") as f:
        f.write(big.tobuf(tarfile.GNU_FORMAT))
        f.seek(512 + size)
        f.write(last.tobuf(tarfile.GNU_FORMAT) + b"RSA" + b"\0" * 509 + b"\0" * 1024)
    reader = tar.TarReader({"path": str(tmp_path / "a.tar")})
    runs = reader.partitions()
    assert sum(1 for r in runs for p in r.parts if p[0] == "/big") == -(-size // tar.CHUNK_BYTES)
    assert max(sum(min(reader.chunk_bytes, p[2] - p[4]) for p in r.parts) for r in runs) <= tar.CHUNK_BYTES
    tail = tar.Run(str(tmp_path / "a.tar"), [p for p in runs[-1].parts if p[0] == "/last.conf"])
    assert [b.to_pylist() for b in reader.read(tail)] == [[{"path": "/last.conf", "length": 3, "chunk": 0, "content": b"RSA"}]]


def test_damaged_and_empty_archives(spark, tmp_path):
    archive(tmp_path / "a.tar", tarfile.PAX_FORMAT)
    raw = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(raw[:700])
    (tmp_path / "bad.tar").write_bytes(raw[:1024] + b"rubbish" * 200)
    (tmp_path / "none.tar").write_bytes(b"\0" * 1024)
    (tmp_path / "zero.tar").write_bytes(b"")
    for name in ("none.tar", "zero.tar"):
        assert tar.read_tar(spark, str(tmp_path / name)).count() == 0
    with pytest.raises(Exception, match="sum is wrong"):
        tar.read_tar(spark, str(tmp_path / "bad.tar")).count()
    assert tar.read_tar(spark, str(tmp_path / "bad.tar"), lenient=True).count() == 1
