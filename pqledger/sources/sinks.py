"""Findings, bills and scores to files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines by all executors; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One indented UTF-8 array file, overwritten; rows stream through the driver one by one."""
    n = 0
    with Path(path).open("w", encoding="utf-8") as f:
        f.write("[")
        for r in df.select(F.to_json(F.struct("*"))).toLocalIterator():
            f.write(("," if n else "") + "\n  " + json.dumps(json.loads(r[0]), ensure_ascii=False, indent=2).replace("\n", "\n  "))
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def write_document(rows: DataFrame, folder: str) -> None:
    """The rows of a document to a folder, by all executors and in their order: its part files, read one behind the other, are
    the document. Spark's own commit protocol leaves only files of finished tasks."""
    rows.write.mode("overwrite").text(folder)


def join_document(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a document to one file, for readers that need one: the driver copies bytes and holds none of them."""
    jvm = spark._jvm
    conf, source, target = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for p in parts:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
