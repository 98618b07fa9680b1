"""File trees and saved findings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cbom import ARTIFACT
from ..session import ship

#: Folders that a scan leaves out; fixed values.
IGNORED = [".git", "node_modules", "venv", ".venv", "__pycache__", "target", "build", "dist"]
# fixed values: what kinds of file a name means
MANIFESTS = ["requirements.txt", "pyproject.toml", "package.json", "package-lock.json", "pom.xml", "build.gradle", "build.gradle.kts", "cmakelists.txt", "conanfile.txt", "vcpkg.json"]
ENDS = {"binary": [".exe", ".dll", ".so", ".elf"], "source": [".py", ".java", ".js", ".jsx", ".ts", ".tsx", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"], "infrastructure": [".fw", ".hex", ".bin", ".cnf", ".conf", ".sql"], "certificate": [".crt", ".pem", ".cer", ".p12", ".pfx", ".der"], "python": [".py"], "java": [".java"], "javascript": [".js", ".jsx", ".ts", ".tsx"], "c": [".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"]}


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files below root that aren't in an ignored folder; content is read only if used."""
    df = ship(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^/*" + _quoted(base.lstrip("/")) + "/*", "")
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    return df.withColumn("path", F.regexp_replace("path", r"^file:/*", "/")).where(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED)))).select("path", "length", "content")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E" if s else ""


def base_name(path: str | Column = "path") -> Column:
    """What follows a path's last slash, in lower case."""
    return F.lower(F.substring_index(path, "/", -1))


def extension(name: Column) -> Column:
    """What follows a name's last dot; null without one. All ENDS are a dot and such an extension."""
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def is_routed() -> Column:
    """Whether any detector takes a file. A filter by it may be carried down to the rows that files are made of, so it is a
    plain comparison, which is compiled, and reads the name three times."""
    name = base_name()
    known = sorted({e.removeprefix(".") for some in ENDS.values() for e in some})
    return F.startswith(name, F.lit("dockerfile")) | name.isin(MANIFESTS) | extension(name).isin(known)


def with_routes(df: DataFrame) -> DataFrame:
    """Adds the array of detectors that a file goes to; a Dockerfile goes to one only."""
    name = F.col("_name")
    ends = lambda k: F.when(F.col("_end").isin([e.removeprefix(".") for e in ENDS[k]]), k)
    many = F.array_compact(F.array(F.when(name.isin(MANIFESTS), "manifest"), *[ends(k) for k in ENDS]))
    routes = F.when(F.startswith(name, F.lit("dockerfile")), F.array(F.lit("dockerfile"))).otherwise(many)
    return df.withColumn("_name", base_name()).withColumn("_end", extension(name)).withColumn("routes", routes).drop("_name", "_end")


def as_text(content: str | Column = "content") -> Column:
    """UTF-8 text without the bytes that aren't."""
    raw = (F.col(content) if isinstance(content, str) else content).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "\\x{FFFD}", ""))


def artifacts_json(spark: SparkSession, path: str) -> DataFrame:
    """A saved JSON array of findings, with ord from its order. The array is one document, so one task reads it."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<" + ARTIFACT.simpleString() + ">")).alias("ord", "r")).select("r.*", "ord")
