"""python -m pqledger.cli DIRECTORY [--container TAR] [-o FILE]: scan, report, and write findings, effort and, if asked, all results."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cbom, effort
from .plans import scan
from .sources import sinks, tar


def write_effort(found: DataFrame, path: str) -> dict:
    """The effort report as one JSON file; evidence and components stream through the driver row by row."""
    rated = effort.ratings(found)
    report = json.loads(effort.result(rated).select(F.to_json(F.struct("*"))).first()[0])
    for r in report["ratings"].values():
        r |= {"evidence": [], "affected_components": []}
    order = ["rating", "place", "ord"]
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(report, ensure_ascii=False, indent=2)[:-2] + ',\n  "evidence": [')
        for i, r in enumerate(effort.evidence(found, rated).orderBy(*order).toLocalIterator()):
            f.write(("," if i else "") + "\n    " + json.dumps({"rating": r.rating, "evidence": r.evidence, "file_path": r.file_path}, ensure_ascii=False))
        f.write('\n  ],\n  "component_ratings": [')
        for i, r in enumerate(effort.components(found, rated).orderBy("path").toLocalIterator()):
            ratings = {"CA": r.ca, "DS": r.ds, "NP": r.np}
            f.write(("," if i else "") + "\n    " + json.dumps({"component": r.component, "affected_files": [r.path], "ratings": ratings, "M_tech": r.m_tech}, ensure_ascii=False))
        f.write("\n  ]\n}\n")
    return report


def report_lines(found: DataFrame, most: int = 200) -> list[str]:
    """Findings of high confidence for the console, first ones first; at most so many lines, as a console is for reading."""
    sure = found.where("confidence >= 0.9").orderBy("ord").limit(most)
    out = []
    for r in sure.select("file_path", "line_number", "algorithm", "key_size", "code_snippet").collect():  # at most `most`
        place = f"{r.file_path}:{r.line_number}" if r.line_number else r.file_path
        out.append(f"    [{place}] {r.algorithm}" + (f" ({r.key_size}-bit)" if r.key_size else "") + (f"  <- {r.code_snippet}" if r.code_snippet else ""))
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pqledger")
    p.add_argument("directory", nargs="?")
    p.add_argument("--container", help="a tar archive of an image's file system")
    p.add_argument("-o", "--output", default="findings.json")
    p.add_argument("--mtech-output", help="file of the effort report (default: mtech_result.json beside the output)")
    p.add_argument("--results", help="folder for bill, document, scores and effort")
    p.add_argument("--password", help="variable of the environment that holds the password of PKCS#12 files")
    a = p.parse_args(argv)
    if not a.directory and not a.container:
        p.error("a directory or --container is needed")
    if a.directory and "://" not in a.directory and not os.path.isdir(a.directory):
        p.error(f"directory does not exist: {a.directory}")
    spark = SparkSession.builder.getOrCreate()
    secret = os.environ.get(a.password) if a.password else None
    print(f"Scanning {' and '.join(x for x in (a.directory, a.container) if x)} ...")
    found = scan.findings(spark, a.directory, secret) if a.directory else None
    if a.container:
        image = scan.container(tar.image_files(tar.read_tar(spark, a.container)))
        found = image if found is None else cbom.exact_dedup(found.unionByName(image))
    found = found.cache()
    n = sinks.write_json_array(found.orderBy("ord").drop("ord"), a.output)
    effort_path = a.mtech_output or os.path.join(os.path.dirname(a.output), "mtech_result.json")
    rated = write_effort(found, effort_path)
    print(f"  M_tech technical migration effort score: {rated['M_tech']} ({rated['architecture_classification']})\n  M_tech output written to {effort_path}")
    print(f"Scanned {' and '.join(x for x in (a.directory, a.container) if x)}: {n} artifacts detected.\nOutput written to {a.output}")
    print(f"  Confirmed (high-confidence) detections: {found.where('confidence >= 0.9').count()}")
    print("\n".join(report_lines(found)))
    if a.results:
        for name, df in scan.documents(found).items():
            sinks.write_document(df, f"{a.results}/{name}")
            sinks.join_document(spark, f"{a.results}/{name}", f"{a.results}/{name}.json")
        for name, df in scan.inventory(found).items():
            sinks.write_json(df, f"{a.results}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
