"""Bill and CycloneDX document as rows of text, against the nested ones."""

import json

import pytest
from pyspark.sql import functions as F

from pqledger.operators import cbom, document
from pqledger.plans import synthetic
from pqledger.sources import sinks


def found(spark, rows):
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, algorithm string, key_size int, file_path string, library string, line_number int, confidence double, code_snippet string, ord int")
    return cbom.classify(cbom.conform(df))


SOME = [
    ("a1", "algorithm", "RSA", 2048, 'b"\\}.py', None, 1, 0.5, 'x = "}{"\n', 3),
    ("a2", "algorithm", "RSA", 2048, "a.py", None, 2, 0.9, None, 7),
    ("a3", "algorithm", None, None, None, None, None, None, None, 2),
    ("a4", "hash", "MD5", None, "c.c", "}", 4, 0.4, "}", 5),
    ("a5", "import_signal", "UNSPECIFIED", None, "a.py", "lib", 1, 0.3, "é", 9),
    ("a6", "import_signal", "UNSPECIFIED", None, "d.py", "lib", 1, 0.3, None, 1),
    ("a7", "certificate", "UNSPECIFIED", None, "e.pem", None, 1, 0.3, None, 11),
]


def text(rows, tmp_path, spark):
    sinks.write_document(rows, str(tmp_path / "d"))
    sinks.join_document(spark, str(tmp_path / "d"), str(tmp_path / "one.json"))
    return json.loads((tmp_path / "one.json").read_text(encoding="utf-8"))


def plain(value):
    """Without null fields, as JSON leaves them out."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_same_as_nested(spark, tmp_path, n):
    rows = SOME[:n] if n <= 7 else [*SOME, *((f"h{i}", "algorithm", "AES", None, f"f{i % 50}.py", None, i, 0.5, f"s{i}", 100 + i) for i in range(n))]
    f = found(spark, rows)
    entries = cbom.ordered(cbom.attach_fixes(cbom.attach_recommendations(cbom.merge(f)))).drop("first_ord")
    want = [plain(json.loads(r[0])) for r in entries.select(F.to_json(F.struct("*"))).collect()]
    assert text(document.bill(f), tmp_path, spark) == want
    nested = json.loads(cbom.cyclonedx(cbom.attach_recommendations(cbom.merge(f))).first()[0])
    flat = text(document.cyclonedx(f), tmp_path, spark)
    assert flat["components"] == nested["components"] and len({c["bom-ref"] for c in flat["components"]}) == len(flat["components"])
    assert {k for k in flat} == {k for k in nested} and flat["specVersion"] == "1.6" and flat["metadata"]["tools"] == nested["metadata"]["tools"]


def test_no_entry_meets_in_one_value(spark):
    f = cbom.classify(synthetic.findings(spark, "/root/testdata/sf0.001"))
    for rows in (document.bill(f), document.cyclonedx(f)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan and "Window" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = document.bill(f).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.7 * sum(r["count"] for r in spread)
    whole = json.loads("".join(r[0] for r in document.bill(f).collect()))
    assert sum(e["occurrence_count"] for e in whole) == sum(len(e["occurrences"]) for e in whole) == f.count()
