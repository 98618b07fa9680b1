"""What a scan of Dockerfiles reads: one scan of the rows, and patterns only where a text holds what they need."""

from pyspark.sql import functions as F

from pqledger.operators import commands, rules
from pqledger.plans import generated, scan


def docker(spark, text):
    rows = rules.opened(spark.createDataFrame([(text,)], "text string"), commands.docker_hits(F.col("text"))).collect()
    return [(r.artifact_type, r.algorithm or r.library or r.protocol, r.evidence_type) for r in rows]


def test_a_scan_reads_and_sends_its_rows_once(spark):
    df = scan.detect(generated.tree(spark, "/root/testdata/sf0.001", "docker", "requirements"))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_names_are_sought_by_plain_parts(spark):
    df = spark.createDataFrame([("RSA",)], "text string").select(commands.names(F.col("text"), lambda m, name, pattern: rules.hit(algorithm=F.lit(name))).alias("h"))
    old = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    try:
        assert "(?=(" not in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", old)


def test_letters_that_fold_to_others_are_found(spark):
    assert docker(spark, "RUN pİp install bcrypt") == [("library", "bcrypt", "package_install")]
    assert docker(spark, "RUN openſſl genrsa 2048") == [("algorithm", "RSA", "openssl_command")]
    assert [x[0] for x in docker(spark, "RUN echo ſha-1 tlſ1.3 ßl1.2")] == ["algorithm", "protocol"]
    assert docker(spark, "RUN ſſh-Keygen") == [("protocol", "SSH", "ssh_evidence")]
    assert docker(spark, "CMD authorİzed_Keys") == [("protocol", "SSH", "ssh_evidence")]
