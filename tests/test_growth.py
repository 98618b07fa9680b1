"""Plans of the steps whose cost grew faster than their input, and their results on odd rows."""

import time

from pyspark.sql import functions as F

from pqledger.operators import commands, rules
from pqledger.plans import generated


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def config_names(spark, line):
    rows = rules.opened(spark.createDataFrame([(line,)], "text string"), commands.config_hits(F.col("text")))
    return [(r.artifact_type, r.algorithm, r.key_size, r.confidence) for r in rows.collect()]


def test_values_that_are_bound_in_each_other_plan_in_time(spark):
    """A type that is asked for twice at each level takes 2^24 steps."""

    def deeper(v, n):
        return rules.let(v + 1, lambda x: deeper(x, n - 1)) if n else v

    began = time.time()
    assert spark.range(1).select(deeper(F.col("id"), 24).alias("x")).collect()[0].x == 24
    assert time.time() - began < 60


def test_names_read_a_text_once_for_each_pattern(spark):
    df = spark.createDataFrame([("RSA",)], "text string").select(commands.names(F.col("text"), lambda m, name, pattern: rules.hit(algorithm=F.lit(name))).alias("h"))
    old, new = spark.conf.get("spark.sql.maxPlanStringLength"), "100000000"
    spark.conf.set("spark.sql.maxPlanStringLength", new)
    try:
        assert plan(df).count("regexp_replace") <= len(commands.NAMES)
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", old)


def test_names_by_priority_without_overlaps(spark):
    assert [x[1:3] for x in config_names(spark, "MD5 RSA-2048 rsa ChaCha20-Poly1305 chacha20 3DES triple-des DES aes_256_gcm sha1 SHA-512 ECDSA Ed25519")] == [
        ("ChaCha20-Poly1305", None), ("ChaCha20", None), ("RSA", 2048), ("RSA", None), ("ECDSA", None), ("Ed25519", None), ("AES-256-GCM", None), ("3DES", None), ("3DES", None), ("DES", None), ("SHA-512", None), ("SHA-1", None), ("MD5", None),
    ]
    assert [x[1] for x in config_names(spark, "ſha-1 RSADSA xAES # ECDSADSA")] == ["SHA-1"]  # the long s is an s where case is folded


def test_config_confidence(spark):
    assert config_names(spark, "; AES-128-CBC") == [("algorithm", "AES-128-CBC", None, 0.33 if round(0.325, 2) == 0.33 else 0.32)]
    assert config_names(spark, "worker 12") == []
    assert [x[3] for x in config_names(spark, "exec openssl x509 then openssl req, PermitRootLogin")] == [0.95, 0.75]


def test_statements_as_they_stand(spark):
    text = "\n# c\nRUN a \\\n# kept\n\n  b\nENV X=1  \nCMD [x] \\"
    rows = spark.createDataFrame([(text,)], "t string").select(commands.statements(F.col("t")).alias("s")).collect()[0].s
    assert [(r["at"], r["flat"]) for r in rows] == [(3, "RUN a # kept"), (6, "b"), (7, "ENV X=1"), (8, "CMD [x]")]


def test_files_meet_in_one_shuffle_without_a_window(spark):
    df = generated.files(spark, "/root/testdata/sf0.001", "config")
    assert "Window" not in plan(df)
    sql = generated.lines_sql("config").replace("{", "{{").replace("}", "}}").replace("from lineitem", "from {t}")
    lines = spark.sql(sql, t=spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")
    want = lines.groupBy("o").agg(text.alias("text")).select(F.concat(F.lit("etc/f"), F.col("o").cast("string"), F.lit(".conf")).alias("path"), "text")
    assert df.exceptAll(want).isEmpty() and want.exceptAll(df).isEmpty()


def test_routes_come_from_the_name_without_patterns(spark):
    """A filter on files is carried down to their lines; a pattern in it ran for each line and each known ending."""
    from pqledger.sources import files as src

    names = ["a/b.PY", ".py", "py", "x.tar.so", "d/Dockerfile.dev", "", "a.py/", "a.py\n", "g/build.gradle.kts", "A.H", "CMakeLists.txt", "x.conf.txt", None]
    df = spark.createDataFrame([(x,) for x in names], "path string")
    got = [tuple(r.routes) for r in src.with_routes(df).collect()]
    assert got == [("source", "python"), ("source", "python"), (), ("binary",), ("dockerfile",), (), (), (), ("manifest",), ("source", "c"), ("manifest",), (), ()]
    assert [r.path for r in df.where(src.is_routed()).collect()] == [n for n, r in zip(names, got, strict=True) if r]
    assert src.with_routes(df).columns == ["path", "routes"]
    made = plan(src.with_routes(df.where(src.is_routed())))
    assert "regexp" not in made and "exists(" not in made
