"""Dedup, difference and merge: what their plans sort and send, and their results on odd rows."""

from pqledger.operators import cbom


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_findings(spark):
    rows = [("a", "x/../p.py", 1, "A", 3), ("b", "p.py", 1, "A", 2), ("c", None, 1, "A", 5), ("d", None, 1, "A", 4), ("e", "p.py", 2, "A", 1), ("f", "q.c", 1, None, 6), ("g", "q.c", 1, None, 7)]
    return cbom.conform(spark.createDataFrame(rows, "artifact_id string, file_path string, line_number int, algorithm string, ord int"))


def test_dedup_sends_each_value_once(spark):
    df = cbom.exact_dedup(some_findings(spark))
    assert {(r.artifact_id, r.file_path) for r in df.collect()} == {("b", "p.py"), ("d", None), ("e", "p.py"), ("f", "q.c")}
    assert df.columns == some_findings(spark).columns
    assert "_line_number" not in plan(df)
    written = cbom.exact_dedup(some_findings(spark).where("artifact_id = 'a'")).collect()
    assert [r.file_path for r in written] == ["x/../p.py"]


def test_difference_counts_both_sides_at_once(spark):
    a, b = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (3, "y")], "n int, s string"), spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (4, None)], "n int, s string")
    df = cbom.multiset_difference(a, b)
    assert sorted((r.side, r.n, r.s or "") for r in df.collect()) == [("left", 1, ""), ("left", 1, ""), ("left", 3, "y"), ("right", 2, "x"), ("right", 4, "")]
    assert plan(df).count("Union") == 1


def test_paths_are_counted_apart(spark):
    df = cbom.merge(cbom.classify(some_findings(spark))).select("algorithm", "n_files", "occurrence_count")
    assert {(r.algorithm, r.n_files, r.occurrence_count) for r in df.collect()} == {("A", 2, 5), (None, 1, 2)}
    assert not [line for line in plan(df).split("\n") if "min_by" in line and "distinct" in line]
