"""Hard-negative mining against brute force and SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pqledger.llm import negatives

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int, d int, q string, norm string"


def brute(rows, positives=5, k=10, low=30, high=90):
    ok = [(i, l, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, l in rows if x is not None and l is not None and all(c is not None and math.isfinite(c) for c in x)]
    ok = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, tuple(x)) for i, l, x in ok]
    out = []
    last = lambda i: (i is None, i or 0)
    for i, l, x in {r for r in ok if r[0] is not None and r[0] % 100 == 0}:
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), j, m) for j, m, y in ok if len(y) == len(x)]
        for ps, j, _ in sorted((s for s in scored if s[2] == l and s[1] != i), key=lambda s: (-s[0], last(s[1])))[:positives]:
            some = sorted((s for s in scored if s[2] != l and low * ps <= 100 * s[0] <= high * ps), key=lambda s: (-s[0], last(s[1])))[:k]
            out += [(i, j, n + 1, s[1], ps, s[0]) for n, s in enumerate(some)]
    return sorted(out, key=str)


def mine(spark, rows, **more):
    df = spark.createDataFrame([(i, x, l, 1, "q", "n") for i, x, l in rows], ROWS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mined(df, F.col("vec_id") % 100 == 0, label=label, **more)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cur = con.execute(negatives.ORACLE["op13_hard_negatives"])
    names = [d[0] for d in cur.description]
    got = negatives.op13_hard_negatives(spark, SF)
    assert sorted(got.columns) == sorted(names)
    want = sorted(cur.fetchall())
    assert want and sorted(map(tuple, got.select(*names).collect())) == want


def test_norms_that_differ(spark, monkeypatch):
    """Long and short vectors, small cells and products, so that buckets and chunks are left out."""
    for name, x in (("CELL_LEAST", 8), ("ANCHORS", 3), ("BLOCK", 2), ("CHUNK", 16), ("FIRST", 4)):
        monkeypatch.setattr(negatives, name, x)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 8)) * rng.choice([0.05, 0.3, 1, 4], (600, 1))
    rows = [(i, v.tolist(), int(l)) for i, v, l in zip(range(600), x, rng.integers(0, 4, 600), strict=True)]
    want = brute(rows)
    assert len(want) > 100 and mine(spark, rows) == want


def test_bound_leaves_cells_out(spark):
    """A wave whose anchors need no bucket makes nothing."""
    anchors = spark.createDataFrame([(1, 100, 1, 2, [3, 4], 5.0, [100], [200], [100])], "a long, vec_id long, label long, d int, q array<smallint>, norm double, low array<bigint>, high array<bigint>, least array<bigint>")
    table = spark.createDataFrame([(7, 9, 2, 2, [3, 4], 5.0, 0)], "a long, vec_id long, label long, d int, q array<smallint>, norm double, bucket int")
    stats = spark.createDataFrame([(2, 0, 5.0, 1)], "d int, bucket int, longest double, cells int")
    assert negatives.wave(table, anchors, stats, ["d"], 1, 10, False).count() == 0
    near = anchors.withColumns({"low": F.array(F.lit(20).cast("long")), "least": F.array(F.lit(20).cast("long"))})
    assert [tuple(r) for r in negatives.wave(table, near, stats, ["d"], 1, 10, False).collect()] == [(1, 0, 7, 9, 25)]


def test_anchors_with_fewer_positives(spark):
    rng = np.random.default_rng(3)
    label = lambda i: 9 if i in (100, 101, 103) else i % 4
    rows = [(i, rng.normal(0.4, 0.3, 6).tolist(), label(i)) for i in range(90, 320)]
    got = mine(spark, rows)
    assert got == brute(rows) and len({r[1] for r in got if r[0] == 100}) == 2


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [0.5, 0.5], 2), (200, None, 1), (300, [1.0, None], 1), (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (600, [1.0, 1.0], None)]
    rows += [(i, [0.9, i / 50], i % 3) for i in range(1, 40)] + [(None, [0.95, 0.1], 2), (None, [0.9, 0.1], 1), (5, [0.9, 0.1], 2), (5, [0.9, 0.1], 2), (700, [1.0, 2.0, 3.0], 1), (701, [1.0, 1.0, 1.0], 2), (702, [1.0, 1.0, 1.0], 2), (800, [], 1), (801, [], 1), (803, [], 2), (900, [-1.0, -1.0], 7)]
    assert mine(spark, rows) == brute(rows)
    assert mine(spark, []) == [] and mine(spark, [(100, [1.0], 1)]) == []


@pytest.mark.parametrize("size", [3e4, 1e6, 1e30])
def test_large_components(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 4) * (size if i % 3 else 1)).tolist(), i % 3) for i in range(90, 140)]
    got = mine(spark, rows)
    if size < 1e7:  # scores fit into 64 bits
        assert got and got == brute(rows)
    else:
        assert max(r[5] for r in got) <= (1 << 63) - 1
