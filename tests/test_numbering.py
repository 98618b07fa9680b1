"""Positions by range partitions and prefix sums, against Python's sort."""

import pytest
from pyspark.sql import functions as F

from pqledger.operators.numbering import numbered, numbered_within
from pqledger.scratch import Scratch


@pytest.mark.parametrize("rows", [[], [(1, "a", 0)], [(i % 7, "hot" if i % 3 else f"g{i % 5}", i) for i in range(900)]])
def test_positions(spark, rows):
    df = spark.createDataFrame(rows, "x int, g string, i int")
    got = numbered(df, [F.desc("x"), F.asc("i")], Scratch(spark, "test")).collect()
    assert [(r.x, r.g, r.i) for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=lambda r: (-r[0], r[2]))
    assert sorted(r.position for r in got) == list(range(1, len(rows) + 1))
    within = numbered_within(df, ["g"], [F.asc("x"), F.asc("i")], Scratch(spark, "test")).collect()
    for g in {r[1] for r in rows}:
        some = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0], r[2]))
        assert [(r.x, r.i) for r in sorted((r for r in within if r.g == g), key=lambda r: r.position)] == [(r[0], r[2]) for r in some]
        assert sorted(r.position for r in within if r.g == g) == list(range(1, len(some) + 1))


def test_ties_get_different_positions(spark):
    got = numbered(spark.createDataFrame([(1,)] * 50 + [(None,)], "x int"), [F.asc_nulls_last("x")], Scratch(spark, "test")).collect()
    assert sorted(r.position for r in got) == list(range(1, 52)) and next(r.position for r in got if r.x is None) == 51
