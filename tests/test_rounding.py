"""Rounding equal to Python's."""

import random

import pytest

from pqledger.functions.rounding import exact_round
from pyspark.sql import functions as F


@pytest.mark.parametrize("digits", [0, 2, 4])
def test_same_as_python(spark, digits):
    r = random.Random(digits)
    ties = [k / 8 * 10.0**-d for k in range(-400, 400) for d in (0, 1, 2, 3)] + [2.675, 1.005, 0.325, 0.125, 0.375, 2.5, -0.5, 1e15 + 0.3, 4503599627370497.5, 1e22, 5e-324, 0.0, -0.0]
    half = [(k + 0.5) / 10**digits for k in range(-3000, 3000)]
    some = ties + half + [r.uniform(-1, 1) * 10.0 ** r.randrange(-8, 17) for _ in range(100_000)]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    for x, got in df.select("x", exact_round(F.col("x"), digits)).collect():
        assert got == round(x, digits), x


def test_odd_values(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(exact_round(F.col("x"), 2)).collect()]
    assert got[:3] == [None, float("inf"), float("-inf")] and got[3] != got[3]
