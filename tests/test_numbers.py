"""Rounding and erfc in the JVM against Python."""

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamga.functions import stats


def numbers(spark, xs):
    return spark.createDataFrame(pa.table({"i": range(len(xs)), "x": pa.array(xs, pa.float64(), from_pandas=False)}))


def said(df, column):
    return df.select("i", column.alias("r")).orderBy("i").toArrow().column("r").to_numpy().tolist()


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 8])
def test_round_is_pythons(spark, digits):
    rnd = random.Random(digits)
    xs = [2.675, 66.665, 12.345, 1.115, 0.125, -0.125, 0.0, -0.0, -0.001, 1e15 + 0.5, 4.6e13 + 3 / 128, math.inf, -math.inf, 1e300, 5e-324, 4503599627370495.5, 9007199254740993.0]
    xs += [k / 1000 for k in range(100_000)] + [rnd.uniform(0, 100) for _ in range(100_000)] + [rnd.uniform(-1, 1) * 10 ** rnd.randint(-20, 18) for _ in range(100_000)]
    got = said(numbers(spark, xs), stats.py_round(F.col("x"), digits))
    wrong = [(x, g) for x, g in zip(xs, got) if struct.pack("d", g) != struct.pack("d", round(x, digits))]
    assert not wrong
    odd = numbers(spark, [math.nan, 1.5])
    assert math.isnan(said(odd, stats.py_round(F.col("x"), digits))[0])
    assert spark.range(1).select(stats.py_round(F.lit(None).cast("double"), digits)).first()[0] is None


def test_round_needs_few_digits():
    with pytest.raises(ValueError):
        stats.py_round(F.lit(1.0), 9)


def test_rounded_twice(spark):
    """A rounded number within a rounded expression stays small as a plan."""
    x = F.col("x")
    for _ in range(6):
        x = stats.py_round(x * 1.1, 2)
    want = 3.3
    for _ in range(6):
        want = round(want * 1.1, 2)
    assert said(numbers(spark, [3.3]), x) == [want]


def test_erfc(spark):
    rnd = random.Random(4)
    xs = [rnd.uniform(-6, 27) for _ in range(50_000)] + [0.0, 0.46875, 4.0, -3.9, 26.5, 27.2, 30.0, math.inf]
    got = said(numbers(spark, xs), stats.erfc(F.col("x")))
    assert max(abs(g - math.erfc(x)) / max(math.erfc(x), 1e-300) for x, g in zip(xs, got)) < 1e-14
