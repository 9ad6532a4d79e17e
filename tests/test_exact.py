"""Rounding and fixed-point text against Python's, over more ties than any table has."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from segmentry.functions import exact, rules
from segmentry.operators import metrics


def doubles(n=45_008, seed=11):
    rng = random.Random(seed)
    out = [0.0, -0.0, 0.5, 0.125, 0.0625, 2.675, 1.005, 1e-300, -1e-300, 5e-324, 2.0**-60, 2.0**-61, 0.05, 0.045, 2.0**52 + 0.5, 2.0**53, 2.0**62, -(2.0**52) - 0.5, 1e15 + 0.3, 123456789012.345, 0.999995, 0.9999949999999, 9.9999999, 99999.999995]
    kinds = [
        lambda: rng.randrange(10**7) / 1000, lambda: rng.randrange(10**6) / 16, lambda: (2 * rng.randrange(10**6) + 1) / 2**rng.randrange(1, 20), lambda: rng.random(),
        lambda: round(rng.random() * 100, rng.randrange(2, 8)), lambda: (rng.randrange(10**6) + 0.5) / 10**rng.randrange(1, 7), lambda: rng.uniform(-1e9, 1e9), lambda: 2.0 ** rng.uniform(-70, 60),
        lambda: math.nextafter((rng.randrange(10**5) + 0.5) / 100, rng.choice([0, math.inf])), lambda: rng.randrange(10**12) / 24,
    ]
    while len(out) < n:
        x = rng.choice(kinds)()
        out.append(-x if rng.random() < 0.2 else x)
    return out


def bits(x):
    return struct.pack(">d", x)


def test_as_python_rounds_and_prints(spark):
    values = doubles()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").repartition(4)
    for digits in (1, 2, 3, 5, 9, 17):
        got = rows.select("i", exact.rounded(F.col("x"), digits).alias("r"), exact.fixed(F.col("x"), digits, 10).alias("t")).collect()
        assert sum(bits(r.r) != bits(round(values[r.i], digits)) for r in got) == 0, digits
        assert sum(r.t != f"{values[r.i]:10.{digits}f}" for r in got) == 0, digits


def test_values_that_are_no_numbers(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,), (1e300,), (-0.001,)], "x double")
    got = rows.select(exact.rounded(F.col("x"), 2).alias("r"), exact.fixed(F.col("x"), 2).alias("t")).collect()
    assert got[0].r is None and got[0].t is None and math.isnan(got[1].r) and [r.r for r in got[2:5]] == [math.inf, -math.inf, 1e300]
    assert [r.t for r in got[1:4]] == ["nan", "inf", "-inf"] and got[5].t == "-0.00" and bits(got[5].r) == bits(-0.0)
    with pytest.raises(ValueError):
        exact.rounded(F.col("x"), 18)


def test_scene_line_prints_ties_to_even(spark):
    line = spark.range(1).select(rules.scene_line(F.lit(3), F.lit(1), F.lit(3), 16.0).alias("v")).first().v
    assert line == f"scene {3:4d}  frames [{1:8d}, {3:8d})  {0.0625:10.3f}s .. {0.1875:10.3f}s"


def test_totals_in_one_scan(spark, tmp_path):
    spark.createDataFrame([(None, 10, 1.0), ("a", 30, 2.0), ("total", 5, None)], "scene string, frames long, q double").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    done = metrics.with_total(rows, ["scene"], ["frames"], ["q"], "frames")
    assert sorted(map(tuple, done.collect()), key=repr) == sorted([(None, 10, 1.0), ("a", 30, 2.0), ("total", 5, None), ("total", 45, 1.75)], key=repr)
    plan = metrics.with_total(rows, ["scene"], ["frames"], ["q"], "frames")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan
    empty = metrics.with_total(rows.limit(0), ["scene"], ["frames"], ["q"], "frames").collect()
    assert [tuple(r) for r in empty] == [("total", None, None)]
