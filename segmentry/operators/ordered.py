"""Ordered operators that hold up when one source has a third of all rows.

A window partitioned by source alone would put a hot source into one task. Here each source's rows are cut into
buckets along the order; what a bucket needs from those before it is a small summary (a count, a sum, the last
row), combined before the shuffle and then scanned over the summaries alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(summary: DataFrame, by: list[str], bucket: str, value: Column) -> DataFrame:
    """Per bucket, an aggregate of the summaries of all buckets before it."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*by, bucket, value.over(w).alias("_before"))


def _keys(by: list[str], bucket: str, left: str, right: str) -> Column:
    out = F.lit(True)
    for c in [*by, bucket]:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _with(df: DataFrame, before: DataFrame, by: list[str], bucket: str) -> DataFrame:
    return df.alias("l").join(before.alias("r"), _keys(by, bucket, "l", "r"), "left").select("l.*", "r._before")


def running_sum(df: DataFrame, by: list[str], order: list[str], bucket: str, value: str, out: str, inclusive: bool = False) -> DataFrame:
    """df with the sum of `value` over the earlier rows of its source. `bucket` is a column that never falls along `order`."""
    before = _carried(df.groupBy(*by, bucket).agg(F.sum(value).alias("_s")), by, bucket, F.sum("_s"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return _with(df, before, by, bucket).withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_before")


def position(df: DataFrame, by: list[str], order: list[str], bucket: str, out: str) -> DataFrame:
    """df with each row's place in its source, from 0."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), by, order, bucket, "_one", out).drop("_one")


def neighbours(df: DataFrame, by: list[str], place: str, size: int, width: int) -> DataFrame:
    """df's rows for windows of `width` rows to either side: `_part` to partition by, `_own` whether the row belongs there.

    Rows near the edge of a part (of `size` places) also go, as context, to all parts that their windows reach.
    """
    part = F.floor(F.col(place) / size)
    near = F.sequence(F.floor((F.col(place) - width) / size), F.floor((F.col(place) + width) / size))
    return df.withColumn("_home", part).withColumn("_part", F.explode(near)).withColumn("_own", F.col("_part") == F.col("_home")).drop("_home")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], size: int, prefix: str = "", forward: bool = False, else_first: bool = False) -> DataFrame:
    """left with the columns `carry` of the last row of right at or before it (forward: the first at or after it), else null.

    With else_first, a row before all of right's gets the first of these (by `on`, then `carry`) instead of null.

    `on` is the order column of both sides; among rows of equal `on` the one with the largest `carry` counts (forward:
    the smallest). Buckets are ranges of `size` along `on`.
    """
    sign = -1 if forward else 1
    bucket = F.floor(F.col(on) / size) * sign
    pick = F.min if forward else F.max
    held = F.struct(F.col(on).alias("_on"), *(F.col(c) for c in carry))
    r = right.select(*by, bucket.alias("_bucket"), F.col(on).alias("_at"), held.alias("_held"))
    ends = r.groupBy(*by, "_bucket").agg(pick("_held").alias("_held"))
    none = F.lit(None).cast(r.schema["_held"].dataType)
    sides = left.select(*by, "_bucket").distinct() if "_bucket" in left.columns else left.select(*by, bucket.alias("_bucket")).distinct()
    before = _carried(ends.unionByName(sides.withColumn("_held", none)).groupBy(*by, "_bucket").agg(pick("_held").alias("_held")), by, "_bucket", F.last("_held", ignorenulls=True))
    l = left.withColumn("_bucket", bucket)
    both = l.select("*", F.col(on).alias("_at"), none.alias("_held")).unionByName(r.groupBy(*by, "_bucket", "_at").agg(pick("_held").alias("_held")).withColumn("_right", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_bucket").orderBy(F.col("_at") * sign, F.col("_right").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_in", F.last("_held", ignorenulls=True).over(w)).filter("_right IS NULL").drop("_held", "_right", "_at")
    got = _with(met, before, by, "_bucket").withColumn("_got", F.coalesce("_in", "_before"))
    if else_first:
        first = r.groupBy(*by).agg(F.min("_held").alias("_first"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        got = got.alias("l").join(first.alias("r"), same, "left").select("l.*", "r._first").withColumn("_got", F.coalesce("_got", "_first"))
    return got.select(*left.columns, *(F.col(f"_got.{c}").alias(f"{prefix}{c}") for c in carry))


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, size: int, out: str) -> DataFrame:
    """left with the value of right.on nearest to its own; of two as near, the smaller."""
    values = right.select(*by, on, F.col(on).alias("_v"))
    back = as_of(left, values, by, on, ["_v"], size, "back")
    both = as_of(back, values, by, on, ["_v"], size, "next", forward=True)
    closer = F.col("next_v").isNotNull() & (F.col("back_v").isNull() | (F.col("next_v") - F.col(on) < F.col(on) - F.col("back_v")))
    return both.withColumn(out, F.when(closer, F.col("next_v")).otherwise(F.col("back_v"))).drop("back_v", "next_v")


def within(left: DataFrame, right: DataFrame, by: list[str], on: str, low: int, high: int) -> DataFrame:
    """Range join: pairs with left.on + low <= right.on <= left.on + high, by equi-join on buckets of that width.

    The result has left's columns and right's, the latter (but for `by`) prefixed with r_.
    """
    size = max(1, high - low)
    spots = F.sequence(F.floor((F.col(on) + low) / size), F.floor((F.col(on) + high) / size))
    l = left.withColumn("_bucket", F.explode(spots))
    r = right.select(*by, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in by)).withColumn("_bucket", F.floor(F.col(f"r_{on}") / size))
    return l.join(r, [*by, "_bucket"]).filter((F.col(f"r_{on}") >= F.col(on) + low) & (F.col(f"r_{on}") <= F.col(on) + high)).drop("_bucket")
