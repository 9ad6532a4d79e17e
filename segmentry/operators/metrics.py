"""Aggregates over per-scene rows: weighted totals, outcome counts, skip reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions.exact import rounded


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of value by weight over rows that have a value; null if their weight is 0."""
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0))


def with_total(
    rows: DataFrame, by: list[str], sums: list[str], means: list[str], weight: str, label: str = "total", digits: dict[str, tuple[int, int]] | None = None,
    within: list[str] | None = None, mean_digits: int | None = None,
) -> DataFrame:
    """Sums and weighted means by group and, with `label` in every column of `by`, over all rows: grouping sets over one scan.

    within: columns for each of whose values there are groups and a total, such as a source's. digits: for a column, the
    decimals to which its rows are rounded before they are summed, and to which the sum is; mean_digits: those of means.
    A null group is a group of its own beside the total; without rows there is still a total, of nulls (unless `within` something).
    """
    digits, within = digits or {}, within or []
    rows = rows.select(*within, *by, *(rounded(F.col(c), digits[c][0]).alias(c) if c in digits else F.col(c) for c in dict.fromkeys([*sums, *means, weight])), F.lit(False).alias("_none"))
    if not within:
        # a row of nothing, so that the total is there for an empty table
        none = rows.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "_none"), F.lit(True).alias("_none"))
        rows = rows.unionByName(none)
    total = {c: rounded(F.sum(c), digits[c][1]) if c in digits else F.sum(c) for c in sums}
    mean = {c: weighted_mean(c, weight) if mean_digits is None else rounded(weighted_mean(c, weight), mean_digits) for c in means}
    aggregates = [*(v.alias(c) for c, v in (total | mean).items()), F.grouping("_none").alias("_all")]
    outer, keys = [F.col(c) for c in within], [F.col(c) for c in [*within, *by, "_none"]]
    found = rows.groupingSets([keys, outer], *keys).agg(*aggregates).filter("_all = 1 OR NOT _none")
    return found.select(*within, *(F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(c).cast("string")).alias(c) for c in by), *sums, *means)


def skip_reasons(items: DataFrame, key: str, needed: DataFrame, done: DataFrame, missing: str = "missing", finished: str = "done") -> DataFrame:
    """items with `reason`: `missing` without a row in needed, else `finished` with one in done, else null."""
    n = needed.select(key).distinct().withColumn("_needed", F.lit(True))
    d = done.select(key).distinct().withColumn("_done", F.lit(True))
    reason = F.when(F.col("_needed").isNull(), F.lit(missing)).when(F.col("_done"), F.lit(finished))
    return items.join(n, key, "left").join(d, key, "left").withColumn("reason", reason).drop("_needed", "_done")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one of the two frames and not the other, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def whole_groups(rows: DataFrame, by: str, bad: Column) -> DataFrame:
    """The rows of groups (null is one) in which no row is bad: one bad part voids its source, and nothing else."""
    void = rows.filter(bad).select(F.col(by).alias("_void")).distinct()
    return rows.join(void, F.col(by).eqNullSafe(F.col("_void")), "left_anti")


def parallelism(rows: DataFrame, by: list[str], begin: str, end: str) -> DataFrame:
    """By group: busy (the sum of end - begin), wall (from the first begin to the last end), and busy / wall; null where no time has passed. Rows without both times don't count."""
    timed = rows.filter(F.col(begin).isNotNull() & F.col(end).isNotNull())
    sums = timed.groupBy(*by).agg(F.sum(F.col(end) - F.col(begin)).alias("busy"), (F.max(end) - F.min(begin)).alias("wall"))
    return sums.withColumn("ratio", F.col("busy") / F.nullif("wall", F.lit(0).cast(sums.schema["wall"].dataType)))
