"""Dated series: as-of joins, returns, rolling extremes, bands, pairing of periods.

An as-of join is a union of both sides and one window over the key, so each side is read and shuffled once.
Defined results: rows without a date or key take no part; equal dates are broken by value; empty series give
empty results; divisions by zero give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, on: str, value: str, strict: bool = False) -> DataFrame:
    """Each left row with the latest right ``value`` whose date is not later (earlier, if strict)."""
    a = left.filter(F.col(on).isNotNull()).withColumns({"_side": F.lit(0 if strict else 1), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.filter(F.col(on).isNotNull() & F.col(value).isNotNull()).select(key, on, F.col(value).alias("_v")).withColumn("_side", F.lit(1 if strict else 0))
    w = Window.partitionBy(key).orderBy(on, "_side", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.filter(F.col("_side") == (0 if strict else 1)).drop("_side", "_v")


def floor_percentile(values: Column, p: float) -> Column:
    """Element ``int(p*(n-1))`` of the sorted values: the lower one, never interpolated."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.lit(p) * (F.size(s) - 1)) + 1).cast("int")))


def floor_percentiles(df: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """The same for groups of any size: ranks and a count instead of a collected list."""
    counted = df.filter(F.col(value).isNotNull())
    w = Window.partitionBy(key)
    ranked = counted.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(value)) - 1})
    return ranked.groupBy(key).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_i") == F.floor(F.lit(p) * (F.col("_n") - 1)), F.col(value))).alias(name) for name, p in ps.items()])


def returns(series: DataFrame, key: str, on: str, value: str, lags: dict[str, int]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(on)
    return series.select(key, on, value, *[F.round(F.try_divide(F.col(value), F.lag(value, n).over(w)) - 1, 6).alias(name) for name, n in lags.items()])


def rolling_high(series: DataFrame, key: str, on: str, value: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(on)
    return series.select(key, on, value, F.max(value).over(w.rowsBetween(-(n - 1), 0)).alias("high_n"), F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("high_ever"))


def year_ago_pairs(series: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """Each period with the one a year before, a month more or less: an equi-join on key and shifted month."""
    month = F.year(on) * 12 + F.month(on)
    now = series.select(key, on, value, F.explode(F.array(*[(month - 12 + k).cast("int") for k in (-1, 0, 1)])).alias("_m"))
    old = series.select(key, month.cast("int").alias("_m"), F.col(on).alias("ago_on"), F.col(value).alias("ago_value"))
    met = now.join(old, [key, "_m"]).withColumn("_d", F.abs(F.datediff(on, F.add_months("ago_on", 12))))
    return met.groupBy(key, on, value).agg(F.min(F.struct("_d", "ago_on", "ago_value")).alias("x")).select(key, on, value, F.col("x.ago_on").alias("ago_on"), F.col("x.ago_value").alias("ago_value"))


def trailing_sum(series: DataFrame, key: str, on: str, value: str, n: int) -> DataFrame:
    """Sum of the newest ``n`` periods of each key; null if fewer or any is null."""
    w = Window.partitionBy(key).orderBy(F.desc(on))
    top = series.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    return top.groupBy(key).agg(F.when((F.count(value) == n), F.sum(value)).alias("total"))
