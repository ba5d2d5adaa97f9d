"""Yearly series: expansion of rules, filling, running totals, gaps and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_years(df: DataFrame, first: Column, last: Column, name: str = "year") -> DataFrame:
    """One row per year from first to last; none if the range is empty or open."""
    years = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    return df.withColumn(name, F.explode(years))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "cumulative") -> DataFrame:
    """Sum from the first row of a key to this one, row by row even among ties."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def densify(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """All years between a key's first and last one, missing values 0, with the running total."""
    yearly = df.groupBy(*keys, year).agg(F.sum(value).alias(value))
    spread = yearly.groupBy(*keys).agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    scaffold = expand_years(spread, F.col("_lo"), F.col("_hi"), year).drop("_lo", "_hi")
    full = scaffold.join(yearly, [*keys, year], "left").fillna(0.0, [value])
    return running_total(full, keys, [year], value)


def gaps(df: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Missing stretches between consecutive distinct points: gap_start, gap_stop."""
    points = df.select(*keys, point).distinct()
    following = F.lead(point).over(Window.partitionBy(*keys).orderBy(point))
    return points.withColumn("_next", following).where(F.col("_next") - F.col(point) > 1).select(*keys, (F.col(point) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_stop"))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Stretches of equal consecutive values: run, value, n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run", value).agg(F.count(F.lit(1)).alias("n"))


def timeline(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """All points of two series, side by side."""
    return left.join(right, on, "full_outer")


def lines(df: DataFrame, keys: list[str], y: str, tie: str, tolerance: float) -> DataFrame:
    """Adds line: values of y that lie within the tolerance of the one before share a line, as boxes of a page do."""
    w = Window.partitionBy(*keys).orderBy(y, tie)
    fresh = F.when(F.col(y) - F.lag(y).over(w) <= tolerance, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("line", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
