"""Measures over groups: scores, shares, targets, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import all_labels, half_up
from larkspur.operators.relations import best_per_key

RATE = 0.03


def present_value(amount: Column, years_ahead: Column, rate: float = RATE) -> Column:
    """Amount discounted over the years ahead, none for the past."""
    return amount / F.pow(F.lit(1 + rate), F.greatest(years_ahead, F.lit(0)))


def root_score(value: str, keys: list[str]) -> Column:
    """100 times the root of a value over the largest root of its group, rounded half up; 0 where that is 0."""
    top = F.max(F.sqrt(value)).over(Window.partitionBy(*keys))
    return F.when(top > 0, half_up(100 * F.sqrt(value) / top, 0)).otherwise(F.lit(0.0))


def target_gap(actual: Column, target: Column) -> dict[str, Column]:
    """rate, gap, surplus and score of a value against its target."""
    rate = F.when(target > 0, half_up(actual / target * 100, 2)).otherwise(F.lit(0.0))
    return {"rate": rate, "gap": F.greatest(target - actual, F.lit(0.0)), "surplus": F.greatest(actual - target, F.lit(0.0)), "score": F.least(rate, F.lit(100.0))}


def allocate(total: Column, weight: str, keys: list[str]) -> Column:
    """A share of the total by weight within a group; equal shares if the weights add up to 0."""
    w = Window.partitionBy(*keys)
    weights = F.sum(weight).over(w)
    return F.when(weights > 0, total * F.col(weight) / weights).otherwise(total / F.count(F.lit(1)).over(w))


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """dimension, value, n: counts of several columns from one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def with_fallback(named: Column, fit: Column, implied: Column, base: Column) -> Column:
    """What named rows that fit add up to; without any named row the base amount, where the text implies it; else 0."""
    return F.when(F.coalesce(named, F.lit(False)), F.coalesce(fit, F.lit(0.0))).when(implied, base).otherwise(0.0)


def payout_or_cash(payout: Column, cash: Column) -> tuple[Column, Column]:
    """What counts of a policy, payouts before cash value, and the cash value that is shown only."""
    return F.when(payout > 0, payout).otherwise(cash), F.when(payout > 0, cash).otherwise(0.0)


def column_statistics(df: DataFrame, histograms: dict[str, str], filled: list[str], keys: list[str]) -> DataFrame:
    """dimension, value, n: counts by value of some columns, filled cells of others, and repeats of keys."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in histograms.items()]))
    counts = df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    for c in filled:
        counts = counts.unionByName(df.agg(F.count(F.nullif(F.trim(c), F.lit(""))).alias("n")).select(F.lit("filled").alias("dimension"), F.lit(c).alias("value"), "n"))
    for c in keys:
        each = df.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        counts = counts.unionByName(each.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")).select(F.lit("repeated").alias("dimension"), F.lit(c).alias("value"), "n"))
    return counts


def histogram_with_samples(df: DataFrame, keys: list[str], order: list[str], sample: str, n: int) -> DataFrame:
    """keys, n, samples: counts, and the first n samples of each group as text. Only ranks up to n leave a task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = best_per_key(df, keys, [F.col(c) for c in order], n)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(sample).alias("_s")))), lambda x: x["_s"].cast("string")), ",")
    return counts.join(first.groupBy(*keys).agg(texts.alias("samples")), keys)


def suggestion_index(records: DataFrame) -> DataFrame:
    """company, product, records, codes, first_id, bucket from (company, product, code, id) rows."""
    codes = F.array_join(F.array_sort(F.collect_set("code")), ",")
    rows = records.groupBy("company", "product").agg(F.count(F.lit(1)).alias("records"), codes.alias("codes"), F.min("id").alias("first_id"))
    return rows.withColumn("bucket", F.substring(F.sha2(F.lower("company"), 256), 1, 4))


def shown_members(df: DataFrame, keys: list[str], value: str, tie: str, most: int = 4) -> DataFrame:
    """Adds shown: the highest but one of `most`, the lowest, and the next highest while there is room."""
    high = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))
    low = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumns({"_hi": high, "_lo": low, "_n": n})
    return ranked.withColumn("shown", (F.col("_hi") < most) | (F.col("_lo") == 1) | ((F.col("_hi") == most) & (F.col("_n") <= most))).drop("_hi", "_lo", "_n")


def filled_sample(df: DataFrame, stratum: str, quotas: dict, order: str, n: int) -> DataFrame:
    """n rows: the first of each stratum up to its quota, then the first of what is left, in order."""
    wanted = F.lit(0)
    for value, quota in quotas.items():
        wanted = F.when(F.col(stratum) == value, quota).otherwise(wanted)
    # ranks above what any stratum could fill are of no use, so at most n rows of each leave a task
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("_k") <= n)
    return ranked.withColumn("_first", F.col("_k") <= wanted).orderBy(F.desc("_first"), order).limit(n).drop("_k", "_first")


def state_hash(df: DataFrame, keys: list[str], order: str, content: Column) -> DataFrame:
    """keys, state: SHA-256 over a group's contents in order. A group is one state, held by one task."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), content.alias("c"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["c"]), "|"), 256).alias("state"))


def protection_matrix(rows: DataFrame, keys: list[str], definitions: list[tuple[str, str]], is_formula: Column) -> DataFrame:
    """keys, row_key, status, amount: every member by every row of a matrix.

    rows: keys, text, amount, inactive. A text counts in each row whose pattern it has. Statuses, the first that holds:
    covered (an active amount), formula (an active formula), inactive, missing.
    """
    labelled = rows.withColumn("row_key", F.explode(all_labels(F.col("text"), [(p, k) for k, p in definitions])))
    live = ~F.col("inactive")
    sums = labelled.groupBy(*keys, "row_key").agg(F.sum(F.when(live & ~is_formula, F.col("amount"))).alias("_sum"), F.max(live & is_formula).alias("_formula"), F.max("inactive").alias("_inactive"))
    grid = rows.select(*keys).distinct().withColumn("row_key", F.explode(F.array(*[F.lit(k) for k, _ in definitions])))
    status = F.when(F.col("_sum") > 0, "covered").when(F.col("_formula"), "formula").when(F.col("_inactive"), "inactive").otherwise("missing")
    return grid.join(sums, [*keys, "row_key"], "left").select(*keys, "row_key", status.alias("status"), F.round(F.coalesce("_sum", F.lit(0.0)), 2).alias("amount"))


def annual_payouts(entries: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """owner, year, amount, cumulative, age, liabilities, estimated: the entries of each owner and year in one row.

    entries: owner, year, age, amount, liability, estimated. Amounts add up, also over the years; the first age that is known
    counts, liabilities are listed once in order, and one estimated entry makes the year estimated.
    """
    seen = F.struct(*order, F.struct("age", "liability").alias("x"))
    year = entries.groupBy(owner, "year").agg(F.sum("amount").alias("amount"), F.bool_or(F.coalesce("estimated", F.lit(False))).alias("estimated"), F.array_sort(F.collect_list(seen)).alias("_e"))  # one owner's year
    told = year.select(
        owner, "year", "amount", F.sum("amount").over(Window.partitionBy(owner).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        F.get(F.array_compact(F.transform("_e", lambda e: e["x"]["age"])), F.lit(0)).alias("age"), F.array_join(F.array_distinct(F.array_compact(F.transform("_e", lambda e: e["x"]["liability"]))), "、").alias("liabilities"), "estimated",
    )
    return told
