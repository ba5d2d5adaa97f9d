"""Joins, dedupes and set operations between tables. Every function takes and returns DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.shared import written


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, which must leave no ties that matter."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def once_each(df: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """Adds columns that depend on a few others only, worked out once for each distinct set of these and joined back.

    The distinct sets are written, so their size is known: few are sent to all tasks, many are joined by shuffle.
    """
    each = df.select(*columns).distinct().select(*[F.col(c).alias(f"_of_{c}") for c in columns], *[v.alias(k) for k, v in made.items()])
    each = written(each, "distinct")
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(each[f"_of_{c}"]) for c in columns])
    return df.join(each, same, "left").select(*[df[c] for c in df.columns], *made)


def page_window(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of one page, with page (clamped to those there are), pages, first and last (their places from 1) and total."""
    total = df.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    start = (page - 1) * size
    told = {"page": page, "pages": pages, "first": min(start + 1, total), "last": min(start + size, total), "total": total}
    return df.orderBy(*order).offset(start).limit(size).withColumns({k: F.lit(v).cast("long") for k, v in told.items()})


def missing_from(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def present_in(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def valid_at(start: Column, stop: Column, day: Column, half_open: bool = False) -> Column:
    """Whether a day lies in an interval whose null ends are open; half_open leaves the last day out."""
    return (start.isNull() | (start <= day)) & (stop.isNull() | ((stop > day) if half_open else (stop >= day)))


def cascade_match(left: DataFrame, right: DataFrame, key: str, value: str, steps: list[tuple[str, str]]) -> DataFrame:
    """Match each left row by the first step (reason, shared column) that finds something.

    Result: key, value (of the only match), status (matched, ambiguous, unmatched), reason. Both sides hold
    the steps' columns; each step is one grouped equi-join, so no step compares rows pairwise.
    """
    out = left.select(key, *[c for _, c in steps])
    for i, (_, column) in enumerate(steps):
        found = right.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct(value).alias(f"_n{i}"), F.min(value).alias(f"_v{i}"))
        out = out.join(found, column, "left")
    count = F.coalesce(*[F.col(f"_n{i}") for i in range(len(steps))])
    pick = reduce(lambda a, i: a.when(F.col(f"_n{i}").isNotNull(), F.col(f"_v{i}")), range(1, len(steps)), F.when(F.col("_n0").isNotNull(), F.col("_v0")))
    why = reduce(lambda a, i: a.when(F.col(f"_n{i}").isNotNull(), steps[i][0]), range(1, len(steps)), F.when(F.col("_n0").isNotNull(), steps[0][0]))
    status = F.when(count.isNull(), "unmatched").when(count > 1, "ambiguous").otherwise("matched")
    return out.select(key, F.when(count == 1, pick).alias(value), status.alias("status"), why.alias("reason"))


def reconcile(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, action (create, update, delete, keep) that turns `current` into `incoming`; keys are unique."""
    a = current.select(F.col(key), F.xxhash64(*columns).alias("_a"), F.lit(True).alias("_in_a"))
    b = incoming.select(F.col(key), F.xxhash64(*columns).alias("_b"), F.lit(True).alias("_in_b"))
    action = F.when(F.col("_in_a").isNull(), "create").when(F.col("_in_b").isNull(), "delete").when(F.col("_a") == F.col("_b"), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the newest version of each key; a new row wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return best_per_key(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(missing_from(new, old, keys), allowMissingColumns=True)


def merge_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per column the new value unless it is blank, else the old one."""
    a, b = old.alias("a"), new.alias("b")
    columns = [c for c in old.columns if c != key]
    pick = [F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")) if dict(new.dtypes).get(c) == "string" else F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns]
    return a.join(b, key, "full_outer").select(F.col(key), *pick)


def interval_overlaps(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of a shared key whose closed ranges overlap."""
    cond = [left[k] == right[k] for k in on] + [left[left_range[0]] <= right[right_range[1]], right[right_range[0]] <= left[left_range[1]]]
    return left.join(right, cond)


def array_overlap(df: DataFrame, key: str, array: str, wanted: DataFrame, column: str) -> DataFrame:
    """Keys of rows whose array holds a wanted value: an exploded equi-join, so `wanted` may have any size."""
    return df.select(key, F.explode(array).alias(column)).join(wanted.select(column), column, "left_semi").select(key).distinct()


def blocked_pairs(left: DataFrame, right: DataFrame, blocks: list[str], score: Column, least: float) -> DataFrame:
    """Pairs that share all block columns and score at least `least`; score refers to columns of both sides."""
    return left.join(right, blocks).withColumn("score", score).where(F.col("score") >= least)


def latest_overrides(base: DataFrame, changes: DataFrame, key: str, order: list[Column], target: str, value: str) -> DataFrame:
    """Base rows whose target column is replaced by the latest change of their key, if it has one."""
    last = best_per_key(changes, [key], order).select(key, F.col(value).alias("_value"))
    return base.join(last, key, "left").withColumn(target, F.coalesce("_value", target)).drop("_value")


def same_members(a: DataFrame, b: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, same: whether both tables hold the same members of each key, repeats included. Nothing is collected."""
    sided = a.select(*keys, member, F.lit(1).alias("_n")).unionByName(b.select(*keys, member, F.lit(-1).alias("_n")))
    each = sided.groupBy(*keys, member).agg(F.sum("_n").alias("_n"))
    return each.groupBy(*keys).agg((F.max(F.abs("_n")) == 0).alias("same"))


def visible_union(sources: list[tuple[str, DataFrame, str, list[str], str | None]]) -> DataFrame:
    """source, name of the public rows of each source (name, table, name column, needed columns, condition).

    A source without a condition is not public; one that lacks a needed column is left out.
    """
    shown = [df.where(public).select(F.lit(name).alias("source"), F.col(column).alias("name")) for name, df, column, needed, public in sources if public is not None and {column, *needed} <= set(df.columns)]
    return reduce(lambda x, y: x.unionByName(y), shown)


def first_items(sources: list[DataFrame], key: str, item: str, order: list[str], n: int) -> DataFrame:
    """key, item, place: items of several sources, each once where it comes first, the first n of each key."""
    both = reduce(lambda x, y: x.unionByName(y), sources)
    once = best_per_key(both, [key, item], [F.col(c) for c in order])
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    return once.withColumn("place", place).where(F.col("place") <= n).select(key, item, "place")
