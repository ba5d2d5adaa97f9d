"""Cash-value tables from the text boxes that a scan gives: rows, header, columns, values, and a judgement of the result.

Boxes are rows (page, i, text, confidence, box), the box a polygon of points, the four numbers of a rectangle as one point
list each, or null. A page is the unit: its boxes become one array, over which greedy choices are folded, each value used once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of headers, forms of years, and limits of distances, scores and confidence.
YEAR_WORDS = ["保单年度", "保险年限", "保险年度", "年度", "保单年", "年份", "保单年度末"]
AGE_WORDS = ["年龄", "被保险年龄", "被保险人年龄"]
VALUE_WORDS = ["现金价值", "退保金", "账户价值", "领取"]
YEAR_AND_AGE_HEADER = r"年份\s*[/／]\s*年龄|年龄\s*[/／]\s*年份"
YEAR_AND_AGE = r"^(\d{4})\s*[/／]\s*(\d{1,3})$"
YEAR_END = r"^(?:第)?(\d{1,3})(?:个)?年(?:度)?(?:末|未|木|底)?$"
ROW_TOLERANCE, LEAST_ROWS, LEAST_CONFIDENCE, USUAL_CONFIDENCE = 15.0, 3, 0.7, 0.8
HEADER_GAP, HEADER_NEAR, HEADER_FAR, HEADER_SLOPE = 18.0, 60.0, 900.0, 90.0
USUAL_GAP, GAP_SHARE, LEAST_GAP, MOST_GAP = 55.0, 0.7, 28.0, 80.0
COLUMN_SCORE, LEFT_PENALTY = 260.0, 40.0

ITEM = "struct<i:int,text:string,y:double,x:double,middle:double,year:int,number:double,of_years:boolean,of_values:boolean>"
ROW = "struct<year:int,age:double,value:double>"
NONE = f"array<{ROW}>"


def let(value: Column, f) -> Column:
    """f(value), worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def worked_out(pages: DataFrame, /, **columns: Column) -> DataFrame:
    """Adds columns that later steps name many times.

    They pass through a generator of one row, over which the optimiser does not merge projections: otherwise every use
    gets its own copy of all steps below, and the plan grows with their product.
    """
    return pages.select(*pages.columns, F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def said(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def number(text: Column) -> Column:
    """The amount that a text says: `8,500`, `8500元`, `31:50` for 31.50."""
    t = F.regexp_replace(text, r"(?<=\d)[:：](?=\d{2}$)", ".")
    t = F.regexp_replace(t, r"[,，\s元¥￥]", "")
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), t).try_cast("double")


def policy_year(text: Column) -> Column:
    """A year from 1 to 150: a whole number, or `第3年末` and its misreadings."""
    t = F.regexp_replace(text, r"[｜|\s]", "")
    ended = F.nullif(F.regexp_extract(t, YEAR_END, 1), F.lit("")).try_cast("int")
    plain = F.when(~t.rlike("[.．]"), number(t))
    year = F.coalesce(ended, F.when(plain == F.floor(plain), plain).cast("int"))
    return F.when(t.rlike(YEAR_END), F.when(ended.between(1, 150), ended)).when(year.between(1, 150), year)


def page_items(boxes: DataFrame) -> DataFrame:
    """page, items, read (mean confidence of the reading): the boxes of a page in one array.

    Pages are small and cost much, so they are dealt over all shuffle partitions, which are not merged by their size.
    """
    boxes = boxes.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")
    flat = F.size(F.get("box", F.lit(0))) == 1
    ys = F.when(flat, F.array(F.get(F.get("box", F.lit(1)), F.lit(0)), F.get(F.get("box", F.lit(3)), F.lit(0)))).otherwise(F.transform("box", lambda p: F.get(p, F.lit(1))))
    xs = F.when(flat, F.array(F.get(F.get("box", F.lit(0)), F.lit(0)), F.get(F.get("box", F.lit(2)), F.lit(0)))).otherwise(F.transform("box", lambda p: F.get(p, F.lit(0))))
    placed = F.size("box") >= 4
    middle = lambda c: F.when(placed, (F.array_min(c) + F.array_max(c)) / 2)
    text = F.trim(F.coalesce("text", F.lit("")))
    item = F.struct(
        F.col("i").cast("int").alias("i"), text.alias("text"), middle(ys).alias("y"), F.coalesce(F.when(placed, F.array_min(xs)), F.lit(0.0)).alias("x"), F.coalesce(middle(xs), F.lit(0.0)).alias("middle"),
        policy_year(text).alias("year"), number(text).alias("number"), said(text, YEAR_WORDS).alias("of_years"), said(text, VALUE_WORDS).alias("of_values"),
    )
    shown = boxes.select("page", "confidence", item.cast(ITEM).alias("item"))
    return shown.groupBy("page").agg(F.sort_array(F.collect_list("item")).alias("items"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(USUAL_CONFIDENCE)).alias("read"))  # one page


def clustered(items: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """Rows of a page from the top, each from the left: a box joins the row while it is near the height that moves halfway to each box."""
    item, state = f"array<{ITEM}>", f"struct<done:array<array<{ITEM}>>,row:array<{ITEM}>,y:double>"
    by_height = F.transform(F.array_sort(F.transform(F.filter(items, lambda b: b["y"].isNotNull()), lambda b: F.struct(b["y"].alias("y"), b["i"].alias("i"), b.alias("b")))), lambda s: s["b"])

    def step(acc: Column, b: Column) -> Column:
        near = acc["y"].isNull() | (F.abs(b["y"] - acc["y"]) <= tolerance)
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["row"], F.array(b)).alias("row"), ((F.coalesce(acc["y"], b["y"]) + b["y"]) / 2).alias("y"))
        opened = F.struct(F.concat(acc["done"], F.array(acc["row"])).alias("done"), F.array(b).alias("row"), b["y"].alias("y"))
        return F.when(near, joined).otherwise(opened).cast(state)

    zero = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.array().cast(item).alias("row"), F.lit(None).cast("double").alias("y")).cast(state)
    rows = F.aggregate(by_height, zero, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["row"])), lambda r: F.size(r) > 0))
    from_left = F.transform(rows, lambda r: F.transform(F.array_sort(F.transform(r, lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["i"].alias("i"), b.alias("b")))), lambda s: s["b"]))
    return F.concat(from_left, F.transform(F.filter(items, lambda b: b["y"].isNull()), lambda b: F.array(b)))


def header(rows: Column) -> Column:
    """at, width, value_at, aged of the first row that names years and values, or years and ages together; null without one."""

    def judge(row: Column, at: Column) -> Column:
        line = F.array_join(F.transform(row, lambda b: b["text"]), " ")
        both = line.rlike(YEAR_AND_AGE_HEADER)
        aged = said(line, AGE_WORDS) & ~both
        found = both | (said(line, YEAR_WORDS) & said(line, VALUE_WORDS))
        return F.struct(at.alias("at"), F.when(both | aged, 3).otherwise(2).alias("width"), F.when(aged, 2).otherwise(1).alias("value_at"), aged.alias("aged"), found.alias("found"))

    return F.get(F.filter(F.transform(rows, judge), lambda h: h["found"]), F.lit(0))


def by_columns(rows: Column, head: Column) -> Column:
    """Rows (year, age, value) read from the left in groups as wide as the header says."""
    width = head["width"]

    def read(group: Column) -> Column:
        first, value = F.get(group, F.lit(0)), F.get(group, head["value_at"])["number"]
        both = first["text"].rlike(YEAR_AND_AGE)
        said_age = F.nullif(F.regexp_extract(first["text"], YEAR_AND_AGE, 2), F.lit("")).try_cast("double")
        year = F.when(both, F.nullif(F.regexp_extract(first["text"], YEAR_AND_AGE, 1), F.lit("")).try_cast("int")).otherwise(first["year"])
        return F.struct(year.alias("year"), F.when(both, said_age).when(head["aged"], F.get(group, F.lit(1))["number"]).alias("age"), value.alias("value")).cast(ROW)

    cut = lambda row: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(row) / width).cast("int"), F.lit(1)) - 1), lambda k: F.slice(row, k * width + 1, width))
    groups = F.filter(F.flatten(F.transform(F.slice(rows, head["at"] + 2, F.greatest(F.size(rows), F.lit(1))), cut)), lambda g: F.size(g) == width)
    return F.filter(F.transform(groups, read), lambda r: r["year"].isNotNull() & (r["value"] >= 0))


def _pairs(firsts: Column, seconds: Column, fits, score) -> Column:
    """Greedy pairs: each of the firsts, in order, takes the best of the seconds that fits and is not taken yet."""
    state = f"struct<pairs:array<struct<a:{ITEM},b:{ITEM}>>,taken:array<int>>"

    def step(acc: Column, a: Column) -> Column:
        free = F.filter(seconds, lambda b: ~F.array_contains(acc["taken"], b["i"]) & fits(a, b))
        best = F.array_min(F.transform(free, lambda b: F.struct(score(a, b).alias("score"), b["i"].alias("i"), b.alias("b"))))
        more = F.struct(F.concat(acc["pairs"], F.array(F.struct(a.alias("a"), best["b"].alias("b")))).alias("pairs"), F.concat(acc["taken"], F.array(best["i"])).alias("taken"))
        return F.when(best.isNull(), acc).otherwise(more.cast(state))

    zero = F.struct(F.array().alias("pairs"), F.array().alias("taken")).cast(state)
    return F.aggregate(firsts, zero, step, lambda acc: acc["pairs"])


def header_groups(items: Column) -> Column:
    """cx, top, value_x of the column groups, from the left: year headers with the nearest value header to their right."""
    placed = F.filter(items, lambda b: b["y"].isNotNull() & (b["text"] != ""))
    across, down = lambda a, b: b["middle"] - a["middle"], lambda a, b: F.abs(b["y"] - a["y"])
    pairs = _pairs(
        F.filter(placed, lambda b: b["of_years"]), F.filter(placed, lambda b: b["of_values"]),
        lambda a, b: (across(a, b) > 0) & across(a, b).between(HEADER_NEAR, HEADER_FAR) & (down(a, b) <= HEADER_SLOPE), lambda a, b: down(a, b) * 5 + across(a, b),
    )
    return F.array_sort(F.transform(pairs, lambda p: F.struct(((p["a"]["middle"] + p["b"]["middle"]) / 2).alias("cx"), F.least(p["a"]["y"], p["b"]["y"]).alias("top"), p["b"]["middle"].alias("value_x"))))


def by_header_groups(items: Column, groups: Column) -> Column:
    """Rows under two column groups or more: every year takes the nearest value to its right that is near in height."""
    every = F.filter(items, lambda b: b["y"].isNotNull() & (b["text"] != "") & ~b["of_years"] & ~b["of_values"])
    return F.when(F.size(groups) >= 2, let(every, lambda placed: _under_groups(placed, groups))).otherwise(F.array().cast(NONE))


def _under_groups(placed: Column, groups: Column) -> Column:
    def read(g: Column, k: Column) -> Column:
        left = F.when(k > 0, (F.get(groups, k - 1)["cx"] + g["cx"]) / 2).otherwise(F.lit(float("-inf")))
        right = F.coalesce((F.get(groups, k + 1)["cx"] + g["cx"]) / 2, F.lit(float("inf")))
        return let(F.struct(left.alias("left"), right.alias("right")), lambda e: let(F.filter(placed, lambda b: (b["middle"] >= e["left"]) & (b["middle"] < e["right"]) & (b["y"] > g["top"] + HEADER_GAP)), lambda own: under(own, g)))

    def tolerance(years: Column) -> Column:
        """How far a value may be from its year: by the median distance of the years."""
        heights = F.array_sort(F.transform(years, lambda b: b["y"]))
        gaps = let(heights, lambda h: F.array_sort(F.zip_with(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda b, a: b - a)))
        half = lambda g: F.floor(F.size(g) / 2).cast("int")
        median = let(gaps, lambda g: F.when(F.size(g) % 2 == 1, F.get(g, half(g))).when(F.size(g) > 0, (F.get(g, half(g) - 1) + F.get(g, half(g))) / 2))
        return F.greatest(F.lit(LEAST_GAP), F.least(F.lit(MOST_GAP), F.coalesce(F.nullif(median, F.lit(0.0)), F.lit(USUAL_GAP)) * GAP_SHARE))

    def under(own: Column, g: Column) -> Column:
        values = F.filter(own, lambda b: b["year"].isNull() & (b["number"] >= 0))
        fits = lambda near: lambda a, b: (b["middle"] > a["middle"]) & (F.abs(b["y"] - a["y"]) <= near)
        score = lambda a, b: F.abs(b["y"] - a["y"]) * 6 + F.abs(b["middle"] - g["value_x"])
        pairs = let(F.filter(own, lambda b: b["year"].isNotNull()), lambda years: let(values, lambda v: let(tolerance(years), lambda near: _pairs(years, v, fits(near), score))))
        return F.transform(pairs, lambda p: F.struct(p["a"]["year"].alias("year"), F.lit(None).cast("double").alias("age"), p["b"]["number"].alias("value")).cast(ROW))

    return F.flatten(F.transform(groups, read))


def in_sequence(items: Column) -> Column:
    """Rows of a year and the first number among the four texts after it, before any other year."""

    def read(b: Column, at: Column) -> Column:
        after = F.slice(items, at + 2, 4)
        stop = F.array_position(F.transform(after, lambda x: x["year"].isNotNull()), True)
        until = F.when(stop > 0, F.slice(after, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(after)
        return F.struct(b["year"].alias("year"), F.lit(None).cast("double").alias("age"), F.get(F.filter(until, lambda x: x["number"] >= 0), F.lit(0))["number"].alias("value")).cast(ROW)

    return F.filter(F.transform(items, read), lambda r: r["year"].isNotNull() & r["value"].isNotNull())


def in_columns(items: Column) -> Column:
    """Rows of a year and the number that is nearest in place, to the right by preference."""
    placed = F.filter(items, lambda b: b["y"].isNotNull() & (b["text"] != ""))
    values = F.filter(placed, lambda b: b["year"].isNull() & (b["number"] >= 0))

    def read(a: Column) -> Column:
        score = lambda b: F.abs(b["y"] - a["y"]) * 4 + F.abs(b["middle"] - a["middle"]) + F.when(b["middle"] >= a["middle"], 0.0).otherwise(LEFT_PENALTY)
        nearest = F.array_min(F.transform(values, lambda b: F.struct(score(b).alias("score"), b["i"].alias("i"), b["number"].alias("number"))))
        return let(nearest, lambda best: F.struct(a["year"].alias("year"), F.lit(None).cast("double").alias("age"), F.when(best["score"] < COLUMN_SCORE, best["number"]).alias("value")).cast(ROW))

    return F.filter(F.transform(F.filter(placed, lambda b: b["year"].isNotNull()), read), lambda r: r["value"].isNotNull())


def by_year(rows: Column) -> Column:
    """One row a year, with its greatest value, in order of years; of equal values the first."""

    def best(rows: Column) -> Column:
        numbered = F.transform(rows, lambda r, k: F.struct(r["year"].alias("year"), r["value"].alias("value"), (-k).alias("k"), r["age"].alias("age")))
        years = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["year"])))
        return let(numbered, lambda n: F.transform(years, lambda y: F.array_max(F.filter(n, lambda r: r["year"] == y))))

    return F.transform(let(rows, best), lambda r: F.struct(r["year"].alias("year"), r["age"].alias("age"), r["value"].alias("value")).cast(ROW))


def cash_value_tables(boxes: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """page, status (ok, failed, no table), width, confidence, rows (year, age, value) of every page of boxes.

    Rows come from the header's columns, from two column groups or more if these give as many, or, if there are too few,
    from the order of reading or the places alone. Fewer than three rows, values that only count the years, and a low
    confidence are a failure.
    """
    none = F.array().cast(NONE)
    pages = worked_out(page_items(boxes), lines=clustered(F.col("items"), tolerance))
    pages = worked_out(pages, head=header(F.col("lines")), groups=header_groups(F.col("items")), read_order=F.filter(F.flatten("lines"), lambda b: b["text"] != ""))
    known = F.col("head").isNotNull()
    columns = F.when(known, by_columns(F.col("lines"), F.col("head"))).otherwise(none)
    pages = worked_out(pages, columns=columns, grouped=F.when(F.size("groups") >= 2, by_year(by_header_groups(F.col("items"), F.col("groups")))).otherwise(none))
    few = F.size("columns") < LEAST_ROWS
    tries = [by_year(in_sequence(F.col("items"))), by_year(in_sequence(F.col("read_order"))), by_year(in_columns(F.col("items")))]
    pages = worked_out(pages, **{f"try{i}": F.when(few & (F.size("grouped") < LEAST_ROWS) & known, c).otherwise(none) for i, c in enumerate(tries)})
    longest = reduce(lambda a, i: F.when(F.size(f"try{i}") > F.size(a), F.col(f"try{i}")).otherwise(a), (1, 2), F.col("try0"))
    chosen = F.when((F.size("grouped") >= LEAST_ROWS) & (F.size("grouped") >= F.size("columns")), F.col("grouped")).when(few, longest).otherwise(F.col("columns"))
    pages = worked_out(pages, rows=F.when(known, by_year(chosen)).otherwise(none))
    return judged(pages)


def structured_value_tables(tables: DataFrame) -> DataFrame:
    """The same of tables that a parser has cut into cells: page, cells (rows of texts, the first ones the headings)."""
    cell = lambda t, i: F.struct(i.cast("int").alias("i"), F.trim(F.coalesce(t, F.lit(""))).alias("text"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("x"), F.lit(0.0).alias("middle"), policy_year(F.coalesce(t, F.lit(""))).alias("year"), number(F.coalesce(t, F.lit(""))).alias("number"), F.lit(False).alias("of_years"), F.lit(False).alias("of_values")).cast(ITEM)
    pages = worked_out(tables.select("page", "cells", F.lit(USUAL_CONFIDENCE).alias("read")), lines=F.transform("cells", lambda row: F.transform(row, cell)))
    pages = worked_out(pages, head=header(F.col("lines")))
    return judged(worked_out(pages, rows=F.when(F.col("head").isNotNull(), by_year(by_columns(F.col("lines"), F.col("head")))).otherwise(F.array().cast(NONE))))


def judged(pages: DataFrame) -> DataFrame:
    """page, status, width, confidence, rows of pages with rows, head and read (confidence of the reading)."""
    n = F.size("rows")
    counting = F.size(F.filter("rows", lambda r: (r["value"] == F.floor(r["value"])) & r["value"].between(1, 150) & (F.abs(r["value"] - r["year"]) <= 1)))
    ages = F.transform("rows", lambda r: r["age"])
    ordered = ~F.exists(F.zip_with(F.slice(ages, 2, F.greatest(n, F.lit(1))), F.slice(ages, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.coalesce(b < a, F.lit(False))), lambda x: x)
    confidence = F.when(n < LEAST_ROWS, 0.0).otherwise(F.col("read") * 0.4 + 0.3 + 0.3 * (0.5 + F.when(ordered, 0.3).otherwise(0.0) + F.when(n >= 5, 0.2).otherwise(0.1)))
    fine = (n >= LEAST_ROWS) & ~((n >= 5) & (counting / n >= 0.5)) & (confidence >= LEAST_CONFIDENCE)
    status = F.when(F.col("head").isNull(), "no table").when(fine, "ok").otherwise("failed")
    return pages.select("page", status.alias("status"), F.col("head.width").alias("width"), F.round(confidence, 2).alias("confidence"), "rows")
