"""Cleaning of paged documents, with a log of edits from which the pages can be rebuilt.

Elements are rows (document, page, at, kind, text, position, top, bottom, height, headings): one piece of a page's layout in
its place, with the page's height and its declared headings repeated. Elements are dealt by document once. What spans pages
(repeated edges, running page numbers) is told there over sorted rows, what needs the order within a page is folded over the
page's own lines. Each text is written once: clean pages and log are both made from one row a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import let
from larkspur.sources.shared import written

# Control characters, odd spaces, and the forms of page numbers, list or clause openings and ends of sentences.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ODD_SPACES = "[\u00a0\u2000-\u200a\u202f\u205f\u3000]"
PAGE_NUMBER = r"^(?:第\s*)?(\d{1,5})\s*(?:页)?(?:\s*[/／]\s*\d{1,5})?$"
CLAUSE_OPENING = r"^(?:第[一二三四五六七八九十百千万\d]+[章节条款项]|[（(]?[一二三四五六七八九十\d]+[）).、．]|[-*•·])\s*"
SENTENCE_END = r"[。！？；：.!?;:]$"
EDGE_KINDS = ["header", "footer"]
NUMBER_KINDS = ["header", "footer", "page_number", "page-number", "pagenumber"]
EDGE_POSITIONS = ["top", "bottom", "header", "footer", "page_top", "page_bottom"]
HEADING_KINDS = ["heading", "title"]
#: Share of a page's height that counts as its edge, and the longest text of a running header.
EDGE_SHARE, LONGEST_EDGE = 0.08, 120

PAGE = ["document", "page"]


def normal(text: Column) -> Column:
    """Text without control characters, with single spaces, no blanks at the ends of lines, and one empty line at most."""
    # most texts are one line of plain characters and single spaces, which the patterns for others need not read
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    spaced = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, ODD_SPACES, " "))
    single = lambda t: F.when(F.contains(t, F.lit("\t")) | F.contains(t, F.lit("  ")), F.regexp_replace(t, "\t[\t ]*| [\t ]+", " ")).otherwise(t)
    by_line = lambda t: F.when(F.contains(t, F.lit("\n")), F.regexp_replace(F.regexp_replace(t, " ?\n ?", "\n"), "\n{3,}", "\n\n")).otherwise(t)
    return F.btrim(let(let(let(F.regexp_replace(plain, CONTROLS, ""), spaced), single), by_line), F.lit(" \n"))


def squeezed(normal_text: Column) -> Column:
    """A normal text in lower case, without white space."""
    return F.lower(F.replace(F.replace(normal_text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))


def bare(text: Column) -> Column:
    """What texts are compared by: the normal text in lower case, without white space."""
    return squeezed(normal(text))


def is_heading(line: Column, kind: Column, headings: Column) -> Column:
    return F.lower(F.coalesce(kind, F.lit(""))).isin(HEADING_KINDS) | line.rlike(CLAUSE_OPENING) | F.when(F.size(headings) > 0, F.array_contains(F.transform(headings, bare), bare(line))).otherwise(False)


def at_edge() -> Column:
    """An element whose position or box lies at the top or bottom of its page; without a height, boxes are shares of the page."""
    scale = F.when(F.col("height") > 0, F.col("height")).otherwise(F.when((F.col("top") >= 0) & (F.col("bottom") <= 1), 1.0))
    boxed = (F.col("top") <= scale * EDGE_SHARE) | (F.col("bottom") >= scale * (1 - EDGE_SHARE))
    return F.lower(F.coalesce("position", F.lit(""))).isin(EDGE_POSITIONS) | F.coalesce(boxed, F.lit(False))


def classified(elements: DataFrame) -> DataFrame:
    """Adds normal (text) and fate of each element: kept, number, edge or blank.

    A page number on its own goes if its kind or place says so, or if first or last elements of three pages or more count
    on with the pages. The first or last element of a page goes if two pages of the document have the same there.
    """
    kind = F.lower(F.coalesce("kind", F.lit("")))
    e = elements.repartition("document").withColumn("normal", normal(F.col("text")))
    whole = Window.partitionBy(*PAGE)
    e = e.withColumns({"_first": F.min("at").over(whole), "_last": F.max("at").over(whole), "_said": F.min(F.when(F.col("normal") != "", F.col("at"))).over(whole), "_said_last": F.max(F.when(F.col("normal") != "", F.col("at"))).over(whole)})
    number = F.nullif(F.regexp_extract("normal", PAGE_NUMBER, 1), F.lit("")).cast("long")
    slot = F.when(F.col("at") == F.col("_first"), "first").when(F.col("at") == F.col("_last"), "last")
    e = e.withColumns({"_number": number, "_slot": slot, "_edge": F.col("_slot").isNotNull() | kind.isin(EDGE_KINDS), "_heading": is_heading(F.col("normal"), F.col("kind"), F.col("headings")), })
    e = e.withColumn("_proven", F.col("_number").isNotNull() & (kind.isin(NUMBER_KINDS) | at_edge()))
    said_edge = F.coalesce((F.col("at") == F.col("_said")) | (F.col("at") == F.col("_said_last")), F.lit(False)) | kind.isin(EDGE_KINDS)
    e = e.withColumns({"_said_edge": said_edge, "_key": F.when(said_edge | F.col("_edge"), squeezed(F.col("normal")))}).drop("_first", "_last", "_said", "_said_last")
    # numbers that run on: their distance to the page is the same all over
    document, alike = Window.partitionBy("document"), Window.partitionBy("document", "_key")
    away = lambda slot: F.when(F.col("_number").isNotNull() & ~F.col("_proven") & (F.col("_slot") == slot), F.col("_number") - F.col("page"))
    run = lambda slot: F.when(F.col("_slot") == slot, (F.count(away(slot)).over(document) >= 3) & (F.min(away(slot)).over(document) == F.max(away(slot)).over(document)))
    e = e.withColumn("_runs", F.coalesce(run("first"), run("last"), F.lit(False)))
    seen = F.when(F.col("_said_edge") & (F.col("normal") != "") & (F.length("normal") <= LONGEST_EDGE) & ~F.col("_heading") & F.col("_number").isNull(), F.col("page"))
    e = e.withColumn("_repeats", F.coalesce(F.min(seen).over(alike) < F.max(seen).over(alike), F.lit(False)))  # on two pages or more
    fate = (
        F.when(F.col("normal") == "", "blank")
        .when(F.col("_number").isNotNull() & (F.col("_proven") | F.col("_runs")), "number")
        .when(F.col("_edge") & F.col("_repeats") & ~F.col("_heading"), "edge")
        .otherwise("kept")
    )
    return e.withColumn("fate", fate).select(*elements.columns, "normal", "fate")


LINE = "struct<text:string,kind:string,first:int,cuts:array<int>>"


def _merged(units: Column, headings: Column) -> Column:
    """Lines of a page, broken ones joined: number of the first unit, and the lengths at which the parts of a line but the last end."""

    def apart(line: Column, kind: Column) -> Column:
        return (F.lower(kind) == "table") | is_heading(line, kind, headings) | line.rlike(PAGE_NUMBER)

    def step(done: Column, unit: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(~apart(last["text"], last["kind"]) & ~apart(unit["text"], unit["kind"]) & ~F.right(last["text"], F.lit(3)).rlike(SENTENCE_END), F.lit(False))
        longer = F.struct(F.concat(last["text"], unit["text"]).alias("text"), last["kind"].alias("kind"), last["first"].alias("first"), F.concat(last["cuts"], F.array(F.length(last["text"]))).alias("cuts"))
        fresh = F.struct(unit["text"].alias("text"), unit["kind"].alias("kind"), unit["first"].alias("first"), F.array().cast("array<int>").alias("cuts"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer.cast(LINE)))).otherwise(F.concat(done, F.array(fresh.cast(LINE))))

    return F.aggregate(units, F.array().cast(f"array<{LINE}>"), step)


def cleaned_pages(elements: DataFrame, logged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages (document, page, cleaned, kept and left_out places, decision) and the log of edits.

    Log rows: document, page, step, rule, at (element; null for merges), line (of the cleaned page, for merges), before, after.
    Without `logged`, which writes what both are made from, the log works the cleaning out again for each step.
    Steps 1 to 4 are normalising, leaving out, splitting an element into lines, and merging lines, which runs in order of cut.
    """
    kind = F.coalesce("kind", F.lit(""))
    other = F.when(F.coalesce("text", F.lit("")) != F.col("normal"), F.coalesce("text", F.lit("")))
    found = classified(elements).groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("at", "normal", kind.alias("kind"), "fate", other.alias("raw")))).alias("_e"), F.any_value("headings").alias("headings")
    )  # one page
    said = lambda x: F.filter(F.split(x["normal"], "\n"), lambda y: y != "")
    kept = F.filter("_e", lambda x: x["fate"] == "kept")
    units = F.flatten(F.transform(kept, lambda x: F.transform(said(x), lambda y: F.struct(y.alias("text"), x["kind"].alias("kind")))))
    units = F.transform(units, lambda x, i: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), i.alias("first")))
    pages = found.select(*PAGE, F.transform(_merged(units, F.col("headings")), lambda x: F.struct(x["first"].alias("first"), x["cuts"].alias("cuts"))).alias("lines"), F.transform("_e", lambda x: x.dropFields("kind")).alias("elements"))
    if logged:
        pages = written(pages, "cleaned")
    places = lambda fates: F.transform(F.filter("elements", lambda x: x["fate"].isin(fates)), lambda x: x["at"])
    texts = F.flatten(F.transform(F.filter("elements", lambda x: x["fate"] == "kept"), said))
    lines = let(texts, lambda t: F.transform("lines", lambda x: F.struct(F.array_join(F.slice(t, x["first"] + 1, F.size(x["cuts"]) + 1), "").alias("text"), x["cuts"].alias("cuts"))))
    text = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
    clean = pages.select(*PAGE, text.alias("cleaned"), places(["kept"]).alias("kept"), places(["number", "edge"]).alias("left_out"))
    clean = clean.withColumn("decision", F.when((F.col("cleaned") != "") | (F.size("left_out") + F.size("kept") == 0), "pass").otherwise("review_required"))
    none = F.lit(None).cast("int")

    def log(df: DataFrame, step: int, rule: Column, at: Column, line: Column, before: Column, after: Column, cut: Column = none) -> DataFrame:
        return df.select(*PAGE, F.lit(step).alias("step"), rule.alias("rule"), at.alias("at"), line.alias("line"), cut.alias("cut"), before.alias("before"), after.alias("after"))

    each = pages.select(*PAGE, F.explode("elements").alias("x")).select(*PAGE, "x.*")
    at = F.col("at").cast("int")
    controls = F.when(F.col("raw").rlike(CONTROLS), "normalize_control_characters").otherwise("normalize_whitespace")
    left = F.when(F.col("fate") == "number", "exclude_page_number").otherwise("exclude_repeated_edge")
    split = F.filter(F.split("normal", "\n"), lambda x: x != "")
    joined = pages.select(*PAGE, F.posexplode(lines).alias("line", "x")).select(*PAGE, "line", "x.text", F.posexplode("x.cuts").alias("i", "cut"), "x.cuts")
    until = F.coalesce(F.get("cuts", F.col("i") + 1), F.length("text"))
    edits = (
        log(each.where("raw IS NOT NULL"), 1, controls, at, none, F.col("raw"), F.col("normal"))
        .unionByName(log(each.where(F.col("fate").isin("number", "edge")), 2, left, at, none, F.col("normal"), F.lit("")))
        .unionByName(log(each.where((F.col("fate") == "kept") & F.contains("normal", F.lit("\n"))), 3, F.lit("split_lines"), at, none, F.col("normal"), F.array_join(split, "\n")))
        .unionByName(log(joined, 4, F.lit("merge_broken_lines"), none, F.col("line"), F.concat(F.substring("text", F.lit(1), F.col("cut")), F.lit("\n"), F.substring("text", F.col("cut") + 1, until - F.col("cut"))), F.substring("text", F.lit(1), until), F.col("cut")))
    )
    return clean, edits.withColumns({"before_hash": F.sha2("before", 256), "after_hash": F.sha2("after", 256)})


def restored_elements(clean: DataFrame, log: DataFrame) -> DataFrame:
    """document, page, at, text of every element that was not blank from the start, from the cleaned pages and their log alone."""
    of_step = lambda on, *fields: F.sort_array(F.collect_list(F.when(on, F.struct(*fields))))
    step = F.col("step")
    times = F.when(step == 3, F.size(F.split("after", "\n"))).alias("times")
    edits = log.select(*PAGE, "step", "at", "line", "cut", F.when(step < 4, F.col("before")).alias("text"), times).groupBy(*PAGE)
    edits = edits.agg(of_step(step < 4, "at", "step", "text").alias("told"), of_step(step == 4, "line", F.col("cut").alias("from")).alias("cuts"), of_step(step == 3, "at", "times").alias("split"))  # one page
    place, start, row = "struct<at:int,times:int>", "struct<line:int,from:int>", "struct<at:int,step:int,text:string>"
    all_of = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>"))
    pages = clean.select(*PAGE, "cleaned", "kept").join(edits, PAGE, "full")
    pages = pages.select(
        *PAGE, F.when(F.col("cleaned") != "", F.split("cleaned", "\n")).otherwise(F.array().cast("array<string>")).alias("lines"), all_of("told", row).alias("told"), all_of("cuts", start).alias("cuts"),
        all_of("split", place).alias("split"), F.array_sort(F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda x: x.cast("int"))).alias("kept"),
    )
    starts = F.array_sort(F.concat(F.transform("lines", lambda x, i: F.struct(i.alias("line"), F.lit(0).alias("from")).cast(start)), F.col("cuts").cast(f"array<{start}>")))
    line = lambda a: F.get("lines", a["line"])
    until = lambda a, b: F.when(b["line"] == a["line"], b["from"]).otherwise(F.length(line(a)))
    parts = let(starts, lambda s: F.transform(s, lambda a, i: F.substring(line(a), a["from"] + 1, until(a, F.get(s, i + 1)) - a["from"])))
    # an element that was split has as many parts as it had lines
    whole = lambda p: F.transform(F.slice("kept", 1, F.size(p)), lambda at, i: F.struct(at.alias("at"), F.get(p, i).alias("text")))
    many = lambda at: F.coalesce(F.get(F.filter("split", lambda x: x["at"] == at), F.lit(0))["times"], F.lit(1))
    places = F.flatten(F.transform("kept", lambda at: F.array_repeat(at, many(at))))
    in_parts = lambda p: let(F.transform(places, lambda at, i: F.struct(at.alias("at"), F.get(p, i).alias("text"))), lambda x: F.transform("kept", lambda at: F.struct(at.alias("at"), F.array_join(F.transform(F.filter(x, lambda y: y["at"] == at), lambda y: y["text"]), "\n").alias("text"))))
    shown = let(parts, lambda p: F.when(F.size("split") == 0, whole(p)).otherwise(in_parts(p)))
    # what an edit replaced is what stood there before the first one
    found = F.array_sort(F.concat(F.col("told").cast(f"array<{row}>"), F.transform(shown, lambda x: F.struct(x["at"].alias("at"), F.lit(9).alias("step"), x["text"].alias("text")).cast(row))))
    first = let(found, lambda x: F.filter(x, lambda y, i: F.coalesce(F.get(x, i - 1)["at"] != y["at"], F.lit(True))))
    return pages.select(*PAGE, F.explode(first).alias("x")).select(*PAGE, "x.at", "x.text")
