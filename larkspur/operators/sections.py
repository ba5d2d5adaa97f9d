"""Paged documents as a tree of chunks: pages and long sections above, table row groups and pieces of sections below.

Pages are rows (document, terms, page, text, headings, tables, layout): `terms` marks documents whose sections run on over
pages, `headings` are the lines that the parser took for headings, `tables` are rows of cells, and `layout` the texts of a
page's layout, which stand for its narrative where it has tables.

A heading ends those of its level and below. Levels are few, so a line's headings are the last one of each level, as far as
no higher one follows. Lines are dealt by document once; headings, sections and their numbers are told there from sorted
rows, so no text is sent a second time and no group that is held at once is larger than a section. Tokens of a piece of text
are counted once and added up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import let, token_estimate
from larkspur.sources.shared import written

# Forms of headings with level, confidence and reason; ends of lines that are no headings but of the first level; what opens a unit and ends a sentence.
HEADINGS = [
    (1, r"^第[一二三四五六七八九十百零〇0-9]+条(?:\s+|$)", 0.92, "条款编号标题"),
    (2, r"^[一二三四五六七八九十百]+[、.．]", 0.88, "中文序号标题"),
    (3, r"^[（(][一二三四五六七八九十百零〇0-9]+[）)]", 0.84, "括号序号标题"),
]
NO_HEADING_ENDS = "。；;"
DECLARED = (2, 0.76, "文档结构标题")
MARKED, SHORT = "解析器标题标记", "短行标题"
NO_HEADING = (0.45, "未检测到章节标题")
UNIT_OPENING = r"^(?:第[一二三四五六七八九十百零0-9]+条|[一二三四五六七八九十]+、|\d+[.、])"
# What is not 。！？!?；; and what is no Han character, letter or digit, as ranges: Java takes ten times as long for [^...] of such.
SENTENCE = r"[\x00-\x20\x22-\x3a\x3c-\x3e\x40-\x{3001}\x{3003}-\x{ff00}\x{ff02}-\x{ff1a}\x{ff1c}-\x{ff1e}\x{ff20}-\x{10ffff}]++[。！？!?；;]?"
TOKEN, BETWEEN = r"(?:[\x{3400}-\x{9fff}]|[A-Za-z]++|\d++(?:\.\d++)?+)", r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x{33ff}\x{a000}-\x{10ffff}]*+"
#: Tokens of a piece of a section, of terms and of other documents; of a table's row group; and the most of any table chunk.
TERMS_TOKENS, OTHER_TOKENS, TABLE_TOKENS, MOST_TABLE_TOKENS = 800, 500, 500, 800
#: A unit beyond this is cut into sentences.
UNIT_TOKENS = 500
SHORT_HEADING, SURE = 40, 0.75

BLANKS = " \t\n\x0b\f\r\u00a0\u3000\ufeff"
PAGE = ["document", "page"]
NO_TABLES = "array<array<array<string>>>"


def with_line_ends(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trimmed(c: Column) -> Column:
    """Without blanks at the ends, of text whose line ends are plain."""
    return F.btrim(c, F.lit(BLANKS))


def tidy(c: Column) -> Column:
    return trimmed(with_line_ends(c))


def said(texts: Column) -> Column:
    """Tidy texts of an array that are not empty."""
    return F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), tidy), lambda x: x != "")


def row_texts(table: Column) -> Column:
    return F.transform(table, lambda row: F.array_join(F.transform(row, lambda cell: tidy(cell)), " | "))


def hard_split(text: Column, most: Column) -> Column:
    """Pieces of at most so many tokens each; what stands between tokens stays with the one before."""
    piece = F.concat(F.lit(f"(?:^{BETWEEN})?(?:{TOKEN}{BETWEEN}){{1,"), most.cast("string"), F.lit("}+"))
    return let(F.transform(F.regexp_extract_all(text, piece, F.lit(0)), trimmed), lambda cut: F.when(F.size(cut) == 0, F.array(text)).otherwise(cut))


def counted(texts: Column) -> Column:
    """(text, n) of each text, n being its tokens."""
    return F.transform(texts, lambda x: F.struct(x.alias("text"), token_estimate(x).cast("int").alias("n")))


def within(pieces: Column, most: Column) -> Column:
    """Counted pieces, those of more tokens cut: all parts of a cut but the last are full."""

    def cut(x: Column) -> Column:
        return let(hard_split(x["text"], most), lambda parts: F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.when(i < F.size(parts) - 1, most).otherwise(x["n"] - most * (F.size(parts) - 1)).cast("int").alias("n"))))

    return F.flatten(F.transform(pieces, lambda x: F.when(x["n"] > most, cut(x)).otherwise(F.array(x))))


def packed_pieces(pieces: Column, most: Column, before: Column | None = None) -> Column:
    """Counted texts joined by line ends, in order, as long as they hold at most so many tokens; `before` (tokens) counts for each."""
    base = F.lit(0) if before is None else before
    state = "struct<done:array<struct<text:string,n:int>>,now:string,n:int>"
    shut = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["now"].alias("text"), acc["n"].alias("n"))))

    def step(acc: Column, part: Column) -> Column:
        full = (acc["now"] != "") & (base + acc["n"] + part["n"] > most)
        grown = F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", part["text"]).otherwise(F.concat(acc["now"], F.lit("\n"), part["text"])).alias("now"), (acc["n"] + part["n"]).cast("int").alias("n"))
        return F.when(full, F.struct(shut(acc).alias("done"), part["text"].alias("now"), part["n"].alias("n"))).otherwise(grown).cast(state)

    zero = F.struct(F.array().cast("array<struct<text:string,n:int>>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(pieces, zero, step, lambda acc: F.filter(shut(acc), lambda x: x["text"] != ""))


def packed(parts: Column, most: Column, before: Column | None = None) -> Column:
    """Texts joined as by packed_pieces."""
    return F.transform(packed_pieces(counted(parts), most, before), lambda x: x["text"])


def with_tables(pages: DataFrame) -> DataFrame:
    """tables without empty ones, content (of the tables, else the text) and _page, the id of a page that has content."""
    tables = F.filter(F.coalesce("tables", F.array().cast(NO_TABLES)), lambda t: F.size(t) > 0)
    flat = F.array_join(F.filter(F.transform("tables", lambda t: F.array_join(row_texts(t), "\n")), lambda x: x != ""), "\n\n")
    content = let(F.when(F.size("tables") > 0, flat).otherwise(""), lambda x: F.when(x != "", tidy(x)).otherwise(tidy(F.col("text"))))
    pages = pages.withColumn("tables", tables).withColumn("content", content)
    return pages.withColumn("_page", F.when(F.col("content") != "", chunk_id(F.col("document"), F.col("page"), F.lit("parent"), F.col("content"))))


def heading_lines(pages: DataFrame) -> DataFrame:
    """document, terms, page, n, text, level (0 none), confidence, reasons of every narrative line; _page, if pages have it."""
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    cells = squeezed(F.array_join(F.transform("tables", lambda t: F.array_join(row_texts(t), "\n")), "\n"))
    apart = lambda found: F.filter(said(F.col("layout")), lambda x: let(squeezed(x), lambda y: ~(F.contains(found, y) | F.contains(y, found))))
    split = lambda x: F.split(x, "\n")
    texts = F.when(F.size("tables") > 0, F.flatten(F.transform(let(cells, apart), split))).otherwise(split(with_line_ends(F.col("text"))))
    each = [c for c in ("_page",) if c in pages.columns]
    lines = pages.select("document", "terms", "page", *each, said(F.col("headings")).alias("_h"), F.posexplode(F.filter(F.transform(texts, trimmed), lambda x: x != "")).alias("n", "text"))
    declared = F.array_contains("_h", F.col("text"))
    open_end = ~reduce(lambda a, b: a | b, [F.endswith(F.col("text"), F.lit(x)) for x in NO_HEADING_ENDS])
    form = F.coalesce(*[F.when(F.col("text").rlike(p) & (F.lit(level == 1) | open_end), F.lit(i)) for i, (level, p, _, _) in enumerate(HEADINGS)], F.when(declared, F.lit(len(HEADINGS))))
    lines = lines.withColumns({"_form": form, "_declared": declared, "_short": F.length("text") <= SHORT_HEADING})
    forms = [*[(level, c, reason) for level, _, c, reason in HEADINGS], DECLARED]
    of_form = lambda k: reduce(lambda a, x: a.when(F.col("_form") == x[0], F.lit(x[1][k])), enumerate(forms[1:], 1), F.when(F.col("_form") == 0, F.lit(forms[0][k])))
    more = lambda c, on, add: F.when(on, F.least(F.lit(0.99), c + add)).otherwise(c)
    confidence = F.when(F.col("_form").isNotNull(), F.round(more(more(of_form(1), F.col("_declared"), 0.08), F.col("_short"), 0.02), 2))
    reasons = F.when(F.col("_form").isNotNull(), F.array_compact(F.array(of_form(2), F.when(F.col("_declared"), F.lit(MARKED)), F.when(F.col("_short"), F.lit(SHORT)))))
    return lines.select("document", "terms", "page", (F.col("n") + 1).alias("n"), "text", F.coalesce(of_form(0), F.lit(0)).alias("level"), confidence.alias("confidence"), reasons.alias("reasons"), *each)


def with_paths(lines: DataFrame) -> DataFrame:
    """Adds path (titles of the headings a line stands under, outermost first) and start (page and line that open its section)."""
    levels = [k for k, *_ in HEADINGS]
    # one document, or one of its pages where sections end with the page; rows are read in order
    so_far = Window.partitionBy("document", F.when(~F.coalesce("terms", F.lit(False)), F.col("page"))).orderBy("page", "n").rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda k: F.when(F.col("level") == k, F.struct("page", "n", "text"))
    told = lines.repartition("document").withColumns({f"_s{k}": F.last(mark(k), ignorenulls=True).over(so_far) for k in levels})
    place = lambda k: F.struct(F.col(f"_s{k}.page"), F.col(f"_s{k}.n"))
    there = lambda k: F.col(f"_s{k}").isNotNull()
    holds = lambda k: reduce(lambda a, j: a & (~there(j) | (place(k) > place(j))), range(1, k), there(k))
    path = F.array_compact(F.array(*[F.when(holds(k), F.col(f"_s{k}.text")) for k in levels]))
    opened = F.greatest(*[F.when(there(k), place(k)) for k in levels])
    none = F.struct(F.when(F.col("terms"), F.lit(0)).otherwise(F.col("page")).alias("page"), F.lit(0).alias("n"))
    return told.withColumns({"path": path, "start": F.coalesce(opened, none)}).select(*lines.columns, "path", "start")


def section_lines(pages: DataFrame) -> DataFrame:
    """Sections as by document_sections, with their lines as an array `lines` (page, n, text); _page of the first, if pages have it."""
    each = [c for c in ("_page",) if c in pages.columns]
    found = with_paths(heading_lines(pages)).groupBy("document", "start").agg(
        F.any_value("terms").alias("terms"), F.max("page").alias("page_end"), F.min(F.struct("page", "n", "path", "confidence", "reasons", *each)).alias("_first"),
        F.sort_array(F.collect_list(F.struct("page", "n", "text"))).alias("lines"),
    )  # fmt: skip  one section
    order = Window.partitionBy("document").orderBy("start")
    return found.select(
        "document", "terms", (F.row_number().over(order) - 1).alias("section"), F.col("_first.page").alias("page_start"), "page_end", "_first.path",
        F.coalesce("_first.confidence", F.lit(NO_HEADING[0])).alias("confidence"), F.coalesce("_first.reasons", F.array(F.lit(NO_HEADING[1]))).alias("reasons"),
        (F.coalesce("_first.confidence", F.lit(NO_HEADING[0])) < SURE).alias("review"), "lines", *[f"_first.{c}" for c in each],
    )


def line_id(line: Column) -> Column:
    return F.concat(F.lit("p"), line["page"].cast("string"), F.lit("-l"), line["n"].cast("string"))


def document_sections(pages: DataFrame) -> DataFrame:
    """document, terms, section, page_start, page_end, path, confidence, reasons, review, units (id, text) of every section."""
    found = written(section_lines(pages), "sections")  # so that each reader does not fold the lines again
    return found.withColumn("units", F.transform("lines", lambda x: F.struct(line_id(x).alias("id"), x["text"].alias("text")))).drop("lines")


def section_pieces(texts: Column, most: Column, unit_tokens: int = UNIT_TOKENS) -> Column:
    """Counted pieces of a section's lines: units (lines with those after one that opens a clause or an item), long ones in sentences."""
    opening = F.filter(F.transform(texts, lambda x, i: F.when((i == 0) | x.rlike(UNIT_OPENING), i)), lambda i: i.isNotNull())
    units = let(opening, lambda at: F.transform(at, lambda a, j: F.array_join(F.slice(texts, a + 1, F.coalesce(F.get(at, j + 1), F.size(texts)) - a), "\n")))
    sentences = lambda u: counted(F.filter(F.transform(F.regexp_extract_all(u, F.lit(SENTENCE), F.lit(0)), trimmed), lambda x: x != ""))
    # no token runs over the end of a sentence, so those of the unit are the sum
    whole = lambda u: let(sentences(u), lambda s: let(F.aggregate(s, F.lit(0), lambda a, x: a + x["n"]), lambda n: F.when((n <= unit_tokens) | (F.size(s) == 0), F.array(F.struct(u.alias("text"), n.alias("n")))).otherwise(s)))
    return within(F.flatten(F.transform(units, whole)), most)


def chunk_id(*parts: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 24))


COLUMNS = ["id", "document", "kind", "parent_id", "path", "page_start", "page_end", "content", "tokens", "content_hash", "section", "part", "confidence", "reasons", "review", "sequence", "previous_id", "next_id", "unit_ids"]


def page_chunks(pages: DataFrame, table_tokens: int = TABLE_TOKENS) -> DataFrame:
    """Chunks of pages (with_tables): each page with content, and the row groups of its tables under it."""

    def groups(table: Column) -> Column:
        def shown(rows: Column, head: Column) -> Column:
            found = packed_pieces(counted(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), F.lit(table_tokens), token_estimate(head))
            return let(found, lambda g: F.when(F.size(g) == 0, F.array(head)).otherwise(F.transform(g, lambda x: F.concat(head, F.lit("\n"), x["text"]))))

        texts = let(row_texts(table), lambda rows: shown(rows, F.get(rows, F.lit(0))))
        return F.transform(within(counted(texts), F.lit(MOST_TABLE_TOKENS)), lambda x: F.struct(tidy(x["text"]).alias("text"), x["n"].alias("n")))

    kind = "struct<kind:string,section:int,part:int,content:string,tokens:int>"
    chunk = lambda name, section, part, text, n: F.struct(F.lit(name).alias("kind"), section.alias("section"), part.alias("part"), text.alias("content"), n.alias("tokens")).cast(kind)
    none = F.lit(None)
    of_tables = F.flatten(F.transform("tables", lambda t, section: F.filter(F.transform(groups(t), lambda x, part: chunk("table", section, part, x["text"], x["n"])), lambda x: x["content"] != "")))
    page = F.array(chunk("parent", none, none, F.col("content"), token_estimate(F.col("content"))))
    chunks = F.when(F.col("_page").isNotNull(), F.when(F.size("tables") > 0, F.concat(page, of_tables)).otherwise(page))
    found = pages.select("document", "page", said(F.col("headings")).alias("path"), "_page", F.explode(chunks).alias("x")).select("document", "page", "path", "_page", "x.*")
    table = F.col("kind") == "table"
    return found.select(
        F.when(table, chunk_id(F.col("document"), F.col("page"), F.lit("table"), F.col("section"), F.col("part"), F.col("content"))).otherwise(F.col("_page")).alias("id"), "document", "kind",
        F.when(table, F.col("_page")).otherwise("").alias("parent_id"), "path", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "content", "tokens", "section", "part",
    )


def section_chunks(pages: DataFrame, terms_tokens: int, other_tokens: int, unit_tokens: int) -> DataFrame:
    """Chunks of sections of pages (with_tables): the pieces of each, and above them the section if it runs over pages of terms."""
    of_section = lambda name: chunk_id(F.col("document"), F.col("page_start"), F.col("page_end"), F.lit(name), F.col("section"), *[F.col("part")] * (name == "child"), F.col("content"))
    s = section_lines(pages).withColumns({"_texts": F.transform("lines", lambda x: x["text"]), "_most": F.when(F.col("terms"), terms_tokens).otherwise(other_tokens)})
    s = s.withColumn("content", F.when(F.col("terms") & (F.col("page_end") > F.col("page_start")), F.array_join("_texts", "\n")))
    s = s.withColumn("_own", F.when(F.col("content").isNotNull(), of_section("section"))).withColumn("_pieces", section_pieces(F.col("_texts"), F.col("_most"), unit_tokens))
    kind = "struct<part:int,content:string,tokens:int>"
    chunk = lambda part, text, n: F.struct(part.alias("part"), text.alias("content"), n.alias("tokens")).cast(kind)
    children = F.transform(packed_pieces(F.col("_pieces"), F.col("_most")), lambda x, i: chunk(i, x["text"], x["n"]))
    total = F.aggregate("_pieces", F.lit(0), lambda a, x: a + x["n"])
    chunks = F.concat(F.when(F.col("_own").isNotNull(), F.array(chunk(F.lit(None), F.col("content"), total))).otherwise(F.array().cast(f"array<{kind}>")), children)
    s = s.select("document", "section", "page_start", "page_end", "path", "confidence", "reasons", "review", "lines", "_own", F.coalesce("_own", "_page", F.lit("")).alias("_above"), F.explode(chunks).alias("x"))
    child = F.col("part").isNotNull()
    s = s.select(*[c for c in s.columns if c != "x"], "x.*").withColumns({"kind": F.when(child, "child").otherwise("parent"), "parent_id": F.when(child, F.col("_above")).otherwise("")})
    s = s.withColumn("id", F.when(child, of_section("child")).otherwise(F.col("_own")))
    in_part = F.filter("lines", lambda x: ~child | F.contains(F.col("content"), x["text"]) | F.contains(x["text"], F.col("content")))
    order = Window.partitionBy("document", "kind").orderBy("section", "part")  # chunks of one document
    beside = lambda f: F.when(child, F.coalesce(f("id").over(order), F.lit("")))
    s = s.withColumns({"unit_ids": F.transform(in_part, line_id), "sequence": F.when(child, F.row_number().over(order) - 1), "previous_id": beside(F.lag), "next_id": beside(F.lead)})
    return s.drop("lines", "_own", "_above")


def document_tree(pages: DataFrame, terms_tokens: int = TERMS_TOKENS, other_tokens: int = OTHER_TOKENS, table_tokens: int = TABLE_TOKENS, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """Chunks of all documents (COLUMNS). Kinds: parent (a page, or a section of terms that runs over pages), table, child."""
    pages = with_tables(pages)
    out = page_chunks(pages, table_tokens).unionByName(section_chunks(pages, terms_tokens, other_tokens, unit_tokens), allowMissingColumns=True)
    return out.withColumn("content_hash", F.sha2("content", 256)).select(*COLUMNS)
