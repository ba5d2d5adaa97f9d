"""Documents: words, links, chunks, cleaning, quality."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import html_text, token_estimate


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf of the lower-case words of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, href: link targets of a page, in any number."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), 1)).alias("href"))


def quality_gate(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash, duplicate (a smaller key has the same text), gate (empty, short, ok)."""
    hashed = docs.select(key, F.sha2(text, 256).alias("hash"), F.when(F.trim(text) == "", "empty").when(F.length(text) < 20, "short").otherwise("ok").alias("gate"))
    first = hashed.groupBy("hash").agg(F.min(key).alias("_first"))
    return hashed.join(first, "hash").select(key, "hash", (F.col(key) != F.col("_first")).alias("duplicate"), "gate")


def repeated_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """line, docs, n of the trimmed lines that several documents hold, such as headers and footers."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, F.trim("line").alias("line")).where("line <> ''")
    # First per document, so a document that repeats a line adds one row to the second count.
    per = lines.groupBy("line", key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).where("docs > 1")


def chunk(docs: DataFrame, key: str, text: str, most_tokens: int = 500) -> DataFrame:
    """key, chunk_no, content, tokens: paragraphs packed in order into chunks of about most_tokens tokens.

    A paragraph belongs to the chunk in which its first token falls, so a chunk passes the limit by its last
    paragraph at most, and no chunk needs the one before it.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).where(F.trim("line") != "").withColumn("tokens", token_estimate(F.col("line")))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("chunk_no", F.floor(before / most_tokens).cast("int"))
    packed = numbered.groupBy(key, "chunk_no").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("parts"), F.sum("tokens").alias("tokens"))
    return packed.select(key, "chunk_no", F.array_join(F.col("parts.line"), "\n").alias("content"), "tokens")


def clean_pages(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, removed_controls, removed_page_number: control characters and a closing page number out."""
    bare = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    cut = F.regexp_replace(bare, r"\s*(?:[-–—]\s*)?\d{1,4}(?:\s*[-–—])?\s*$", "")
    return pages.select(key, cut.alias(text), (F.length(text) - F.length(bare)).alias("removed_controls"), (F.length(cut) < F.length(bare)).alias("removed_page_number"))


def containing(docs: DataFrame, key: str, text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """key, item of the documents that contain a passage, where the passage begins at a word.

    Passages and documents meet on the passage's first three words; containment is then exact, so no pair is
    made that does not share such a beginning.
    """
    words = lambda c: F.filter(F.split(c, r"[ \n]+"), lambda w: w != "")
    start = passages.select(item, F.col(passage).alias("_passage"), F.array_join(F.slice(words(F.col(passage)), 1, 3), " ").alias("_head"))
    pieces = docs.select(key, words(F.col(text)).alias("_words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - 2, F.lit(1))), lambda i: F.array_join(F.slice("_words", i, F.lit(3)), " "))
    heads = pieces.select(key, F.explode(F.array_distinct(runs)).alias("_head"))
    met = heads.join(start.select(item, "_head"), "_head").select(key, item).distinct()
    both = met.join(docs.select(key, F.col(text).alias("_text")), key).join(start.select(item, "_passage"), item)
    return both.where(F.contains("_text", "_passage")).select(key, item)


def sections(docs: DataFrame, key: str, text: str, heading: str, short: int) -> DataFrame:
    """key, at, line, section: a line that looks like a heading, or is short, opens the next section."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    opens = (F.col("line").rlike(heading) | (F.length("line") < short)).cast("int")
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(opens).over(order))


def pipe_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, column_no, cell of lines of a pipe table; divider lines are left out."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = lines.where(F.contains("line", F.lit("|")) & ~F.col("line").rlike(r"^[ |:-]*$"))
    return rows.select(key, "line_no", F.posexplode(F.split("line", r"\|")).alias("column_no", "cell")).withColumn("cell", F.trim("cell"))


def pack(hits: DataFrame, key: str, order: list, item: str, size: str, budget: int) -> DataFrame:
    """key, item, size of the hits that fit a budget, taken greedily in order; the first is always taken.

    A key's rows are streamed in order through one task, however many; a null size fits only as the first.
    """

    def fold(batches):
        last, used, taken = None, 0, 0
        for b in batches:
            keep = []
            for i, (k, n) in enumerate(zip(b.column(key).to_pylist(), b.column(size).to_pylist())):
                if taken == 0 or k != last:
                    last, used, taken = k, 0, 0
                if taken == 0 or (n is not None and used + n <= budget):
                    used, taken = used + (n or 0), taken + 1
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select([key, item, size])

    rows = hits.withColumn(size, F.col(size).cast("long")).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(fold, rows.select(key, item, size).schema)


CELL = re.compile(r"(?is)<t([hd])\b([^>]*)>(.*?)</t\1>")
SPAN = {k: re.compile(rf"(?i)\b{k}\s*=\s*[\"']?(\d+)") for k in ("rowspan", "colspan")}


def _grid(rows: list[str]) -> list[tuple[int, int, str]]:
    """row, column, inner HTML of a table's cells; a cell that spans several places stands in each."""
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for _, attributes, inner in CELL.findall(row):
            down, across = (min(int(m[1]), 100) or 1 if (m := SPAN[k].search(attributes)) else 1 for k in ("rowspan", "colspan"))
            while (r, c) in taken:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for k in range(c, c + across):
                    taken.setdefault((i, k), inner)
            c += across
    return [(r, c, inner) for (r, c), inner in sorted(taken.items())]


def table_grid(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, col_no, cell of the tables of pages, spans filled in. Spark cuts tables and rows; a helper places cells."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table\b.*?</table>"), 0)).alias("table_no", "_t"))
    rows = tables.select(key, "table_no", F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b.*?</tr>"), 0).alias("_rows"))

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, "table_no")], pa.array([_grid(r) for r in b.column("_rows").to_pylist()], pa.list_(pa.struct([("row_no", pa.int32()), ("col_no", pa.int32()), ("cell", pa.string())])))], [key, "table_no", "cells"])

    placed = rows.mapInArrow(place, f"{key} {pages.schema[key].dataType.simpleString()}, table_no int, cells array<struct<row_no:int,col_no:int,cell:string>>")
    return placed.select(key, "table_no", F.inline("cells")).withColumn("cell", html_text(F.col("cell")))


def absolute_links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, url, label of a page's links, made absolute by the page's own address."""
    pattern = r"(?is)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    each = pages.select(key, F.col(url).alias("_base"), F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), 0)).alias("_a"))
    href, label = F.replace(F.regexp_extract("_a", pattern, 1), F.lit("&amp;"), F.lit("&")), html_text(F.regexp_extract("_a", pattern, 2))
    host, folder = F.regexp_extract("_base", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract("_base", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    full = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("_base", "^([^:]+:)", 1), href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract("_base", "^([^#]*)", 1), href))
        .otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(host, F.lit("/"))), href))
    )
    return each.select(key, full.alias("url"), label.alias("label")).where("label <> '' AND url <> ''")


def blob_store(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key, hash, size, content: raw bytes in a table of their own, joined only where they are asked for."""
    return df.select(key, content.alias("content")).select(key, F.sha2("content", 256).alias("hash"), F.octet_length("content").alias("size"), "content")


def greedy_caps(hits: DataFrame, key: str, order: list, page: str, topic: str, caps: dict[str, int], other: int, limit: int) -> DataFrame:
    """Rows of hits, taken in order: one a page, so many a topic, `limit` for a key. A row that its topic leaves out does not use up its page.

    A key's rows are streamed through one task; what is kept of them is bounded by the limit.
    """

    def fold(batches):
        last, pages, topics, n, begun = None, set(), {}, 0, False
        for b in batches:
            keep = []
            for i, (k, p, t) in enumerate(zip(b.column(key).to_pylist(), b.column(page).to_pylist(), b.column(topic).to_pylist())):
                if not begun or k != last:
                    last, pages, topics, n, begun = k, set(), {}, 0, True
                if n < limit and p not in pages and topics.get(t, 0) < caps.get(t, other):
                    pages.add(p)
                    topics[t] = topics.get(t, 0) + 1
                    n += 1
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    rows = hits.repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(fold, rows.schema)


def centred_lines(boxes: DataFrame, key: str, y: str, order: list, tolerance: float) -> DataFrame:
    """Adds line: boxes of a page from the top join the line whose mean height is near, which then moves. Streamed by page."""

    def fold(batches):
        last, mean, n, line, begun = None, 0.0, 0, 0, False
        for b in batches:
            lines = []
            for k, h in zip(b.column(key).to_pylist(), b.column(y).to_pylist()):
                if not begun or k != last:
                    last, mean, n, line, begun = k, h, 0, 1, True
                elif abs(h - mean) > tolerance:
                    mean, n, line = h, 0, line + 1
                mean, n = (mean * n + h) / (n + 1), n + 1
                lines.append(line)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.int32())], [*b.schema.names, "line"])

    rows = boxes.repartition(key).sortWithinPartitions(key, y, *order)
    return rows.mapInArrow(fold, rows.withColumn("line", F.lit(1)).schema)


def with_parents(children: DataFrame, parents: DataFrame, budget: int) -> DataFrame:
    """parent_id, id, shown (parent, child), content, tokens: a child gives way to its parent if that holds it and fits the budget.

    Both: parent_id, content, first_page, last_page, tokens; children also id and is_table (tables stay).
    """
    p = parents.select("parent_id", F.col("content").alias("_c"), F.col("first_page").alias("_lo"), F.col("last_page").alias("_hi"), F.col("tokens").alias("_n"))
    holds = (F.trim("content") != "") & (F.col("_lo") <= F.col("first_page")) & (F.col("_hi") >= F.col("last_page")) & F.contains("_c", F.trim("content")) & (F.col("_n") <= budget) & ~F.col("is_table")
    joined = children.join(p, "parent_id", "left").withColumn("_up", F.coalesce(holds, F.lit(False)))
    pick = lambda a, b: F.when(F.col("_up"), F.col(a)).otherwise(F.col(b))
    return joined.select("parent_id", "id", F.when(F.col("_up"), "parent").otherwise("child").alias("shown"), pick("_c", "content").alias("content"), pick("_n", "tokens").alias("tokens"))
