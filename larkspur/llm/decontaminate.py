"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so a question with other values still has the
same template. Windows of `window` template words of the benchmark are hash-joined with those of the
documents. A window counts if each of its slots has the item's value or follows the mapping of values that most
slots of the same alignment follow: one benchmark value maps to one document value, and of names and units the other
way round too (two numbers may become equal). A window of placeholders only says nothing by itself: it counts with
the item's values, or beside windows that hold plain words. A hit is kept where enough of the item's windows count, or
where `RUN` words in a row do, `WINDOW` of them equal.

A name is a word that starts with a capital, a unit is one of UNITS, a number is a word
of digits with separators. Words are runs of letters and digits, so punctuation and layout do not matter; in
scripts without spaces every character is a word.

Capitals tell names only while the document keeps the item's case. So every window has a second form in which
names are plain words in lower case: text in capitals, lower or title case is found by it, with other numbers or
units too (but not a window with both another case and another name). A word that opens a sentence may be a name or
not: a third form takes each with a capital for one, so `Alice buys 12 apples` is found as `Carol buys 17 apples`.

The benchmark index is sent to the tasks while it holds at most `max_index` windows; a larger one stays a
table, and window hashes are joined by shuffle. Documents are read whole in both cases.

Edge cases: null texts and texts without words have no hit; texts of any length are read whole; an empty table, or
one without items, gives no rows; an item of fewer words than `WINDOW` is found by its
whole template, or with its own values only if it has fewer than two plain words; one of a single word is found where
it is all of a document's text; every row is judged by itself,
also those that share a doc_id or have none, and rows that share a doc_id give one hit per item, the best; equal items
each give a hit; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import BASE, PUNCTUATION, folded_bytes, mix, per_character, powers, slices
from larkspur.llm.scratch import small_batches

WINDOW = 8
#: So many words in a row are a hit, whatever their share.
RUN = 13
#: Share of an item's windows that a document must hold.
COVER = 0.5
#: Unit words and symbols, in lower case.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s min h day days hour hours minute minutes second seconds week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees mph kmh hz kw w v".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x11, 0x22, 0x33))

DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
#: Bytes of the character that a byte begins.
WIDTH = np.ones(256, np.int64)
WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 2, 3, 4
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n:|"]] = True


#: Scripts written without spaces: Thai to Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]


def kind_of(c: str) -> int:
    """0 letter, digit or mark, 1 anything between words, 2 a word of its own."""
    if unicodedata.category(c)[0] in "PSZC":
        return 1
    return 2 if any(a <= ord(c) <= b for a, b in UNSPACED) else 0


def wide_kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters outside ASCII begin, how many bytes they have, and their kinds."""
    at = np.flatnonzero(data >= 0xC0)
    width = np.minimum(WIDTH[data[at]], len(data) - at)
    code = data[at].astype(np.int64) & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[width]
    for i in range(1, 4):
        more = width > i
        code[more] = code[more] << 6 | data[at[more] + i] & 0x3F
    return at, width, per_character(np.minimum(code, 0x10FFFF), kind_of, np.int8)


def _hash_words(texts: list[str]) -> np.ndarray:
    return template(*folded_bytes(pa.array(texts, pa.string())))[1]


def template(data: np.ndarray, folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, own hash, slot kind (0 none) of each word, each text's range of words, and the plain words with a capital that open a sentence.

    data and folded: the texts' bytes as written and in lower case, from offsets[0] to offsets[-1].
    """
    offsets = offsets - offsets[0]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    gap = PUNCTUATION[data]
    # a point or comma between digits belongs to the number
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & DIGITS[data[:-2]] & DIGITS[data[2:]]
    gap = gap & ~inner
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    at, width, wide = wide_kinds(data)
    for i in range(4):
        gap[at[(wide == 1) & (width > i)] + i] = True
    first[at[wide == 2]] = True
    first[(at + width)[wide == 2]] = True
    first = first[:n]
    start, stop = ~gap, ~gap
    start = start.copy()
    start[1:] &= gap[:-1] | first[1:]
    stop = stop.copy()
    stop[:-1] &= gap[1:] | first[1:]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        own = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    digits = np.concatenate([[0], np.cumsum(DIGITS[data] | inner)])
    number = digits[stops] - digits[starts] == stops - starts
    # a capital inside a sentence: no stop between this word and the one before
    marks = np.concatenate([[0], np.cumsum(STOPS[data] & ~inner)])
    bounds = np.searchsorted(starts, offsets)
    fresh = np.ones(len(starts), bool)
    if len(starts) > 1:
        fresh[1:] = marks[starts[1:]] > marks[stops[:-1]]
    fresh[bounds[:-1][bounds[:-1] < len(starts)]] = True
    # a character is a capital if lower case changes it
    changed = np.concatenate([[0], np.cumsum(data != folded)])
    second = np.minimum(starts + WIDTH[data[starts]], stops)
    third = np.minimum(second + WIDTH[data[np.minimum(second, n - 1)]], stops)
    capital = (changed[second] > changed[starts]) & (second < stops) & (changed[third] == changed[second])
    name = capital & ~fresh
    unit = np.isin(own, _units())
    kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.uint8)
    typed = np.where(kind == 1, NUMBER, np.where(kind == 2, NAME, np.where(kind == 3, UNIT, own)))
    return typed, own, kind, bounds, capital & fresh & (kind == 0)


def forms(typed: np.ndarray, own: np.ndarray, kind: np.ndarray, opening: np.ndarray) -> list[np.ndarray]:
    """Words with names as placeholders, with names as they are in lower case, and with opening words as names too."""
    return [typed, np.where(kind == 2, own, typed), np.where(opening, NAME, typed)]


_cache: dict[str, np.ndarray] = {}


def _units() -> np.ndarray:
    if "units" not in _cache:
        _cache["units"] = np.zeros(0, np.uint64)  # while their own hashes are made
        _cache["units"] = np.sort(_hash_words(UNITS))
    return _cache["units"]


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, as a polynomial over the word hashes."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(BASE) + h[i : m + i]
        return mix(out)


def keys(words: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of typed words; the own words count where too few of them are plain to say something."""
    h = rolled(words, size)
    if len(h):
        plain = np.concatenate([[0], np.cumsum(~np.isin(words, [NUMBER, NAME, UNIT]))])
        valued = plain[size:] - plain[:-size] < (1 if size == WINDOW else 2)
        with np.errstate(over="ignore"):
            h[valued] = mix(h[valued] * np.uint64(BASE) + rolled(own, size)[valued])
    return h


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"], pdf["text"]):
            typed, own, kind, _, opening = template(*folded_bytes(pa.array([text or ""], pa.string())))
            size = min(WINDOW, len(typed))
            if not size:
                continue
            own_words, kinds = own.view(np.int64).tolist(), [kind.tolist()] * 2 + [np.where(opening, 2, kind).tolist()]
            hashes = [keys(x, own, size).view(np.int64).tolist() for x in forms(typed, own, kind, opening)]
            for i, each in enumerate(zip(*hashes)):
                first = {x: k for x, k in reversed(list(zip(each, kinds)))}  # of equal forms the first counts
                rows += [(item, x, i, len(hashes[0]), own_words[i : i + size], k[i : i + size]) for x, k in first.items()]
        yield pd.DataFrame(rows, columns=["item_id", "window", "at", "windows", "words", "kinds"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window (hash, of either form), at (word position), windows (the item's count), words (own hashes), kinds."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL")
    return items.mapInPandas(_item_windows, "item_id long, window long, at int, windows int, words array<long>, kinds array<int>")


def _document_windows(sent, sizes: list[int]):
    """Windows of documents of the sizes that the index has, only those in the index if it is at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sent.value if sent is not None else None
        # A bit table in front of the exact search lets almost all windows go at once.
        bits = None
        if listed is not None:
            bits = np.zeros(1 << 20, bool)
            bits[(listed.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            ids = np.array(b.column("doc_id").to_pylist(), object)  # with nulls
            data, folded, offsets = folded_bytes(b.column("text"))
            texts = b.column("text_hash").to_numpy()
            out: list[list] = [[], [], [], [], []]
            for lo, hi in slices(offsets):
                typed, own, kind, bounds, opening = template(data[offsets[lo] : offsets[hi]], folded[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                for size, words in [(size, words) for size in sizes for words in forms(typed, own, kind, opening)]:
                    h = keys(words, own, size)
                    if not len(h):
                        continue
                    ok = np.ones(len(h), bool)
                    if size == 1:  # an item of one word must be all of a text
                        ok &= np.repeat(np.diff(bounds) == 1, np.diff(bounds))
                    for j in range(1, size):  # windows that cross into the next text
                        edge = bounds[1:-1] - j
                        ok[edge[(edge >= 0) & (edge < len(h))]] = False
                    if bits is not None:
                        ok &= bits[(h >> np.uint64(44)).astype(np.int64)]
                    at = np.flatnonzero(ok)
                    if listed is not None and len(at):
                        x = h[at].view(np.int64)
                        near = np.minimum(np.searchsorted(listed, x), len(listed) - 1)
                        at = at[listed[near] == x]
                    doc = np.searchsorted(bounds, at, "right") - 1
                    if size < WINDOW and len(at):  # a whole item: another place of the same words adds nothing
                        once = np.unique(np.stack([doc.astype(np.uint64), h[at], rolled(own, size)[at]]), axis=1, return_index=True)[1]
                        at, doc = at[once], doc[once]
                    out[0] += ids[lo + doc].tolist()
                    out[1].append(texts[lo + doc])
                    out[2].append(h[at].view(np.int64))
                    out[3].append(at - bounds[doc])
                    out[4] += [own[i : i + size].view(np.int64) for i in at]
            if out[0]:
                arrays = [pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in out[1:4]]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *arrays, pa.array(out[4], pa.list_(pa.int64()))], ["doc_id", "text_hash", "window", "position", "held"])

    return run


def _majority(slots: dict, forward: bool) -> dict:
    """The value that most slots give to each value of one side; ties go to equal values, then to the least."""
    votes: dict = {}
    for kind, b, d in slots.values():
        x, y = (b, d) if forward else (d, b)
        counts = votes.setdefault((kind, x), {})
        counts[y] = counts.get(y, 0) + 1
    return {key: min(counts, key=lambda y: (-counts[y], y != key[1], y)) for key, counts in votes.items()}


#: What tells documents apart, also those that share a doc_id or have none.
ROW = ["doc_id", "text_hash"]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the windows found in each alignment, whether they count, hold the item's values and end a long run."""
    for pdf in batches:
        found = []
        for pairs in pdf["found"]:
            slots = {f["at"] + i: (p["kind"], p["b"], p["d"]) for f in pairs for i, p in enumerate(f["pairs"]) if p["kind"]}
            there, back = _majority(slots, True), _majority(slots, False)
            bad = {i for i, (kind, b, d) in slots.items() if b != d and (there[kind, b] != d or (kind != 1 and back[kind, d] != b))}
            rows = []
            for f in sorted(pairs, key=lambda f: f["at"]):
                places = range(f["at"], f["at"] + len(f["pairs"]))
                same = all(p["b"] == p["d"] for p in f["pairs"])
                rows.append({"at": f["at"], "counts": bad.isdisjoint(places), "same": same, "run": False})
                # the words in a row that end with this window, and those of them that are the item's
                if not rows[-1]["counts"]:
                    run = []
                    continue
                equal = [p["b"] == p["d"] for p in f["pairs"]]
                run = [*run, equal[-1]] if len(rows) > 1 and rows[-2]["counts"] and rows[-2]["at"] == f["at"] - 1 else equal
                rows[-1]["run"] = len(run) >= RUN and sum(run) >= WINDOW
            found.append(rows)
        yield pdf[[*ROW, "item_id", "windows"]].assign(found=found)


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, max_index: int = 2_000_000, cover: float = COVER) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), item_id, cover (share of the item's windows found), same_values (each place found is also found with the item's values)."""
    spark = docs.sparkSession
    small_batches(spark)
    index = benchmark_windows(benchmark)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    sizes = sorted(r["size"] for r in index.select(F.size("words").alias("size")).distinct().collect())  # at most WINDOW
    small = index.select("window").distinct().limit(max_index + 1).count() <= max_index
    sent = None
    if small:
        listed = np.sort(index.select("window").distinct().toArrow()["window"].to_numpy())  # at most max_index hashes
        sent = spark.sparkContext.broadcast(listed) if len(listed) else None
        if sent is None:
            rows = rows.limit(0)
    found = rows.mapInArrow(_document_windows(sent, sizes), "doc_id long, text_hash long, window long, position long, held array<long>")
    # Words are paired by place; plain ones must be equal.
    words = F.arrays_zip(F.col("kinds").alias("kind"), F.col("words").alias("b"), F.col("held").alias("d"))
    hits = found.join(index, "window").where(F.size("held") == F.size("words"))
    hits = hits.withColumn("pairs", words).where(F.forall("pairs", lambda p: (p["kind"] > 0) | (p["b"] == p["d"])))
    aligned = (
        hits.groupBy(*ROW, "item_id", "at", "windows", (F.col("position") - F.col("at")).alias("shift"))
        .agg(F.min("pairs").alias("pairs"))
        .groupBy(*ROW, "item_id", "windows", "shift")  # at most the item's windows
        .agg(F.collect_list(F.struct("at", "pairs")).alias("found"))
    )
    judged = aligned.select(*ROW, "item_id", "windows", "found").mapInPandas(_judge, "doc_id long, text_hash long, item_id long, windows int, found array<struct<at: int, counts: boolean, same: boolean, run: boolean>>")
    # Passages broken by edits match in several runs: their windows count together, each place of the item once.
    return (
        judged.select(*ROW, "item_id", "windows", F.inline("found"))
        .groupBy(*ROW, "item_id", "windows")
        .agg(F.count_distinct(F.when(F.col("counts"), F.col("at"))).alias("n"), F.count_distinct("at").alias("all"), F.count_distinct(F.when(F.col("same"), F.col("at"))).alias("equal"), F.max("run").alias("run"))
        .withColumn("cover", F.col("n") / F.col("windows"))
        .withColumn("same_values", F.col("equal") == F.col("all"))
        .where((F.col("cover") >= cover) | F.col("run"))
        .select(*ROW, "item_id", "cover", "same_values")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, max_index: int = 2_000_000, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, cover, same_values: the best hit of the rows that share a doc_id."""
    best = contaminated_rows(docs, benchmark, max_index, cover).groupBy("doc_id", "item_id").agg(F.max(F.struct("cover", "same_values")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def op2_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark).select("doc_id", "item_id", "cover", "same_values")
