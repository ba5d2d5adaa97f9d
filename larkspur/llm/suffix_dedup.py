"""Removal of repeated passages by suffix arrays built with two-stage sorting.

Every byte that lies in a `LENGTH`-byte string which also starts earlier (smaller doc_id, or same document)
is removed. The work is dealt so that no task needs the corpus:

1. Each window of LENGTH bytes is keyed by its anchor, the smallest hash among its `ANCHOR`-byte substrings.
   Equal windows have equal anchors. Neighbouring windows with one anchor form a run (super-window).
2. Anchors that occur in two different texts, or twice in one, can hold repeats; the other runs are let
   go by a filter of bounded size (a false positive costs time only).
3. Runs of equal content collapse to their earliest occurrence, with map-side combination; all windows of the
   later ones are repeats.
4. The different contents of an anchor meet in one task, which builds their suffix array: suffixes smaller
   than their successors are sorted directly, the others induced by scanning the buckets in order; then
   adjacent common prefixes of LENGTH bytes give the groups of equal windows. An anchor whose different contents
   have more than `HOT` bytes is not brought together: its windows are dealt one by one, by content.

Documents with equal text are one text (the earliest counts as the original). Contents of runs, and windows dealt one
by one, are told apart by two hashes of 64 bits (of the anchor and of the content); suffix arrays compare bytes.

Edge cases: null text is empty; texts under LENGTH bytes keep all bytes; texts of any length are read in pieces; rows that share a doc_id are ordered
by a hash of their text; of fully repeated rows one is the original and the others copies; null doc_id sorts
first; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.filters import passes, small_filter
from larkspur.llm.kernels import mix, powers, text_bytes
from larkspur.llm.scratch import small_batches, written

LENGTH = 100
ANCHOR = 32
#: Windows of a run at most, so that a run's bytes have a bound.
RUN = 4096
#: Bytes of the different contents of an anchor that one suffix array compares.
HOT = 1 << 20
#: Bytes of contents that one suffix array covers, up to the next anchor.
CHUNK = 1 << 20
PIECE = 1 << 18
#: Bits of a position within a piece, below the hash that anchors compete with.
LOW = np.uint64((1 << 24) - 1)
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """id, tid (hash of the text), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows and bytes handled at once: some whole texts, or a part of a long one with LENGTH - 1 bytes of overlap."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi == lo + 1 and b - a > 2 * PIECE:
            for at in range(a, b - LENGTH + 1, PIECE):
                yield lo, hi, at, min(b, at + PIECE + LENGTH - 1)
        else:
            yield lo, hi, a, b
        lo = hi


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor, and whether the anchor occurs twice, of each run."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1]
    h = mix(h)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    span, size = LENGTH - ANCHOR + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    inside = np.zeros(n + 1, np.int32)
    long_enough = np.diff(bounds) >= LENGTH
    inside[bounds[:-1][long_enough]] += 1
    inside[bounds[1:][long_enough] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    if not len(at):
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    anchor = (least[at] & LOW).astype(np.int64)
    key = h[anchor]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    count = last - first + 1
    twice = anchor[first] != anchor[last]
    if (count > RUN).any():  # cut long runs; each part keeps the anchor
        parts = -(-count // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, twice, whole = np.repeat(first, parts) + k * RUN, np.repeat(twice, parts), np.repeat(count, parts)
        count = np.minimum(RUN, whole - k * RUN)
    return at[first], count, key[first], twice


def _each(batch: pa.RecordBatch):
    """(piece's data, its first byte, row of each run, its runs), skipping texts that repeat one of the batch."""
    data, offsets = text_bytes(batch.column("text"))
    tid = batch.column("tid").to_numpy()
    ids = batch.column("id").to_numpy()
    order = np.lexsort((ids, tid))
    dup = np.zeros(len(tid), bool)
    dup[order[1:]] = (tid[order[1:]] == tid[order[:-1]]) & (np.diff(offsets)[order[1:]] == np.diff(offsets)[order[:-1]])
    for lo, hi, a, b in pieces(offsets):
        bounds = np.clip(offsets[lo : hi + 1], a, b) - a
        start, n, key, twice = runs(data[a:b], bounds)
        row = np.searchsorted(bounds, start, "right") - 1
        kept = ~dup[lo + row]
        yield data[a:b], a, lo + row[kept], start[kept], n[kept], key[kept], twice[kept], offsets, tid, ids


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(x[2], x[5], x[6]) for x in _each(batch)]
        if not parts:
            continue
        row, key, twice = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((key, row))
        row, key, twice = row[order], key[order], twice[order]
        again = (row[1:] == row[:-1]) & (key[1:] == key[:-1])  # in two runs of a text
        twice[1:] |= again
        tid = batch.column("tid").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tid), pa.array(twice)], ["anchor", "tid", "twice"])


def _contents(sent):
    """Runs whose anchor may be repeated, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for data, a, row, start, n, key, twice, offsets, tid, ids in _each(batch):
                some = np.flatnonzero(passes(table, key))
                if not len(some):
                    continue
                row, start, n, key = row[some], start[some], n[some], key[some]
                content = [data[s : s + k + LENGTH - 1].tobytes() for s, k in zip(start.tolist(), n.tolist())]
                arrays = [pa.array(key.view(np.int64)), pa.array(content, pa.binary()), pa.array(ids[row]), pa.array(tid[row]), pa.array(a + start - offsets[row]), pa.array(n), pa.array(twice[some])]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "content", "id", "tid", "pos", "n", "twice"])

    return run


def two_stage(text: np.ndarray, wanted: np.ndarray, stop_after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `text` at the wanted positions in order of their first LENGTH bytes, and whether each equals the one before.

    stop_after: the last wanted position of each run. Later suffixes take part only as far as induction needs them.
    """
    size = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)])
    # big-endian words of eight bytes at every position
    word = np.zeros(len(padded) - 8, np.uint64)
    for i in range(8):
        word |= padded[i : i + len(word)].astype(np.uint64) << np.uint64(56 - 8 * i)
    tail = np.uint64(0xFFFFFFFF << 32)
    depth = [(d, ~np.uint64(0) if d + 8 <= LENGTH else tail) for d in range(0, LENGTH, 8)]

    step = np.sign(padded[1 : size + 1].astype(np.int16) - text)
    differs = np.where(step != 0, np.arange(size, dtype=np.int32), np.int32(size))
    nearest = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = np.append(step, 1)[nearest] > 0  # smaller than its successor
    smaller[-1] = True
    sources = np.flatnonzero(smaller)
    active = np.zeros(size, bool)
    active[wanted] = True
    ends = sources[np.searchsorted(sources, stop_after)]
    extra = ends - stop_after
    fill = np.repeat(stop_after, extra) + 1 + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    active[fill] = True

    # Direct sorting: by the first word, then ties by the next words.
    order = np.flatnonzero(active & smaller)
    order = order[np.argsort(word[order], kind="stable")]
    group = np.concatenate([[0], np.cumsum(word[order[1:]] != word[order[:-1]])]) if len(order) else np.zeros(0, np.int64)
    for d, mask in depth[1:]:
        tied = np.zeros(len(order), bool)
        if len(order) > 1:
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = word[order[at] + d] & mask
        by = np.lexsort((key, group[at]))
        order[at] = order[at][by]
        key, old = key[by], group[at]
        changed = np.zeros(len(order), bool)
        changed[at[1:]] = (key[1:] != key[:-1]) & (old[1:] == old[:-1])
        edge = np.concatenate([[False], group[1:] != group[:-1]])
        group = np.cumsum(changed | edge)

    # Induction: scan the buckets of first bytes in order; each suffix found places the one before it.
    head = text[order]
    segment = np.searchsorted(head, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[active[before] & ~smaller[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            for part in np.split(before, np.flatnonzero(first[1:] != first[:-1]) + 1):
                waiting[text[part[0]]].append(part)

    for c in range(256):
        while waiting[c]:
            found = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(found)
            induce(found)
        direct = order[segment[c] : segment[c + 1]]
        if len(direct):
            out.append(direct)
            induce(direct)
    ranked = np.concatenate(out) if out else np.zeros(0, np.int64)
    is_wanted = np.zeros(size, bool)
    is_wanted[wanted] = True
    ranked = ranked[is_wanted[ranked]]

    # Adjacent common prefixes of LENGTH bytes.
    equal = np.zeros(len(ranked), bool)
    open_ = np.arange(1, len(ranked))
    for d, mask in depth:
        open_ = open_[((word[ranked[open_] + d] ^ word[ranked[open_ - 1] + d]) & mask) == 0]
    equal[open_] = True
    return ranked, equal


def repeated_windows(contents: list[bytes], counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(content, first byte, byte after the last) of the repeats among contents given from earliest to latest."""
    sizes = np.array([len(x) + 1 for x in contents], np.int64)
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    wanted = np.repeat(base, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ranked, equal = two_stage(text, wanted, base + counts - 1)
    starts = np.flatnonzero(~equal)
    repeat = np.ones(len(text), bool)
    if len(starts):
        repeat[np.minimum.reduceat(ranked, starts)] = False  # the earliest of each group stays
    late = wanted[repeat[wanted]]
    owner = np.searchsorted(base, late, "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (late[1:] != late[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(late) else []
    last = np.append(cut[1:], len(late)) - 1 if len(late) else []
    return [(int(owner[i]), int(late[i] - base[owner[i]]), int(late[j] - base[owner[i]] + LENGTH)) for i, j in zip(cut, last)]


def _suffix_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> intervals of repeats; a suffix array covers whole anchors."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        held.sort(key=lambda r: (r[2], r[3], r[4]))
        found = repeated_windows([r[1] for r in held], np.array([r[5] for r in held], np.int64)) if held else []
        rows = [(held[i][2], held[i][3], held[i][4] + a, held[i][4] + b) for i, a, b in found]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["id", "tid", "start", "stop"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "content", "id", "tid", "pos", "n")]):
            if size >= CHUNK and row[0] != last:
                yield flush()
                size = 0
            held.append(row)
            size += len(row[1])
            last = row[0]
    yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of runs one by one, by hash of content."""
    for batch in batches:
        keys, ids, tids = (batch.column(c).to_numpy() for c in ("anchor", "id", "tid"))
        pos, n = batch.column("pos").to_numpy(), batch.column("n").to_numpy()
        out = []
        for content, k in zip(batch.column("content").to_pylist(), n.tolist()):
            data = np.frombuffer(content, np.uint8)
            up, down = powers(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
                out.append(mix((total[LENGTH:] - total[:-LENGTH]) * down[:k]).view(np.int64))
        if not out:
            continue
        at = np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        arrays = [pa.array(np.repeat(keys, n)), pa.array(np.concatenate(out)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(tids, n)), pa.array(at)]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "window", "id", "tid", "pos"])


def repeats(texts: DataFrame) -> DataFrame:
    """id, tid, start, stop: byte ranges of `keyed` texts that repeat an earlier text, which may overlap.

    Texts that equal an earlier one are not looked at as such; see `copies`.
    """
    spark = texts.sparkSession
    small_batches(spark)
    seen = texts.mapInArrow(_anchors, "anchor long, tid long, twice boolean")
    shared = (
        seen.groupBy("anchor")
        .agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.max("twice").alias("twice"))
        .where((F.col("a") != F.col("b")) | F.col("twice")).select("anchor")
    )
    table = small_filter(written(shared, "shared_anchors"), "anchor")
    found = texts.mapInArrow(_contents(spark.sparkContext.broadcast(table)), "anchor long, content binary, id long, tid long, pos long, n long, twice boolean")
    found = written(found, "runs")
    # Two hashes of 64 bits and the length identify a content.
    same = ["anchor", "hash", "n"]
    found = found.withColumn("hash", F.xxhash64("content"))
    firsts = found.groupBy(*same).agg(F.min(F.struct("id", "tid", "pos", "content", "twice")).alias("first"))
    firsts = written(firsts.select(*same, "first.*"), "contents")

    early = firsts.select(*same, F.struct("id", "tid", "pos").alias("early"))
    later = found.select(*same, "id", "tid", "pos").join(early, same).where(F.struct("id", "tid", "pos") != F.col("early"))
    later = later.select("id", "tid", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + LENGTH - 1).alias("stop"))

    sizes = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.sum(F.octet_length("content")).alias("bytes"), F.max("twice").alias("any_twice"))
    tagged = firsts.join(sizes.where((F.col("contents") > 1) | F.col("any_twice")), "anchor")
    cold = tagged.where(F.col("bytes") <= HOT).select("anchor", "content", "id", "tid", "pos", "n")
    sorted_ = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_suffix_arrays, "id long, tid long, start long, stop long")

    hot = tagged.where(F.col("bytes") > HOT).select("anchor", "content", "id", "tid", "pos", "n")
    one = hot.mapInArrow(_windows, "anchor long, window long, id long, tid long, pos long")
    met = one.groupBy("anchor", "window").agg(F.min(F.struct("id", "tid", "pos")).alias("early"), F.count(F.lit(1)).alias("times")).where("times > 1")
    dealt = one.join(met, ["anchor", "window"]).where(F.struct("id", "tid", "pos") != F.col("early"))
    dealt = dealt.select("id", "tid", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("stop"))
    return later.unionByName(sorted_).unionByName(dealt)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their ranges -> what is left."""
    for b in batches:
        rows = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            kept, at, removed, n_spans, reach = [], 0, 0, 0, -1
            for s in sorted((x["start"], x["stop"]) for x in spans or []):
                if s[0] > reach:
                    n_spans += 1
                    kept.append(data[at : s[0]])
                    removed += s[1] - s[0]
                    reach = at = s[1]
                elif s[1] > reach:
                    removed += s[1] - reach
                    reach = at = s[1]
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((removed, n_spans, hashlib.sha256(rest).hexdigest(), rest))
        arrays = [b.column("id"), b.column("tid"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "tid", "n_removed", "n_spans", "kept_sha256", "kept"])


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges of each text joined where they touch or overlap, so that a text has few."""
    w = Window.partitionBy("id", "tid").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    run = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("_fresh", fresh).withColumn("_run", run).groupBy("id", "tid", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def cut_texts(texts: DataFrame) -> DataFrame:
    """id, tid, n_removed, n_spans, kept_sha256, kept (bytes) of the `keyed` texts that hold repeats."""
    ranges = written(merged(repeats(texts)), "ranges")
    by_text = ranges.groupBy("id", "tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # Few texts hold repeats: a filter of bounded size keeps most others out of the shuffle.
    key = F.xxhash64("id", "tid")
    table = small_filter(ranges.select(key.alias("key")).distinct(), "key")
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def may_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = passes(sent.value, b.column("key").to_numpy().view(np.uint64))
            yield b.filter(pa.array(ok)).select(["id", "tid", "text"])

    some = texts.select("id", "tid", "text", key.alias("key")).mapInArrow(may_hold, "id long, tid long, text string")
    cut = some.join(by_text, ["id", "tid"]).mapInArrow(_cut, "id long, tid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = keyed(docs)
    rows = texts.select("id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    rows = rows.groupBy("id", "tid", "n_bytes", "whole").agg(F.count(F.lit(1)).alias("times"))
    firsts = rows.groupBy("whole").agg(F.min("id").alias("first"))
    # One row of the first document is the original; all other rows of the text are copies.
    numbered = rows.join(firsts, "whole").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    copy = (F.col("n_bytes") >= LENGTH) & ((F.col("id") != F.col("first")) | (F.col("k") > 1))
    cut = cut_texts(texts).drop("kept").groupBy("id", "tid").agg(*[F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")])
    joined = numbered.join(cut, ["id", "tid"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.nullif("id", F.lit(NULL_ID)).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tid"), pa.array(kept, pa.string())], ["id", "tid", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) with repeats cut out of text, and n_chars, if present, counted anew.

    Of equal texts of LENGTH bytes or more one row stays. Rows whose text has repeats and of which only blanks are
    left go. A character that a cut splits is dropped. Rows without repeats stay as they are.
    """
    texts = keyed(docs)
    # The row travels as one struct, so its columns clash with none of these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"))
    # Copies: rows of a long text beyond its first document, and repeated rows of that document.
    slim = texts.select("id", "tid", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("whole")).where(F.col("n_bytes") >= LENGTH)
    counted = slim.groupBy("id", "tid", "whole").agg(F.count(F.lit(1)).alias("times"))
    firsts = counted.groupBy("whole").agg(F.min("id").alias("first"))
    copies = written(counted.join(firsts, "whole").where((F.col("id") != F.col("first")) | (F.col("times") > 1)).select("id", "tid", (F.col("id") != F.col("first")).alias("is_copy")), "copies")
    cut = cut_texts(texts).select("id", "tid", "kept").dropDuplicates(["id", "tid"])
    cut = written(cut.mapInArrow(_decode, "id long, tid long, kept string"), "cut")
    left = rows.join(copies.where("is_copy"), ["id", "tid"], "left_anti").join(copies.where("not is_copy").withColumn("twice", F.lit(True)).drop("is_copy"), ["id", "tid"], "left")
    left = left.where("twice IS NULL").unionByName(left.where("twice").dropDuplicates(["id", "tid"]))
    joined = left.join(cut, ["id", "tid"], "left").where(F.col("kept").isNull() | F.col("kept").rlike(r"\S"))

    def column(c: str) -> F.Column:
        if c == "text":
            return F.coalesce("kept", F.col("row")["text"]).alias(c)
        if c == "n_chars":
            return F.when(F.col("kept").isNull(), F.col("row")[c]).otherwise(F.length("kept")).cast(docs.schema[c].dataType).alias(c)
        return F.col("row")[c].alias(c)

    return joined.select(*[column(c) for c in docs.columns])


def op9_suffix_dedup(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows from every window of LENGTH bytes, in hexadecimal; texts are cut into stretches first, since substr walks from their start.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, start, substr(h, 2 * start + 1, 1198) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99, 500)) AS start FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, start + j AS i, substr(x, 2 * j + 1, 200) AS s FROM (SELECT doc_id, start, x, unnest(range(0, least(500, CAST(length(x) / 2 AS BIGINT) - 99))) AS j FROM c)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT *, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run), t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q FROM s),
k AS (SELECT t.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * q + 1, 2 * (a - q)), '' ORDER BY a) AS head FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
