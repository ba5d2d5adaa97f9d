r"""Lines that many documents share, kept in one document only.

A line's key is the line without white space (`[\x20\x09-\x0D]`) at its ends, A-Z in lower case. A key of at least
`min_chars` code points that at least `min_docs` documents hold loses all its lines but those of one document, the
one with the largest doc_id.

1. Every task marks the key hashes of its documents in two Bloom filters: bits set once, and bits set again. Merging two
   tasks sets "again" where both have set "once", so a key of two documents always has all its bits in the second filter.
   Tasks send compressed segments of both filters, which are merged segment by segment; only the second filter, of
   FILTER_WORDS words at most, is gathered.
2. Keys that pass the second filter are suspected repeats. Each task sends such a key once, whole, with its few largest
   doc_ids; grouping by the key itself confirms or clears it, so hash collisions cost rows, not results.
3. Confirmed keys of up to BROADCAST_BYTES go to all tasks, which cut their own texts. Beyond that, a filter of the
   confirmed keys picks the lines that are joined with them by key, and the lines to drop are joined with the texts.

Edge cases: null and empty texts are one empty line; a line of blanks has an empty key; a very long text is one row, held
whole by its task; rows that share a doc_id are one document, so all of them keep their lines if it is the largest, and
each of them is returned; rows without doc_id are one document that is smaller than any other; a text without line ends is
one line; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.filters import FILTER_WORDS, SEGMENTS, _probe, _word, passes, small_filter
from larkspur.llm.scratch import small_batches, written

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stands for a missing doc_id, and comes before all others.
NO_ID = -(1 << 63)
#: Bytes of keys that a task holds before it sends them on.
HELD_BYTES = 32 << 20
#: Bytes of confirmed keys that are sent to all tasks.
BROADCAST_BYTES = 8 << 20
#: Partial rows of a key are merged in this many groups before they meet.
SALTS = 32


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: bytes | None, least: int) -> set[bytes]:
    if text is None or len(text) < least:
        return set()
    return {k for k in map(line_key, text.split(b"\n")) if _long_enough(k, least)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))


def twice_seen(source: DataFrame, least: int, words: int = FILTER_WORDS) -> np.ndarray:
    """The second filter: every key that two rows hold has all its bits set in it."""
    segment = max(1, words // SEGMENTS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for b in batches:
            found: list[bytes] = []
            for text in b.column("text").to_pylist():
                found.extend(_keys(text, least))  # a document counts once
            key, times = np.unique(_hashes(found), return_counts=True)
            word, bits = _word(key, words), _probe(key)
            np.bitwise_or.at(twice, word, once[word] & bits)
            np.bitwise_or.at(twice, word[times > 1], bits[times > 1])
            np.bitwise_or.at(once, word, bits)
        used = np.unique(np.flatnonzero(once) // segment)
        pack = lambda x, s: pa.compress(x[s * segment : (s + 1) * segment].tobytes(), codec="lz4", asbytes=True)
        for lo in range(0, len(used), 16):
            part = used[lo : lo + 16]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([pack(once, s) for s in part], pa.binary()), pa.array([pack(twice, s) for s in part], pa.binary())], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, list[np.ndarray]] = {}  # as large as both filters at most
        for b in batches:
            for s, *packed in zip(*(b.column(i).to_pylist() for i in range(3))):
                once, twice = (np.frombuffer(pa.decompress(x, 8 * segment, codec="lz4", asbytes=True), np.uint64) for x in packed)
                if s in merged:
                    merged[s][1] |= twice | (merged[s][0] & once)
                    merged[s][0] |= once
                else:
                    merged[s] = [once.copy(), twice.copy()]
        bits = [pa.compress(x[1].tobytes(), codec="lz4", asbytes=True) for x in merged.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array(bits, pa.binary())], ["segment", "bits"])

    marked = source.select("text").mapInArrow(mark, "segment int, once binary, twice binary")
    made = marked.repartition("segment").mapInArrow(merge, "segment int, bits binary").toArrow()  # the filter, of bounded size
    out = np.zeros((words // segment, segment), np.uint64)
    for s, bits in zip(made["segment"].to_pylist(), made["bits"].to_pylist()):
        out[s] = np.frombuffer(pa.decompress(bits, 8 * segment, codec="lz4", asbytes=True), np.uint64)
    return out.ravel()


def repeated_keys(source: DataFrame, least: int, min_docs: int, words: int = FILTER_WORDS) -> DataFrame:
    """key, keeper: the keys that at least min_docs documents hold, and the largest of these documents."""
    sent = source.sparkSession.sparkContext.broadcast(twice_seen(source, least, words))  # FILTER_WORDS words at most

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        held: dict[bytes, list[int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["key", "docs"])

        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                keys = list(_keys(text, least))
                if not keys:
                    continue
                for i in np.flatnonzero(passes(table, _hashes(keys))).tolist():
                    docs = held.get(keys[i])
                    if docs is None:
                        held[keys[i]] = [doc]
                        size += len(keys[i]) + 8 * min_docs + 64
                    elif doc not in docs:
                        docs.append(doc)
                        if len(docs) > min_docs:
                            docs.remove(min(docs))
                if size > HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
        yield flush()

    def largest(c: str) -> Column:
        """The min_docs largest of the lists of doc_ids."""
        return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))), asc=False), 1, min_docs)

    partial = source.mapInArrow(suspect, "key binary, docs array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merged = partial.groupBy("key", "salt").agg(largest("docs").alias("docs")).groupBy("key").agg(largest("docs").alias("docs"))
    return merged.where(F.size("docs") >= min_docs).select("key", F.get("docs", F.lit(0)).alias("keeper"))


def _cut(batches: Iterator[pa.RecordBatch], gone: Callable[[int, bytes, list[bytes]], list[int] | None]) -> Iterator[pa.RecordBatch]:
    """kept, n_lines and n_dropped of texts, without the lines that `gone` numbers."""
    for b in batches:
        kept, n_lines, n_dropped = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            lines = (text or b"").split(b"\n")
            out = set(gone(b, i, lines))
            kept.append(text or b"" if not out else b"\n".join(x for j, x in enumerate(lines) if j not in out))
            n_lines.append(len(lines))
            n_dropped.append(len(out))
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc", "kept", "n_lines", "n_dropped"])


CUT = "doc long, kept binary, n_lines long, n_dropped long"


def _cut_in_place(source: DataFrame, keepers: dict[bytes, int]) -> DataFrame:
    sent = source.sparkSession.sparkContext.broadcast(keepers)  # BROADCAST_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = sent.value

        def gone(b: pa.RecordBatch, i: int, lines: list[bytes]) -> list[int]:
            doc = b.column("doc")[i].as_py()
            return [j for j, line in enumerate(lines) if keeper.get(line_key(line), doc) != doc]

        return _cut(batches, gone)

    return source.mapInArrow(run, CUT)


def _cut_by_join(source: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The same by joins: lines that pass a filter of the confirmed keys meet these, what goes meets the texts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column("key").to_pylist()).view(np.int64))], ["h"])

    sent = source.sparkSession.sparkContext.broadcast(small_filter(confirmed.select("key").mapInArrow(hashed, "h long"), "h"))  # FILTER_WORDS words at most

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            rows: list[tuple[int, int, bytes, int]] = []
            for doc, at, text in zip(*(b.column(x).to_pylist() for x in ("doc", "at", "text"))):
                keys = [line_key(x) for x in (text or b"").split(b"\n")]
                rows.extend((doc, at, keys[j], j) for j in np.flatnonzero(passes(table, _hashes(keys))).tolist())
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["doc", "at", "key", "line"])

    placed = source.withColumn("at", F.xxhash64("doc", "text"))  # rows with equal doc and text lose the same lines
    asked = placed.mapInArrow(ask, "doc long, at long, key binary, line int")
    gone = asked.join(confirmed, "key").where("doc != keeper").groupBy("doc", "at").agg(F.collect_set("line").alias("gone"))
    both = placed.join(gone, ["doc", "at"], "left").select("doc", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    return both.mapInArrow(lambda batches: _cut(batches, lambda b, i, lines: b.column("gone")[i].as_py()), CUT)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, words: int = FILTER_WORDS) -> DataFrame:
    """doc_id, kept_text, n_lines (before), n_dropped for every row of docs (doc_id, text)."""
    if min_docs < 2 or min_chars < 1:
        raise ValueError("a repeated line has at least one code point and two documents")
    small_batches(docs.sparkSession)
    source = _source(docs)
    confirmed = written(repeated_keys(source, min_chars, min_docs, words), "repeated_lines")
    size = confirmed.agg(F.coalesce(F.sum(F.octet_length("key") + F.lit(64)), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        found = confirmed.toArrow()
        cut = _cut_in_place(source, dict(zip(found["key"].to_pylist(), found["keeper"].to_pylist())))
    else:
        cut = _cut_by_join(source, confirmed)
    return cut.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped")


def op13_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: A line's place within its document is that of its part; parts are joined again in this order.
ORACLE = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed k LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""
