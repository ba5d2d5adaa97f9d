"""Phrase search over an inverted index of positional trigrams.

Texts are split into ranges of rows of about RANGE_CHARS characters (a longer row is a range of its own). Of every range and field, and of every trigram that occurs in
it, the index holds where it stands: offsets into the range, as differences of one to five bytes. Rows are kept apart by
a gap, so no phrase runs from one into the next. The index is a Parquet table in folders by a hash of the trigram; a search
reads only the folders, and of these the row groups, of its own trigrams. A phrase is where its trigrams stand one after
another: the rarest list is read first, and the others only keep or drop its places.

Case is folded. Null texts are empty; phrases of fewer than three characters have no trigram and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.relations import best_per_key
from larkspur.operators.retrieval import FIELD_WEIGHTS, phrase_scores
from larkspur.sources.shared import written

GRAM = 3
#: Folders of the index; rows and their lengths are in one of their own.
BUCKETS = 32
ROWS = -1
RANGE_CHARS = 1 << 20
#: Phrases of one search; more are a matter of several searches.
MOST_PHRASES = 1000


@dataclass
class Index:
    """A written index: its table, the name of the key, the fields' weights, and what is known of all rows."""

    table: DataFrame
    key: str
    weights: dict[str, float]
    totals: dict[str, float]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams(points: np.ndarray) -> np.ndarray:
    """Every run of three code points as one number; 21 bits hold a code point."""
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:] if len(points) >= GRAM else np.zeros(0, np.int64)


def bucket(gram: np.ndarray) -> np.ndarray:
    return ((gram ^ (gram >> 21) * 31 ^ (gram >> 42) * 131) % BUCKETS).astype(np.int32)


def pack(differences: np.ndarray) -> bytes:
    """Whole numbers in bytes of seven bits, the low ones first; the high bit says that another follows."""
    x = differences.astype(np.uint64)
    sizes = np.ones(len(x), np.int64)
    for i in range(1, 5):
        sizes += x >= np.uint64(1 << (7 * i))
    out, start = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    for i in range(5):
        own = sizes > i
        out[start[own] + i] = ((x[own] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | np.where(sizes[own] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def packed_lists(places: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists of places, which begin at `first`, each packed by itself: all in one pass."""
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    sizes = np.ones(len(steps), np.int64)
    for i in range(1, 5):
        sizes += steps >= 1 << (7 * i)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    offsets = np.append(ends[first], ends[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(pack(steps))])


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for i in range(5):
        own = starts + i <= ends
        out[own] |= (raw[starts[own] + i] & 127).astype(np.int64) << (7 * i)
    return out


def build_index(chunks: DataFrame, key: str, weights: dict[str, float] = FIELD_WEIGHTS) -> Index:
    """Index of the fields of chunks that weights names. Each task writes its own ranges; nothing is shuffled."""
    fields = list(weights)
    kind = chunks.schema[key].dataType
    parts = [("bucket", T.IntegerType()), ("field", T.IntegerType()), ("gram", T.LongType()), ("range", T.LongType()), ("n", T.IntegerType()), ("places", T.BinaryType()), ("at", T.IntegerType()), ("start", T.LongType()), ("key", kind)]
    schema = T.StructType([T.StructField(n, t) for n, t in parts + [(f"len_{f}", T.IntegerType()) for f in fields]])
    arrow = T.StructType(schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, part = to_arrow_schema(arrow), TaskContext.get().partitionId() << 32

        def batch(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in shape], schema=shape)

        def ranges() -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = sum(np.array(pc.fill_null(pc.utf8_length(b.column(f)), 0)) for f in fields)
                group = np.cumsum(size) // RANGE_CHARS
                edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
                yield from (b.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:]) if hi > lo)

        for number, b in enumerate(ranges()):
            range_id, lengths, starts = part + number, {}, {}
            for i, f in enumerate(fields):
                texts = [codes(t or "") for t in b.column(f).to_pylist()]
                lengths[f] = np.array([len(t) for t in texts])
                starts[f] = np.cumsum(lengths[f] + GRAM) - lengths[f] - GRAM
                flat = np.full(int(lengths[f].sum() + GRAM * len(texts)), -1, np.int64)
                for s, t in zip(starts[f], texts):
                    flat[s : s + len(t)] = t
                found = grams(flat)
                whole = np.flatnonzero((flat[:-2] >= 0) & (flat[1:-1] >= 0) & (flat[2:] >= 0)) if len(flat) >= GRAM else np.zeros(0, np.int64)
                order = np.argsort(found[whole], kind="stable")
                places, sorted_grams = whole[order], found[whole][order]
                first = np.flatnonzero(np.diff(sorted_grams, prepend=-1))
                names, counts = sorted_grams[first], np.diff(np.append(first, len(places)))
                yield batch(len(names), bucket=pa.array(bucket(names)), field=pa.array(np.full(len(names), i, np.int32)), gram=pa.array(names), range=pa.array(np.full(len(names), range_id)), n=pa.array(counts), places=packed_lists(places, first))
            rows = {f"len_{f}": pa.array(np.maximum(lengths[f] - GRAM + 1, 0)) for f in fields}
            # where a row begins in each field, one row for each
            for i, f in enumerate(fields):
                more = rows if i == 0 else {}
                yield batch(b.num_rows, bucket=pa.array(np.full(b.num_rows, ROWS, np.int32)), field=pa.array(np.full(b.num_rows, i, np.int32)), range=pa.array(np.full(b.num_rows, range_id)), at=pa.array(np.arange(b.num_rows, dtype=np.int32)), start=pa.array(starts[f]), key=b.column(key), **more)

    table = written(chunks.select(key, *fields).mapInArrow(run, schema), "phrase_index", ["bucket"])
    first = table.where((F.col("bucket") == ROWS) & (F.col("field") == 0))
    totals = first.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f"mean_{f}") for f in fields]).first().asDict()
    return Index(table, key, dict(weights), totals)


def phrase_counts(index: Index, phrases: list[str]) -> DataFrame:
    """key, phrase, len_ and tf_ of every field, of the rows that hold a phrase; occurrences of a phrase do not overlap."""
    asked = list(dict.fromkeys(p.lower() for p in phrases))
    if any(len(p) < GRAM for p in asked) or len(asked) > MOST_PHRASES:
        raise ValueError(f"a search takes up to {MOST_PHRASES} phrases of {GRAM} characters or more")
    wanted = [grams(codes(p)) for p in asked]
    every = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
    lists = index.table.where(F.col("bucket").isin(np.unique(bucket(every)).tolist()) & F.col("gram").isin(every.tolist())).select("range", "field", "gram", "n", "places")
    starts = index.table.where(F.col("bucket") == ROWS).select(F.col("range").alias("of_range"), F.col("field").alias("of_field"), "start", "at")
    out = "range long, field int, at int, phrase string, tf int"

    def meet(key, tables: pa.Table, rows: pa.Table) -> pa.Table:
        """Phrases of one range and field."""
        by = np.argsort(rows["start"].to_numpy())
        begin, at = rows["start"].to_numpy()[by], rows["at"].to_numpy()[by]
        packed = dict(zip(tables["gram"].to_pylist(), zip(tables["n"].to_pylist(), tables["places"].to_pylist())))
        opened: dict[int, np.ndarray] = {}
        found: list[tuple] = []
        for phrase, own in zip(asked, wanted):
            if not all(g in packed for g in own.tolist()):
                continue
            places = None
            for i in sorted(range(len(own)), key=lambda i: packed[int(own[i])][0]):  # rarest first
                g = int(own[i])
                if g not in opened:
                    opened[g] = np.cumsum(unpack(packed[g][1]))
                here = opened[g] - i
                if places is None:
                    places = here
                else:
                    near = np.minimum(np.searchsorted(here, places), len(here) - 1)
                    places = places[here[near] == places]
                if not len(places):
                    break
            if len(places) > 1 and np.diff(places).min() < len(own) + GRAM - 1:  # the phrase overlaps itself
                kept, end = [], -1
                for x in places.tolist():
                    if x >= end:
                        kept.append(x)
                        end = x + len(own) + GRAM - 1
                places = np.array(kept)
            row, times = np.unique(np.searchsorted(begin, places, "right") - 1, return_counts=True)
            found += [(*(k.as_py() for k in key), int(at[r]), phrase, int(n)) for r, n in zip(row, times)]
        columns = list(zip(*found)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()))], ["range", "field", "at", "phrase", "tf"])

    held = lists.select(F.col("range").alias("of_range"), F.col("field").alias("of_field")).distinct()
    starts = starts.join(held, ["of_range", "of_field"], "left_semi")
    hits = lists.groupBy("range", "field").cogroup(starts.groupBy("of_range", "of_field")).applyInArrow(meet, out)
    fields = list(index.weights)
    times = hits.groupBy("range", "at", "phrase").agg(*[F.coalesce(F.sum(F.when(F.col("field") == i, F.col("tf"))), F.lit(0)).cast("int").alias(f"tf_{f}") for i, f in enumerate(fields)])
    rows = index.table.where((F.col("bucket") == ROWS) & (F.col("field") == 0)).select("range", "at", F.col("key").alias(index.key), *[f"len_{f}" for f in fields])
    return times.join(rows, ["range", "at"]).select(index.key, "phrase", *[f"len_{f}" for f in fields], *[f"tf_{f}" for f in fields])


def search(index: Index, phrases: list[str]) -> DataFrame:
    """key, phrase, score of the rows that hold a phrase; the scores of `retrieval.phrase_bm25`."""
    return phrase_scores(phrase_counts(index, phrases), index.key, index.weights, index.totals)


def evidence_rounds(index: Index, questions: DataFrame, terms: dict[str, list[str]], k: int) -> tuple[DataFrame, DataFrame]:
    """Evidence (question, round, key, score) found in one round or two, and status (question, missing, status).

    questions: question, phrase, aspects (array). The k best rows of the phrase are the first round. An aspect is answered if
    a row found holds one of its terms; questions with aspects that are not are asked once more, for the terms of
    these aspects, and only for them. A question is complete, or partial if its second round leaves an aspect open.
    """
    key = index.key
    asked = questions.select("question", F.lower("phrase").alias("phrase"), "aspects")
    phrases = [r["phrase"] for r in asked.select("phrase").distinct().limit(MOST_PHRASES + 1).collect()]  # a bounded search
    first = search(index, phrases).join(asked, "phrase").select("question", key, "score")
    first = written(best_per_key(first, ["question"], [F.desc("score"), F.col(key)], k), "first_round")
    named = questions.sparkSession.createDataFrame([(a, t.lower()) for a, own in terms.items() for t in own], "aspect string, phrase string")
    held = written(search(index, [t for own in terms.values() for t in own]).join(F.broadcast(named), "phrase").groupBy("aspect", key).agg(F.max("score").alias("score")), "aspect_rows")  # as many terms as the plan has
    wanted = asked.select("question", F.explode("aspects").alias("aspect")).distinct()

    def open_aspects(evidence: DataFrame) -> DataFrame:
        answered = evidence.select("question", key).join(held.select("aspect", key), key).select("question", "aspect").distinct()
        return wanted.join(answered, ["question", "aspect"], "left_anti")

    missing = written(open_aspects(first), "open_aspects")
    again = missing.join(held, "aspect").groupBy("question", key).agg(F.max("score").alias("score"))
    again = again.join(first.select("question", key), ["question", key], "left_anti")
    second = best_per_key(again, ["question"], [F.desc("score"), F.col(key)], k)
    evidence = written(first.select("question", F.lit(1).alias("round"), key, "score").unionByName(second.select("question", F.lit(2).alias("round"), key, "score")), "evidence")
    still = open_aspects(evidence).groupBy("question").agg(F.array_sort(F.collect_list("aspect")).alias("missing"))
    status = asked.select("question").distinct().join(still, "question", "left").select("question", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.when(F.col("missing").isNull(), "complete").otherwise("partial").alias("status"))
    return evidence, status
