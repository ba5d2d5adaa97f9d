r"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

Terms are runs of ASCII letters, digits and any other non-ASCII characters, A-Z in lower case. A document's score for an
item is the sum, over the item's distinct terms, of weight * ((1000000000 * tf) div (1000 * tf + 8 * m)), where m grows with
the document's length in relation to the mean; see `weight` and `Shard`. All scores are exact integers.

1. Each task turns its documents into shards of an inverted index, restricted to the terms that are asked for: sorted
   doc_ids, lengths, and per term the ordinals and frequencies of the documents that hold it. The shards are written once to
   the shared folder; counts of documents, of terms and of documents per term are sums over them.
2. Every shard answers every item. Its short posting lists are summed term at a time into accumulators, at most
   ACCUMULATORS of them. The accumulators then act as one more posting list, bounded by their greatest sum, and their k-th
   sum is a first threshold. Document-at-a-time scoring runs over this list and the long ones: lists whose bounds together
   stay below the threshold bring no candidates and are only probed for the candidates of the others, longest bound first.
3. The k best of each shard and item are ranked over all shards.

The items are a stated query set; they are worked off in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters
(a longer item is a block of its own), so what is sent to the tasks is bounded.

Edge cases: null texts, and texts without a term, are neither counted nor ranked; a very long text is counted piece by piece;
rows that share a doc_id are documents of their own; equal scores go by ascending doc_id, a null doc_id last; rows that
share an item_id are one item with the terms of all, and so are those without item_id; items without terms, or with terms
that no document holds, have no rows; empty tables give no rows; other columns of both tables are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.scratch import small_batches, written

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text that are cut into terms at a time; a term is never cut.
PIECE_BYTES = 1 << 20
#: Documents and postings of a shard, at most; the ordinals of its documents fit 16 bits.
SHARD_DOCS = 1 << 16
SHARD_POSTINGS = 1 << 21
#: Postings of short lists that are summed up front, for each item and shard.
ACCUMULATORS = 4096
#: Ordinals that document-at-a-time scoring takes together at first; the span doubles as the threshold rises.
FIRST_SPAN = 256
BLOCK_ITEMS = 4096
BLOCK_CHARS = 1 << 25

INDEX = "doc_ids array<long>, lengths array<long>, terms array<int>, counts array<int>, ordinals binary, tfs binary"


def pieces_of(text: bytes) -> Iterator[bytes]:
    """The text in lower case, in pieces that end where a term ends."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        gap = GAP.search(text, start + PIECE_BYTES)
        stop = gap.end() if gap else len(text)
        yield text[start:stop].lower()
        start = stop
    yield text[start:].lower()


def counted(text: bytes | None) -> Counter:
    """How often each term occurs."""
    out: Counter = Counter()
    for piece in pieces_of(text or b""):
        out.update(TERM.findall(piece))
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def build_index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Shards of an inverted index of docs (doc_id, text) for the given terms, written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # the terms of a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        ids: list[int | None] = []
        lengths: list[int] = []
        term, doc, tf = array("i"), array("i"), array("q")

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            t, f = np.frombuffer(term, np.int32), np.minimum(np.frombuffer(tf, np.int64), (1 << 32) - 1)
            d = place[np.frombuffer(doc, np.int32)] if len(doc) else np.zeros(0, np.int64)
            by = np.lexsort((d, t))
            held, counts = np.unique(t, return_counts=True)
            row = [[ids[i] for i in order], [lengths[i] for i in order], held.tolist(), counts.tolist(), d[by].astype(np.uint16).tobytes(), f[by].astype(np.uint32).tobytes()]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["doc_ids", "lengths", "terms", "counts", "ordinals", "tfs"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = counted(text)
                if not found:
                    continue
                for x, times in found.items():
                    i = number.get(x)
                    if i is not None:
                        term.append(i)
                        doc.append(len(ids))
                        tf.append(times)
                ids.append(doc_id)
                lengths.append(found.total())
                if len(ids) == SHARD_DOCS or len(term) >= SHARD_POSTINGS:
                    yield flush()
                    ids, lengths = [], []
                    term, doc, tf = array("i"), array("i"), array("q")
        if ids:
            yield flush()

    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return written(source.mapInArrow(run, INDEX), "lexical_index")


class Postings:
    """A posting list, or the accumulators: ascending ordinals, their shares of the score, and the greatest share."""

    def __init__(self, docs: np.ndarray, shares: np.ndarray, bound: int, factor: int = 1):
        self.docs, self.shares, self.bound, self.factor = docs, shares, bound, factor

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.docs, (lo, hi))
        return self.docs[a:b], self.shares[a:b] * self.factor

    def first(self, lo: int, none: int) -> int:
        at = int(np.searchsorted(self.docs, lo))
        return int(self.docs[at]) if at < len(self.docs) else none

    def of(self, docs: np.ndarray) -> np.ndarray:
        """Shares of the given documents, 0 where the list skips over them."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.shares[at] * self.factor, 0)


def summed(docs: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ordinals, ascending, and the sums of their shares."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]][: len(docs)])
    return docs[starts], np.add.reduceat(shares[order], starts) if len(starts) else shares[:0]


class Shard:
    """A shard of the index, ready to be searched."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, ordinals: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        wide = lengths.astype(object) if 90 * int(lengths.max()) * n_docs >= 1 << 63 else lengths.astype(np.int64)
        m = (10 + (90 * wide * n_docs) // n_terms).astype(np.int64)
        tf = tfs.astype(np.int64)
        self.n, self.docs = len(lengths), ordinals.astype(np.int32)
        self.shares = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        stops = np.cumsum(counts)
        self.at = {t: (a, b) for t, a, b in zip(terms.tolist(), (stops - counts).tolist(), stops.tolist())}
        tops = np.maximum.reduceat(self.shares, stops - counts) if len(stops) else stops
        self.top = dict(zip(terms.tolist(), tops.tolist()))

    def search(self, asked: list[tuple[int, int]], k: int, accumulators: int = ACCUMULATORS, span: int = FIRST_SPAN) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and scores of the k best documents for (term, weight) pairs, best first, with scores above 0."""
        lists = sorted((self.at[t][1] - self.at[t][0], t, w) for t, w in asked if w > 0 and self.top.get(t, 0) > 0)
        short, room = 0, accumulators
        while short < len(lists) and lists[short][0] <= room:
            room -= lists[short][0]
            short += 1
        threshold, ranked = 0, []
        if short:  # term at a time
            parts = [(self.docs[slice(*self.at[t])], self.shares[slice(*self.at[t])] * w) for _, t, w in lists[:short]]
            docs, sums = summed(*map(np.concatenate, zip(*parts)))
            ranked.append(Postings(docs, sums, int(sums.max())))
            if len(sums) >= k:
                threshold = int(np.partition(sums, len(sums) - k)[len(sums) - k])
        for _, t, w in lists[short:]:
            ranked.append(Postings(self.docs[slice(*self.at[t])], self.shares[slice(*self.at[t])], w * self.top[t], w))
        ranked.sort(key=lambda x: x.bound)
        below = np.cumsum([0] + [x.bound for x in ranked]).tolist()  # what the first lists can add together
        best, best_score, at = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        while at < self.n:  # documents at a time
            probed = sum(x < threshold for x in below[1:])
            if probed == len(ranked):
                break
            at = min(x.first(at, self.n) for x in ranked[probed:])
            stop = min(at + span, self.n)
            docs, score = summed(*map(np.concatenate, zip(*(x.between(at, stop) for x in ranked[probed:]))))
            for i in range(probed, -1, -1):
                likely = score + below[i] >= threshold
                docs, score = docs[likely], score[likely]
                if i and len(docs):
                    score = score + ranked[i - 1].of(docs)
            docs, score = np.concatenate([best, docs]), np.concatenate([best_score, score])
            order = np.lexsort((docs, -score))[:k]
            best, best_score = docs[order], score[order]
            if len(best) == k:
                threshold = max(threshold, int(best_score[-1]))
            at, span = stop, span * 2
        return best[best_score > 0], best_score[best_score > 0]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for t in counted(text)]
            ids, terms = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "item_id long, term binary").distinct()


def _search_block(docs: DataFrame, asked: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    number = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    index = build_index(docs, number)
    spark = docs.sparkSession
    totals = index.agg(F.sum(F.size("lengths")).alias("n_docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_terms")).first()
    if not totals["n_docs"]:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    n_docs, n_terms = int(totals["n_docs"]), int(totals["n_terms"])
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum(F.col("x.counts").cast("long")).alias("df")).collect()  # a row for each term asked for
    weights = {r["terms"]: weight(n_docs, r["df"]) for r in held}
    plan = [(item, [(number[t], weights[number[t]]) for t in terms if number[t] in weights]) for item, terms in asked]
    sent = spark.sparkContext.broadcast(plan)  # the terms of a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("doc_ids")[r].values
                flat = [b.column(x)[r].values.to_numpy() for x in ("lengths", "terms", "counts")]
                packed = [np.frombuffer(b.column(x)[r].as_buffer(), kind) for x, kind in (("ordinals", np.uint16), ("tfs", np.uint32))]
                shard = Shard(*flat, *packed, n_docs, n_terms)
                items, at, scores = [], [], []
                for item, terms in sent.value:
                    docs_found, found = shard.search(terms, k)
                    items += [item] * len(found)
                    at.append(docs_found)
                    scores.append(found)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs (doc_id, text) for every item of items (item_id, text)."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    terms = written(item_terms(items).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), "item_terms")
    found = None
    for block in range(blocks):
        rows = terms.where(F.col("block") == block).toArrow()  # a block of items
        asked: dict[int | None, list[bytes]] = {}
        for item, term in zip(rows["item_id"].to_pylist(), rows["term"].to_pylist()):
            asked.setdefault(item, []).append(term)
        part = _search_block(docs, sorted(asked.items(), key=lambda x: (x[0] is None, x[0] or 0)), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op11_lexical_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH words AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
asked AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1), totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY 1),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10"""
