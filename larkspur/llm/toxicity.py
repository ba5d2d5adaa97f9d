"""Toxicity: cumulative-link ordinal regression over sparse text features.

Severity grades are 0 (not toxic), 1 and 2, as labels give them: where they only tell toxic or not, and good or bad
quality, toxic documents of bad quality are of grade 2. No grade is made from the features. One weight vector over hashed words and stems is
shared by all thresholds: P(grade >= k) = sigmoid(score - threshold_k), with thresholds kept in order. The
output is the expected severity, the sum of these probabilities.

The classifier is fitted on at most about `max_docs` labelled rows, chosen by a hash of doc_id; scoring
reads every document whole.

Edge cases: null or wordless text scores by the thresholds alone (the base rate); labels that are null are
not learned from; without labelled rows, or with one class only, every document gets severity 0; repeated
rows score alike, and equal severities stay ties, as nothing ranks documents; a text of any length is read whole, as one slice; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import PUNCTUATION, folded_bytes, slices, words
from larkspur.llm.scratch import small_batches

BITS = 20
BUCKETS = 1 << BITS
#: Word beginnings of so many bytes are features besides the words.
STEMS = (4, 6)
GRADES = 3


def featurise(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of rows: distinct buckets of the words and stems of all its rows, and each row's range of them."""
    _, data, offsets = folded_bytes(column)
    for a, b in slices(offsets):
        keys = []
        for cut in (None, *STEMS):
            h, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1], PUNCTUATION, cut)
            row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(bounds))
            with np.errstate(over="ignore"):
                at = (h * np.uint64(2 * (cut or 0) + 1)) >> np.uint64(64 - BITS)
            keys.append(np.unique(row * BUCKETS + at.astype(np.int64)))
        key = np.unique(np.concatenate(keys))
        yield key % BUCKETS, np.searchsorted(key // BUCKETS, np.arange(b - a + 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [x[i:j] for x, at in featurise(b.column("text")) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(lists, pa.list_(pa.int32()))], ["grade", "buckets"])


def fit(docs: DataFrame, grades: DataFrame, max_docs: int = 12_000, steps: int = 400, ridge: float = 1e-5, rate: float = 0.1, least_docs: int = 5, least_z: float = 5.0, max_features: int = 20_000) -> dict:
    """Weights and ordered thresholds from docs (doc_id, text) and grades (doc_id, grade), by full-batch Adam.

    Features that fewer than `least_docs` sampled documents hold, or whose share among toxic documents lies
    less than `least_z` standard errors from their share among all, are left out; the `max_features` most telling stay.
    """
    small_batches(docs.sparkSession)
    known = grades.where(F.col("grade").isNotNull())
    share = int(min(1.0, max_docs / max(known.count(), 1)) * (1 << 20))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("doc_id", F.col("grade").cast("int"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")  # chosen: max_docs rows
    n, n_bad = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    if not 0 < n_bad < n:
        return {"at": np.zeros(0, np.int64), "weights": np.zeros(0), "thresholds": None}
    # Rare features would let the model learn its documents by heart: keep those that tell the classes apart.
    counted = (
        sample.mapInArrow(_features, "grade int, buckets array<int>")
        .select("grade", F.explode("buckets").alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.sum((F.col("grade") > 0).cast("int")).alias("bad"))
    )
    share = F.col("df") / n
    z = (F.col("bad") / n_bad - share) / F.sqrt(share * (1 - share) / n_bad + 1e-12)
    telling = counted.where(F.col("df") >= least_docs).select("bucket", z.alias("z")).where(F.abs("z") >= least_z)
    telling = telling.orderBy(F.desc(F.abs("z")), "bucket").limit(max_features).toArrow()  # at most max_features rows
    order = np.argsort(telling["bucket"].to_numpy())
    seen, z = telling["bucket"].to_numpy()[order].astype(np.int64), telling["z"].to_numpy()[order]
    m = len(seen)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _features(batches):
            lists = [np.flatnonzero(np.isin(seen, x)) for x in b.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(lists, pa.list_(pa.int32()))], ["grade", "features"])

    got = sample.mapInArrow(told, "grade int, features array<int>").toArrow()  # max_docs rows of few features
    y = got["grade"].to_numpy()
    lists = got["features"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    col, doc = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(y)), sizes)
    levels = np.arange(1, GRADES)
    target = y[:, None] >= levels
    rest = np.maximum(target.mean(axis=0), 1e-3)
    # parameters: weights, first threshold, logarithms of the gaps between thresholds
    first = np.log((1 - rest) / rest)
    p = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        gaps = np.exp(p[m + 1 :])
        theta = p[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(doc, p[col], len(y))
        q = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30)))
        err = (q - target) / len(y)
        by_doc, by_level = err.sum(axis=1), -err.sum(axis=0)
        tail = np.cumsum(by_level[::-1])[::-1]
        g = np.concatenate([np.bincount(col, by_doc[doc], m) + ridge * p[:m], [by_level.sum()], tail[1:] * gaps])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    theta = p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])
    return {"at": seen, "weights": p[:m], "thresholds": theta}


def severity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, severity (expected grade), toxic_prob (P(grade >= 1)) and toxic for every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weight = np.zeros(BUCKETS)
        weight[m["at"]] = m["weights"]
        for b in batches:
            scores = [np.diff(np.concatenate([[0.0], np.cumsum(weight[x])])[at]) for x, at in featurise(b.column("text"))]
            s = np.concatenate(scores) if scores else np.zeros(0)
            q = np.zeros((len(s), GRADES - 1)) if m["thresholds"] is None else 1 / (1 + np.exp(-np.clip(s[:, None] - m["thresholds"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q.sum(axis=1)), pa.array(q[:, 0]), pa.array(q[:, 0] >= 0.5)], ["doc_id", "severity", "toxic_prob", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, toxic_prob double, toxic boolean")


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = F.col("toxic") * F.when(F.col("quality") == 0, 2).otherwise(1)
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(graded).alias("grade"))
    return severity(docs, fit(docs, known))
