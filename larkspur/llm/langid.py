"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word falls back
to its character n-grams, longest first: each position takes the longest known n-gram that starts there.
A document's score is the sum over its words; the posterior of the best language is the confidence.

The classifier is fitted on a bounded sample of labelled rows (`max_docs`), counted by Spark, and keeps at
most `max_words` words and `max_grams` n-grams, so what is sent to the tasks has a fixed bound. Prediction
reads every document whole.

Edge cases: null text, or text without a letter, is `und` with score 0; without any labelled row all
documents are `und`; repeated rows are scored alike; ties between languages go to the smaller name; a text of any length is read whole, as
one slice; an empty table gives no rows; other columns pass through `identify`, and those named like a result column are
replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.kernels import HashIndex, code_points, per_character, slices, spans, sums, text_bytes
from larkspur.llm.scratch import small_batches, written

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
SMOOTH = 0.5
UNKNOWN = "und"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (gram false) and n-grams (gram true) of each language, counted within a task."""
    words: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
    for lang, counts in words.items():
        grams: Counter = Counter()
        for w, n in counts.items():
            s = f" {w} "
            for k in range(1, LONGEST + 1):
                for i in range(len(s) - k + 1):
                    grams[s[i : i + k]] += n
        for gram, found in ((False, counts), (True, grams)):
            arrays = [pa.array([lang] * len(found)), pa.array([gram] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "word", "n"])


def fit(labelled: DataFrame, max_docs: int = 5_000, max_words: int = 60_000, max_grams: int = 60_000) -> dict:
    """Word and n-gram log frequencies of each language, from (doc_id, text, lang) rows.

    About `max_docs` rows at most are counted, chosen by a hash of doc_id; the kept words and n-grams are
    the most frequent ones.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang").count()
    share = int(min(1.0, max_docs / max(n, 1)) * (1 << 20))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram boolean, word string, n long").groupBy("gram", "lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "langid_counts")

    totals: dict[bool, dict] = {False: {}, True: {}}
    for r in counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")).collect():
        totals[r["gram"]][r["lang"]] = r["n"]
    langs = sorted(totals[False])

    def table(gram: bool, limit: int) -> dict[str, np.ndarray]:
        """Log frequencies of the `limit` most frequent entries."""
        by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
        by_word = counts.where(F.col("gram") == gram).groupBy("word").agg(F.sum("n").alias("total"), *by_lang)
        kept = by_word.where("total >= 2").orderBy(F.desc("total"), "word").limit(limit).toArrow()  # at most `limit` rows
        n = np.stack([kept[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1) if langs else np.zeros((0, 0))
        size = np.array([totals[gram].get(x, 0) for x in langs], float)
        return dict(zip(kept["word"].to_pylist(), np.log((n + SMOOTH) / (size + SMOOTH * (limit + 1)))))

    return {"langs": langs, "words": table(False, max_words), "grams": table(True, max_grams)}


def _folded(c: str) -> int:
    """A word character in lower case (where that is one character); a space for all others."""
    low = c.lower()
    return ord(low if len(low) == 1 else c) if c.isalnum() and not c.isdecimal() else 32


class Scorer:
    """Turns lists of texts into languages and posteriors, a slice of texts at a time."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words = self.index(model["words"])
        self.grams = self.index(model["grams"])

    def index(self, entries: dict[str, np.ndarray]) -> tuple[HashIndex, np.ndarray]:
        """Hashes of the entries, and their rows."""
        ends = np.cumsum([0, *map(len, entries)]).astype(np.int64)
        h = spans(sums(code_points(list(entries))), ends[:-1], ends[1:])
        return HashIndex(h), np.stack(list(entries.values())) if entries else np.zeros((0, len(self.langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
        bounds = np.concatenate([[1], 1 + np.cumsum(lengths)])
        codes = np.frombuffer(("\n" + "".join(f"{t}\n" if t else "\n" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = per_character(codes, _folded, np.uint32)  # everything between words is a space
        letter = folded != 32
        edge = np.diff(letter.astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        doc = np.searchsorted(bounds, starts, "right") - 1
        total = sums(folded)
        at = self.words[0].find(spans(total, starts, stops))
        out = np.zeros((len(texts), len(self.langs)))
        known = at >= 0
        self.add(out, doc[known], self.words[1][at[known]])
        self.fall_back(out, doc[~known], total, starts[~known], stops[~known])
        real = np.zeros(len(texts), bool)
        real[doc] = True  # has a word
        for i in np.flatnonzero(real):
            if not self.langs or not any(c.isalpha() for c in texts[i][:200]) and not any(c.isalpha() for c in texts[i]):
                real[i] = False
        if not real.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = out.argmax(axis=1)
        share = 1 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[k] if r else UNKNOWN for k, r in zip(best, real)], np.where(real, share, 0.0)

    @staticmethod
    def add(out: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> None:
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(doc, rows[:, k], len(out))

    def fall_back(self, out: np.ndarray, doc: np.ndarray, total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """At each position of an unseen word and the spaces around it, the longest known n-gram that starts there."""
        size = stops - starts + 2
        word = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts - 1, size)
        end = np.repeat(stops + 1, size)
        row = np.full(len(word), -1)
        open_ = np.arange(len(word))
        for k in range(LONGEST, 0, -1):
            fits = open_[at[open_] + k <= end[open_]]
            row[fits] = self.grams[0].find(spans(total, at[fits], at[fits] + k))
            open_ = open_[row[open_] < 0]
        held = row >= 0
        n = np.bincount(word[held], minlength=len(starts))
        self.add(out, doc[word[held]], self.grams[1][row[held]] / n[word[held], None])


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row, from its whole text alone."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            langs, scores = [], []
            texts = b.column(text)
            for lo, hi in slices(text_bytes(texts)[1]):
                some = scorer.score(texts.slice(lo, hi - lo).to_pylist())
                langs += some[0]
                scores += some[1].tolist()
            arrays = [b.column(c) for c in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, out)


def held_out() -> F.Column:
    """Rows that the model never learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def op6_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
