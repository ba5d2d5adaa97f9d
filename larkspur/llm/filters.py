"""Bloom filters of bounded size, built by tasks and sent to tasks.

They only keep rows out of a shuffle; an exact join or comparison always follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest filter, in words of 64 bits. Beyond some 60 million keys it lets more and more through, which costs rows, not results.
FILTER_WORDS = 1 << 22
#: Parts of a filter, each filled by one task.
SEGMENTS = 256


def _probe(key: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    return (one << (key & low)) | (one << ((key >> np.uint64(6)) & low)) | (one << ((key >> np.uint64(12)) & low)) | (one << ((key >> np.uint64(18)) & low))


def _word(key: np.ndarray, words: int) -> np.ndarray:
    return ((key >> np.uint64(24)) & np.uint64(words - 1)).astype(np.int64)


def small_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A register-blocked Bloom filter of a column of hashes, of FILTER_WORDS words at most."""
    n = keys.count()
    words = 1024
    while words < min(n / 4, FILTER_WORDS):
        words *= 2
    segment = max(1, words // SEGMENTS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}  # as large as the filter at most
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            word, bits = _word(key, words), _probe(key)
            for s in np.unique(word // segment):
                own = word // segment == s
                np.bitwise_or.at(parts.setdefault(int(s), np.zeros(segment, np.uint64)), word[own] % segment, bits[own])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["segment", "bits"])

    at = F.expr(f"cast((shiftrightunsigned({column}, 24) & {words - 1}L) div {segment} as int)")
    filled = np.zeros((words // segment, segment), np.uint64)
    made = keys.select(column).repartition(at).mapInArrow(build, "segment long, bits binary").toArrow()  # the filter, of bounded size
    for s, bits in zip(made["segment"].to_pylist(), made["bits"].to_pylist()):
        filled[s] |= np.frombuffer(bits, np.uint64)
    return filled.ravel()


def passes(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = _probe(key)
    return (table[_word(key, len(table))] & mask) == mask
