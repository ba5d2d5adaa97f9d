"""The phrase index against a scan of all texts."""

import random

import numpy as np
import pytest

from larkspur.operators import phrases, retrieval


def table(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_CHARS", 300)
    r = random.Random(8)
    words = ["aaa", "aaaa", "Abab", "ba", "险种险种", "é", "x y", "𝄞𝄞𝄞", "longer word", "\n"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 40))), r.choice(["", "ABAB", "险种", None])) for i in range(150)] + [(900, None, None), (901, "z" * 5000, "aa"), (902, "aa", ""), (5, "aaa", "aaa")]
    return spark.createDataFrame(rows, "id long, content string, prefix string").repartition(3)


def test_scores_are_those_of_a_scan(spark, monkeypatch):
    chunks = table(spark, monkeypatch)
    asked = ["aaa", "aaaa", "abab", "ABA", "险种险", "y x", "𝄞𝄞𝄞 ", "zzzz", "longer word longer", "never there", "aaa\n"]
    index = phrases.build_index(chunks, "id")
    key = lambda rows: sorted((r["id"], r["phrase"], round(r["score"], 9)) for r in rows)
    assert key(phrases.search(index, asked).collect()) == key(retrieval.phrase_bm25(chunks, "id", asked).collect())
    plan = index.table.where("bucket = 3 AND gram = 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,5)]" in plan
    with pytest.raises(ValueError):
        phrases.search(index, ["ab"])


def test_empty_table(spark):
    chunks = spark.createDataFrame([], "id long, content string, prefix string")
    assert phrases.search(phrases.build_index(chunks, "id"), ["abc"]).count() == 0


def test_packed_numbers():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 15, 21, 28, 34)] + [[0, 127, 128, (1 << 35) - 1]])
    assert phrases.unpack(phrases.pack(x)).tolist() == x.tolist() and phrases.unpack(phrases.pack(x[:0])).tolist() == []
