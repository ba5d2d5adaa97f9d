"""Lexical search against a brute-force version, with the edge cases its docstring names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for d, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def table(seed=3, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(n)]
    docs += [(900, None), (901, " .,-"), (902, "W1 w1-W1"), (None, docs[5][1]), (5, docs[5][1]), (903, "x" * 3_000_000 + " w7 " + "w3 " * 500_000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(12)] + [(50, None), (51, "!"), (52, "never"), (None, "w3"), (None, "w4 w300"), (3, "extra W9"), (53, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("block_items,postings", [(4096, 1 << 21), (5, 300)])
def test_matches_brute_force(spark, monkeypatch, block_items, postings):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    docs, items = table()
    d = spark.createDataFrame([(i, t, 0, 1) for i, t in docs], "doc_id long, text string, score int, item_id int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical.search(d, q, k=7, block_items=block_items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("accumulators", [0, 40, 100_000])
@pytest.mark.parametrize("span", [1, 7, 4096])
def test_hybrid_finds_what_a_full_sum_finds(accumulators, span):
    r = np.random.default_rng(accumulators + span)
    n = 500
    for _ in range(20):
        sets = [np.flatnonzero(r.random(n) < p) for p in r.choice([0.01, 0.05, 0.3, 0.9], 8)]
        sets = [s for s in sets if len(s)]
        counts = np.array([len(s) for s in sets])
        tfs, lengths = r.integers(1, 5, counts.sum()), r.integers(5, 40, n)
        shard = lexical.Shard(lengths, np.arange(len(sets)), counts, np.concatenate(sets), tfs, n, int(lengths.sum()))
        asked = [(t, int(r.integers(0, 4000))) for t in range(len(sets))]
        full = np.zeros(n, np.int64)
        for t, w in asked:
            a, b = shard.at[t]
            full[shard.docs[a:b]] += shard.shares[a:b] * w
        order = [i for i in np.lexsort((np.arange(n), -full))[:10] if full[i] > 0]
        docs, scores = shard.search(asked, 10, accumulators, span)
        assert docs.tolist() == order and scores.tolist() == full[order].tolist()


def test_pieces_never_cut_a_term(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 5)
    text = "Alpha beta, gamma-Delta éé " * 9
    assert lexical.counted(text.encode()) == Counter(t.encode() for t in terms(text))
