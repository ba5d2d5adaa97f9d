"""Vector codes against a brute-force version, with the edge cases the docstring names."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import vector_codes


def brute(rows, parts, entries, rounds):
    """{(vec_id, v): (codes, error)} and the codebooks, from the definition."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) and abs(1024 * x) < vector_codes.LARGEST for x in v)]
    if not kept:
        return [], []
    sizes = Counter(len(v) for _, v, _ in kept)
    size = min(sizes, key=lambda s: (-sizes[s], s))
    kept = [x for x in kept if len(x[1]) == size]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    cuts = [list(a) for a in np.array_split(np.arange(size), parts)]
    books = [[[v[j] for j in cut] for _, v, _ in first] for cut in cuts]

    def near(v, p):
        x = [v[j] for j in cuts[p]]
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p, cut in enumerate(cuts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(v, p)[1]].append([v[j] for j in cut])
            for e, xs in own.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, tuple(e for _, e in found), sum(d for d, _ in found), label))
    return out, books


def vectors(size, n=150, seed=4):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(size)], r.choice([0, 1, None])) for i in range(n)]
    rows += [(n + i, rows[3][1], 7) for i in range(40)] + [(5, rows[5][1], 1), (5, rows[9][1], 1), (None, rows[8][1], None)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] * size, 1), (903, [float("nan")] * size, 1), (904, [float("inf")] + [0.0] * (size - 1), 1), (905, [0.1] * (size + 1), 1), (906, [1e30] * size, 1), (907, [0.0] * size, 0), (908, [-0.0001] * size, 0)]
    return rows


@pytest.mark.parametrize("size,entries", [(8, 16), (10, 300), (3, 7)])
def test_matches_brute_force(spark, size, entries):
    rows = vectors(size)
    df = spark.createDataFrame([(i, v, x, "x", 1) for i, v, x in rows], "vec_id long, embedding array<double>, label int, codes string, error int").repartition(3)
    whole = vector_codes.whole_numbers(df)
    books = vector_codes.fit(whole, 4, entries, 3)
    wanted, true_books = brute(rows, 4, entries, 3)
    assert [b.tolist() for b in books] == true_books
    got = vector_codes.with_label_error(vector_codes.encode(whole, books)).collect()
    assert sorted(((r["vec_id"], tuple(r["codes"]), r["error"], r["label"]) for r in got), key=str) == sorted(wanted, key=str)
    sums = defaultdict(int)
    for _, _, e, label in wanted:
        sums[label] += e
    assert {(r["label"], r["label_error"]) for r in got} == set(sums.items())


def test_empty_and_decoding(spark):
    df = spark.createDataFrame([(1, [0.5, -0.25, 0.0, 1.0]), (2, [0.1, 0.1, 0.1, 0.1])], "vec_id long, embedding array<float>")
    none = vector_codes.whole_numbers(df.limit(0))
    assert vector_codes.fit(none) == [] and vector_codes.encode(none, []).count() == 0
    whole = vector_codes.whole_numbers(df)
    books = vector_codes.fit(whole)
    coded = vector_codes.encode(whole, books)
    assert coded.agg(F.sum("error")).first()[0] == 0
    back = {r["vec_id"]: r["embedding"] for r in vector_codes.decode(coded, books).collect()}
    assert back[1] == [0.5, -0.25, 0.0, 1.0] and back[2] == [102 / 1024] * 4


@pytest.mark.parametrize("spread,memo", [(3, 1 << 16), (40, 5), (500, 0), (1 << 22, 100)])
def test_cells_lose_no_nearest_entry(spread, memo):
    r = np.random.default_rng(spread)
    book = r.integers(-spread, spread + 1, (64, 5))
    book[7] = book[3]  # a tie, which the lower index wins
    x = np.concatenate([r.integers(-2 * spread, 2 * spread + 1, (400, 5)), book, book + 1])
    grid = vector_codes.Grid(book, memo)
    d = ((x[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2)
    for part in (x[:200], x[200:], x):
        index, error = grid.nearest(part)
        at = d[:200] if len(part) == 200 else d[200:] if len(part) == len(x) - 200 else d
        assert index.tolist() == at.argmin(axis=1).tolist() and error.tolist() == at.min(axis=1).tolist()
    assert len(grid.memo) <= memo
