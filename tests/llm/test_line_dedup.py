"""Line dedup against a brute-force version, with the edge cases its docstring names."""

import random
from collections import defaultdict

import pytest

from larkspur.llm import line_dedup


def brute(rows, min_chars, min_docs):
    """(doc_id, kept, n_lines, n_dropped) of rows (doc_id, text), from the definition."""
    ids = lambda d: line_dedup.NO_ID if d is None else d
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(ids(d))
    gone = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), ids(d)) == ids(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def table(seed=1):
    r = random.Random(seed)
    common = [f"Line {i} that many documents share, of more than forty characters" for i in range(12)]
    rows = []
    for i in range(120):
        lines = [r.choice(common) if r.random() < 0.4 else f"own line {i} {j} " + "x" * r.randint(0, 60) for j in range(r.randint(1, 9))]
        lines = [x.upper() if r.random() < 0.2 else " \t" + x + "\r" if r.random() < 0.2 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    wide = "é" * 39  # 78 bytes, 39 code points
    rows += [(200 + i, wide + "\n" + wide + "é\n") for i in range(7)]
    rows += [(300 + i, "Four documents hold this one line, no more of them.") for i in range(4)] + [(300, "Four documents hold this one line, no more of them.")]
    rows += [(None, common[0] + "\nk"), (None, None), (400, None), (401, ""), (402, "\n\n"), (403, "y" * 300_000 + "\n" + common[1]), (119, common[0] + "\n" + common[0]), (119, common[0])]
    rows += [(500 + i, "\n".join([common[2].replace("L", "Ł")] * 2)) for i in range(5)] + [(7, rows[7][1])]
    return rows


@pytest.mark.parametrize("most,words", [(line_dedup.BROADCAST_BYTES, 1 << 16), (0, 1 << 16), (0, 256)])
def test_matches_brute_force(spark, most, words):
    rows = table()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines int, key string").repartition(5)
    got = line_dedup.dedup_lines(df, broadcast_bytes=most, words=words).collect()
    assert sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got), key=str) == brute(rows, 40, 5)


def test_other_limits_and_empty_table(spark):
    rows = [(i, f"a\nb{i % 2}\n") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df, 1, 2, words=256).collect()
    assert sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got), key=str) == brute(rows, 1, 2)
    assert line_dedup.dedup_lines(df.limit(0), words=256).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, min_docs=1)


def test_twice_seen_never_misses(spark):
    rows = [(i, f"{'k' * 40}{i % 50}") for i in range(75)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    table = line_dedup.twice_seen(line_dedup._source(df), 40, 256)
    keys = [f"{'k' * 40}{i}".encode() for i in range(50)]
    hit = line_dedup.passes(table, line_dedup._hashes(keys))
    assert hit[:25].all() and hit[25:].sum() < 20
