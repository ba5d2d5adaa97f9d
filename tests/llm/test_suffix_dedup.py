import hashlib
import random

import numpy as np

from larkspur.llm import suffix_dedup as S


def brute(rows):
    """(doc_id, text) in order -> what op9 gives for each."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - S.LENGTH + 1):
            w = data[i : i + S.LENGTH]
            if w in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(40), prose(120)
    texts = [prose(60), base, base, passage, prose(20) + passage + prose(20), "a" * 400, "ab" * 150, "a" * 90, "", None, passage[:99], "x\0y" * 50, "é" * 130]
    texts += [prose(r.randint(0, 15)) + passage + prose(r.randint(0, 15)) for _ in range(30)]
    for _ in range(20):
        words = base.split()
        words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts.append((prose(30) + "\n") * 3 + passage)
    return list(enumerate(texts))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in S.digest(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(brute(rows))


def test_matches_brute_force(spark):
    check(spark, corpus())


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    check(spark, corpus())


def test_repeated_rows_and_empty_table(spark):
    text = corpus()[0][1]
    check(spark, [(1, text), (1, text), (2, "b" + text)])
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order():
    r = np.random.default_rng(1)
    text = np.append(r.integers(1, 4, 3000), 0).astype(np.uint8)
    wanted = np.arange(2500)
    ranked, equal = S.two_stage(text, wanted, np.array([2499]))
    data = text.tobytes() + b"\0" * S.LENGTH
    keys = [data[i : i + S.LENGTH] for i in ranked]
    assert sorted(ranked.tolist()) == wanted.tolist() and keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_clashing_columns_and_blank_rests(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = [(1, passage, "keepme", "t"), (2, "\n\n\t" + passage, "b", "u"), (3, "rest " + passage, "c", "v"), (None, None, "d", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, kept string")
    got = sorted((str(x["doc_id"]), x["text"], x["_id"], x["kept"]) for x in S.without_repeats(df).collect())
    assert got == [("1", passage, "keepme", "t"), ("3", "rest ", "c", "v"), ("None", None, "d", "w")]
    assert S.without_repeats(df.limit(0)).count() == 0


def test_very_long_text(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdefghijklm") for _ in range(700_000))
    check(spark, [(1, long[:300]), (2, long), (3, "x" + long[400_000:400_200])])
