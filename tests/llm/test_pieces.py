import itertools
import math
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import pieces as P

MODEL = None


def model():
    global MODEL
    MODEL = MODEL or P.load_pieces()
    return MODEL


def every(word, pieces):
    """All segmentations of a word of known characters, with their weights."""
    if not word:
        return [((), 0.0)]
    out = []
    for j in range(1, min(len(word), 16) + 1):
        e = pieces.get(word[:j])
        if e:
            out += [((e[0], *ids), e[1] + w) for ids, w in every(word[j:], pieces)]
    return out


def test_round_trip_and_distinct(spark):
    texts = ["", None, " ", "hello world", "x" * 300, "a\u2581b  c\n\td", "日本 ünïcode 😀", "the cat " * 200, " " * 70 + "z", "0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = P.encode_samples(df, model(), 3).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    for r in rows:
        assert r["text"] == (texts[r["doc_id"]] or "")
        assert 0 < r["inclusion"] <= 1
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["doc_id"], r["rank"])), key=lambda r: r["doc_id"]):
        group = list(group)
        assert len({tuple(r["ids"]) for r in group}) == len(group)
        values = [r["perturbed"] for r in group]
        assert values == sorted(values, reverse=True)


def test_all_segmentations_of_a_short_word():
    found = every(" cat", model()["pieces"])
    got = list(P.Sampler(model(), len(found) + 5).sample(np.array([3]), ["cat"]))
    total = math.log(sum(math.exp(w) for _, w in found))
    weight = dict(found)
    seen = [tuple(x[2]) for x in got]
    assert len(seen) == len(set(seen)) and set(seen) <= set(weight)
    assert {ids for ids, w in found if w - total > math.log(1e-9)} <= set(seen)
    assert all(abs(x[3] - (weight[tuple(x[2])] - total)) < 1e-6 for x in got)


def test_frequencies_without_replacement():
    found = every(" at", model()["pieces"])
    total = sum(math.exp(w) for _, w in found)
    p = {ids: math.exp(w) / total for ids, w in found}
    n = 20000
    got = list(P.Sampler(model(), 2).sample(np.arange(n), ["at"] * n))
    first, second = Counter(tuple(x[2]) for x in got if x[1] == 1), Counter(tuple(x[2]) for x in got if x[1] == 2)
    for ids in p:
        assert abs(first[ids] / n - p[ids]) < 0.015
        expected = sum(p[o] * p[ids] / (1 - p[o]) for o in p if o != ids)
        assert abs(second[ids] / n - expected) < 0.015


def test_rows_do_not_depend_on_their_batch():
    s = P.Sampler(model(), 2)
    alone = [tuple(x[2]) for x in s.sample(np.array([9]), ["some words here"])]
    among = [tuple(x[2]) for x in P.Sampler(model(), 2).sample(np.array([1, 9, 4]), ["zzz", "some words here", "qq words"]) if x[0] == 1]
    assert alone == among


def whole_mass(text, m):
    """Log mass of all segmentations of a text, spelled in bytes where no piece fits."""
    longest = max(map(len, m["pieces"]))
    mass = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        ways = [mass[i] + m["pieces"][text[i:j]][1] for i in range(max(0, j - longest), j) if text[i:j] in m["pieces"]]
        if text[j - 1] not in m["pieces"]:
            ways.append(mass[j - 1] + m["byte_weight"] * len(text[j - 1].encode()))
        top = max(ways)
        mass[j] = top + math.log(sum(math.exp(w - top) for w in ways))
    return mass[-1]


@pytest.mark.parametrize("text", ["a (b", "f(x) = \"y\" _{k}", "x  two  spaces -- and ({\\ more", "abcdefghijklmnopqrstuvwxyz" * 3, "\u65e5\u672c\u8a9e" * 40, "don't stop, e.g. here: l'eau #1"])
def test_probabilities_are_those_of_the_whole_lattice(text):
    m = model()
    weight = {e[0]: e[1] for e in m["pieces"].values()} | dict.fromkeys(m["bytes"], m["byte_weight"])
    total = whole_mass(" " + text, m)
    for x in P.Sampler(m, 4).sample(np.arange(6), [text] * 6):
        assert P.Decoder(m["decode"])(np.asarray(x[2])) == text
        assert abs(x[3] - (sum(weight[i] for i in x[2].tolist()) - total)) < 1e-6


def test_every_segmentation_of_several_words():
    m = model()
    found = dict(every(" a (b", m["pieces"]))
    got = [tuple(x[2]) for x in P.Sampler(m, len(found) + 3).sample(np.array([1]), ["a (b"])]
    assert len(got) == len(set(got)) and set(got) <= set(found)
    total = math.log(sum(map(math.exp, found.values())))
    assert {ids for ids, w in found.items() if w - total > math.log(1e-9)} <= set(got)
    assert any(m["pieces"][" ("][0] in ids for ids in got)  # a piece from a space to a bracket


def test_inclusion_is_told_by_the_next_value():
    m, texts = model(), ["some words (here)", "the cat sat", "e.g. this"]
    two = list(P.Sampler(m, 2).sample(np.arange(3), texts))
    three = {(x[0], x[1]): x for x in P.Sampler(m, 3).sample(np.arange(3), texts)}
    for x in two:
        assert tuple(x[2]) == tuple(three[x[0], x[1]][2])
        limit = three[x[0], 3][4]
        assert abs(x[5] - -math.expm1(-math.exp(x[3] - limit))) < 1e-9


def test_edge_tables(spark):
    none = P.encoded_rows(spark.createDataFrame([], "doc_id long, text string"), model())
    assert none.count() == 0 and dict(none.dtypes)["ids"] == "array<int>"
    df = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7), (2, "long " * 40_000, "y", 8)], "doc_id long, text string, ids string, rank int")
    rows = P.encoded_rows(df, model()).collect()
    wanted = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    assert all(r["text_hash"] == wanted[r["doc_id"]] for r in rows)
    assert len(rows) == 6 and len({tuple(r["ids"]) for r in rows if r["doc_id"] == 1}) == 2
