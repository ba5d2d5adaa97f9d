"""The pipeline's stages against brute-force versions on the smallest tables."""

import hashlib
import re

import corpus_pipeline as P
from larkspur.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    kept = P.language(spark, docs, SF)
    assert kept.columns == columns
    rows = kept.collect()
    assert len(rows) > 0.95 * docs.count()

    grouped = P.one_of_each_group(spark, kept, SF)
    assert grouped.columns == columns
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r["text"])) else set() for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in grouped.collect()} == {d for d in ids if find(d) == d}

    cut = P.without_repeats(spark, grouped, SF)
    assert cut.columns == columns
    seen, wanted = set(), {}
    for r in sorted(grouped.collect(), key=lambda r: r["doc_id"]):
        data = r["text"].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - S.LENGTH + 1):
            w = data[i : i + S.LENGTH]
            if w in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        if left.strip() or not any(gone):
            wanted[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == wanted

    clean = P.decontaminated(spark, cut, SF)
    assert clean.columns == columns
    passages = [words(re.sub(r"[^\w\s]", " ", r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    for text in left.values():
        have = words(re.sub(r"[^\w\s]", " ", text.lower()))
        runs = {tuple(have[i : i + 8]) for i in range(len(have) - 7)}
        for p in passages:
            p = [w.lower() for w in p]
            mine = [tuple(p[i : i + 8]) for i in range(len(p) - 7)]
            assert not mine or sum(m in runs for m in mine) / len(mine) < 0.9

    last = P.encoded(spark, clean, SF).collect()
    assert {r["doc_id"] for r in last} == set(left)


def test_copies_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "x"), (1, long, "x"), (2, long, "y"), (3, None, "z"), (4, "short", None), (5, "other " + long[:150], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()[:4]) for r in S.without_repeats(df).collect())
    assert [g[0] for g in got] == [1, 3, 4, 5]


def test_rows_without_id_are_decontaminated(spark, tmp_path):
    item = " ".join(f"delta{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item), (None, "clean text"), (None, None), (1, "x " + item), (1, "same id"), (2, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in P.decontaminated(spark, df, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([(None, "clean text"), (None, None), (2, "other")], key=str)


def test_stages_on_empty_tables_and_clashing_columns(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, id long, tid string, kept string, lang_pred string, hit_id int"
    empty = spark.createDataFrame([], columns)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
    words = " ".join(f"word{i} other{i}" for i in range(40))
    rows = [(1, words, "en", "s", 1, 7, "t", "k", "p", 3), (2, words + " more", "en", "s", 1, 8, "u", "l", "q", 4), (3, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    for stage, left in ((P.one_of_each_group, {1, 3}), (P.without_repeats, {1, 2, 3}), (P.decontaminated, {1, 2, 3})):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        kept = {r["doc_id"]: r for r in got.collect()}
        assert set(kept) == left and (kept[1]["id"], kept[1]["tid"], kept[1]["kept"], kept[1]["hit_id"]) == (7, "t", "k", 3)


def test_language_and_encoding_keep_rows_apart_from_clashing_columns(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, score string, piece_ids string, sample int"
    texts = ["kortul venmip tulkor mipven kor tul ven mip " * 3, "zhaquo lyswem quozha wemlys zha quo lys wem " * 3]
    rows = [(i, texts[i % 2], ["aa", "bb"][i % 2], "s", 1, 5, "kept", "k", 9) for i in range(120)] + [(900, "kortul " * 60_000, None, "s", 1, 5, "kept", "k", 9), (901, None, "aa", "s", 1, 5, "kept", "k", 9), (902, texts[0], None, "s", 1, 5, "kept", "k", 9), (902, texts[0], None, "s", 1, 5, "kept", "k", 9)]
    docs = spark.createDataFrame(rows, columns)
    kept = P.language(spark, docs, SF)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows if r[0] != 901) and {(r["lang_pred"], r["score"]) for r in got} == {(5, "kept")}
    # texts far longer than the rest go through every stage whole
    long = " ".join(f"w{i}" for i in range(60_000))
    two = spark.createDataFrame([(1, long, "aa", "s", 1, 5, "x", "y", 9), (2, "short text", "aa", "s", 1, 5, "x", "y", 9)], columns)
    spark.createDataFrame([(1, "some words of a benchmark that no document holds at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (P.one_of_each_group, P.without_repeats, P.decontaminated):
        two = stage(spark, two, str(tmp_path))
        assert two.columns == docs.columns and {r["doc_id"]: r["text"] for r in two.collect()}[1] == long
    assert {r["doc_id"] for r in P.encoded(spark, two, SF).collect()} == {1, 2}
