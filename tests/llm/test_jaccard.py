import random
import re

from larkspur.llm import jaccard as J


def brute(rows, size=3, least=90):
    sets = []
    for doc_id, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and 100 * len(a & sets[k]) >= least * len(a | sets[k]):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = prose(12)
    texts = [prose(60), "A b C", "a b c", "a b", "a", "", None, " \n\t", line, line.upper(), "a b c d", "x " * 50]
    for size in (40, 90, 200):
        base = prose(size).split()
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(size)] = word()
            texts.append(" ".join(w))
    texts += [prose(r.randint(5, 30)) + " " + line for _ in range(60)]
    texts += texts[20:40]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in J.link_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_matches_brute_force(spark):
    check(spark, corpus())


def test_large_families_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", 1500)
    monkeypatch.setattr(J, "GROUP", 4)
    monkeypatch.setattr(J, "CELLS", 3000)
    monkeypatch.setattr(J, "HUB_PARTS", 2)
    check(spark, corpus())


def test_empty_table(spark):
    assert J.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_partitions_without_words(spark):
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, None)], "doc_id long, text string").coalesce(1)
    assert {tuple(r) for r in J.link_components(blank).select("doc_id", "n_shingles", "component_id").collect()} == {(i, 0, i) for i in range(1, 5)}
    words = spark.createDataFrame([(5, "a b c d"), (6, "a b c d")], "doc_id long, text string").coalesce(1)
    got = {tuple(r) for r in J.link_components(blank.unionByName(words)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(i, 0, i) for i in range(1, 5)} | {(5, 2, 5), (6, 2, 5)}


def test_rows_that_share_an_id_are_judged_by_text(spark):
    a = " ".join(f"a{i}" for i in range(60))
    near, b = a + " tail", " ".join(f"b{i}" for i in range(60))
    rows = [(5, near), (5, b), (3, a), (7, b + " tail"), (None, "x y"), (8, "X  y")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, id int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.link_components(df).collect())
    assert got == sorted([("5", 59, "3"), ("5", 58, "5"), ("3", 58, "3"), ("7", 59, "5"), ("None", 1, "None"), ("8", 1, "None")])


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    got = J.link_components(spark.createDataFrame([(1, long), (2, long + " x"), (3, "x")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == [(1, 199_998, 1), (2, 199_999, 1), (3, 1, 3)]


def families_of(spark, sets):
    """Families as sets of ids, from (n, prefix) of sets."""
    df = spark.createDataFrame([((i, i, i), n, prefix) for i, (n, prefix) in enumerate(sets)], f"node {J.NODE}, n long, prefix array<long>")
    found = {}
    for r in J.families(df, 90).collect():
        found.setdefault(r["family"], set()).add(r["node"]["id"])
    return sorted(map(sorted, found.values()))


def test_chance_tokens_do_not_chain_families(spark):
    chain = [(20, [i, 10_000 + i, i + 1]) for i in range(100)]
    assert families_of(spark, chain) == []
    near = [(20, [20_000, 30_000, 40_000]), (20, [20_000, 30_001, 40_000]), (21, [20_000, 30_000, 50_000])]
    assert families_of(spark, chain + near) == [[100, 101, 102]]


def test_a_token_of_many_sets_joins_those_of_like_size(spark):
    sets = [(n, [7, 1000 + 100 * n + i]) for n in (19, 20, 40, 400) for i in range(20)]
    assert [len(f) for f in families_of(spark, sets)] == [40, 20, 20]
    assert families_of(spark, [(1, [7]) for _ in range(40)]) == [list(range(40))]


def test_pairs_and_stars_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(20, 90))]
        texts += [" ".join(base), " ".join([*base, "x"]), " ".join(base[1:]), " ".join(base[:-3]), " ".join(["same", "old", "line", *base])]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 3, 32):
        monkeypatch.setattr(J, "MOST_PAIRED", most)
        assert sorted(map(tuple, J.link_components(docs).collect())) == brute(rows)
