"""Each operator against a brute-force version, with the edge cases its docstring names."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, decontaminate, langid, neighbours, token_counts, toxicity, url_filter

# --- URL filter -----------------------------------------------------------------------------------

URLS = [
    "http://a.example.net/en/x", "https://example.net/de/", "HTTP://X.EXAMPLE.COM/de/1?q#f", "http://b.org/fr/", "http://b.org", "http://net", "http://net/", "http://notnet/", "ftp://a.net/?x", "no host", None, "",
    "http://example.net/en", "http://evilexample.net/en/", "http://.net/", "http://a.org/fr/x", "http://a.org/FR/x", "http://ÄÖ.net/p#q", "x://a.example.com/de/?/en/", "http://a.b.c.example.net/en/",
]


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for entry, action in rules:
        h, p = entry.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(entry), entry, action))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_urls(spark, most):
    rules = [*url_filter.RULES, *[(f"h{i}.test/p{i % 7}", "block") for i in range(300)]]
    urls = URLS + [f"http://w.h{i}.test/p{i % 7}/x" for i in range(0, 320, 3)] + URLS[:3]
    df = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(urls)], "page_id long, url string, extra string, verdict string")
    listed = spark.createDataFrame(rules + rules[:2] + [(None, "block")], "entry string, action string")
    got = url_filter.filter_urls(df, listed, max_filter_bytes=most).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [judge(u, rules) for u in urls]
    assert {r["extra"] for r in got} == {"kept"}


def test_urls_empty(spark):
    listed = spark.createDataFrame(url_filter.RULES, "entry string, action string")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), listed).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, listed.limit(0)).first()["verdict"] == "allow"


# --- chat -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "\\", "a\\<s>", "<<s>", "\\\\[INST]", "line\nline", "", "x" * 5000, " [/INST]</s><s>[INST] user\n", "é 日"]
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((r, x) for x in bad for r in ("user", "assistant", "sys\ntem<s>"))]
    rows += [(9, 1, "assistant", None), (9, None, None, "q"), (None, 0, "assistant", "n"), (0, 3, "assistant", "tie"), (0, 3, "assistant", "tie")]
    rows += [(8, 0, "user", "A"), (8, 0, "user", "</s>"), (8, 0, "user", "\\"), (8, 0, None, None), (8, 0, "user", "z" * 200_000), (7, 1, "a\nb", "x"), (7, 1, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: x)
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["formatted_chars"] == sum(len(chat.render(r, x)) for _, r, x in turns)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_chat_plain_text_is_not_escaped():
    assert chat.render("user", "hello") == "<s>[INST] user\nhello [/INST]</s>"
    assert chat.parse(chat.render("user", "a") + chat.render("x", "</s>"))[1][:2] == ("x", "</s>")


# --- language ID ----------------------------------------------------------------------------------


def test_language_id(spark):
    r = random.Random(2)
    stems = {"aa": ["kor", "tul", "ven", "mip"], "bb": ["zha", "quo", "lys", "wem"]}
    text = lambda lang, n: " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(x, 30), x) for i, x in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "words", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = [text("aa", 12), text("bb", 12), None, "", "123 ½ ²!", "KORTUL venmipkor", "quolyswemzhaquo", "x" * 100000]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(ask)], "doc_id long, text string, score string")
    got = [(x["lang_pred"], x["score"]) for x in langid.identify(df, model).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:7]] == ["aa", "bb", "und", "und", "und", "aa", "bb"]
    assert got[2][1] == got[3][1] == got[4][1] == 0.0 and all(0 <= g[1] <= 1 for g in got)
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {x["lang_pred"] for x in langid.identify(df, nothing).collect()} == {"und"}


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    judged = langid.identify(docs.where(langid.held_out()), model)
    right, n = judged.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.97


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~hidden))
    assert (np.diff(model["thresholds"]) > 0).all()
    judged = toxicity.severity(docs, model).join(labels.where(hidden), "doc_id").toPandas()
    bad = judged.grade == 1
    assert judged.toxic[bad].mean() > 0.85 and judged.toxic[~bad].mean() < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 10000), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [r["severity"] for r in toxicity.severity(docs, toxicity.fit(docs, none)).collect()] == [0.0] * 4


# --- token counts ---------------------------------------------------------------------------------


def test_token_counts(spark):
    import public_tokenizers
    import tiktoken

    ranks = token_counts.load_ranks()
    texts = ["", None, "hello world", "<|endoftext|> as text", "word " * 3000, "é日😀"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    flat = token_counts.encode_flat(df, ranks, public_tokenizers.PATTERN, block_tokens=64)
    counts = token_counts.scan(flat.where("ids IS NOT NULL").select("file_id", "block", "n", "ids"))
    joined = flat.where("ids IS NULL").select("file_id", "ordinal", "doc_id").join(counts, ["file_id", "ordinal"])
    got = {r["doc_id"]: r["n_tokens"] for r in joined.collect()}
    assert got == {i: len(coder.encode_ordinary(x)) if x else 0 for i, x in enumerate(texts)}
    assert counts.where("not closed").count() == 0


def test_scan_of_blocks(spark):
    r = np.random.default_rng(0)
    ids = r.integers(0, 9, 1000).astype(np.uint16)
    blocks = [(5, b, 37, ids[b * 37 : b * 37 + 37].tobytes()) for b in range(27)] + [(5, 27, 1, ids[999:].tobytes()), (6, 0, 3, np.array([1, 2, 3], np.uint16).tobytes())]
    df = spark.createDataFrame(blocks, "file_id long, block long, n long, ids binary").repartition(4)
    got = sorted((x["ordinal"], x["n_tokens"], x["closed"]) for x in token_counts.scan(df, separator=0).where("file_id = 5").collect())
    ends = np.flatnonzero(ids == 0)
    wanted = [(i, int(n), True) for i, n in enumerate(np.diff(np.concatenate([[-1], ends])) - 1)]
    if ends[-1] < 999:
        wanted.append((len(ends), int(999 - ends[-1]), False))
    assert got == wanted
    assert [(x["n_tokens"], x["closed"]) for x in token_counts.scan(df, separator=0).where("file_id = 6").collect()] == [(3, False)]
    assert base64.b64decode("AA==") == b"\0"


# --- decontamination ------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "A train leaves town with Alice aboard and travels 120 km in 3 hours before it stops to let Bob join the others"
    changed = item.replace("120", "95.5").replace("3 hours", "7 hours").replace("Alice", "Carol").replace("Bob", "Dan")
    torn = item.replace("Alice", "Carol").replace("Bob", "Carol")
    filler = " ".join(f"word{i}" for i in range(40))
    docs = [(1, f"{filler}. {item}. {filler}"), (2, f"{filler}. {changed}."), (3, filler), (4, None), (5, ""), (6, item.upper()), (7, f"x. {torn}."), (8, item), (8, item), (9, " ".join(item.split()[:9]))]
    bench = [(10, item), (11, "too short"), (12, None), (13, item)]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for most in (1000, 0):
        got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontaminate.contaminated(d, b, max_index=most).collect()}
        assert {k[0] for k in got if k[1] == 10} >= {1, 2, 8}
        assert {k[1] for k in got} == {10, 13} and not {3, 4, 5, 9} & {k[0] for k in got}
        assert got[(1, 10)] and not got[(2, 10)]
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


def hits(spark, docs, bench, **options):
    """{(doc_id, item_id): (cover, same_values)} of (id, text) rows."""
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = decontaminate.contaminated(d, b, **options).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    return {(r["doc_id"], r["item_id"]): (r["cover"], r["same_values"]) for r in rows}


def test_decontamination_counts_each_window_once(spark):
    plain = [f"alpha{i}" for i in range(16)]
    phrase = " ".join(plain[:8])
    numbers = "these are the values 1 2 3 4 5 6 7 8 in order of size"
    table = " ".join(str(1000 + i) for i in range(200))
    docs = [(1, " filler ".join([phrase] * 5)), (2, table), (3, " ".join(plain[:12])), (4, " ".join(plain))]
    found = hits(spark, docs, [(10, " ".join(plain)), (11, numbers)])
    assert found == {(3, 10): (5 / 9, True), (4, 10): (1.0, True)}


def test_decontamination_of_number_tables_and_single_words(spark):
    table = [str(10_000 + i) for i in range(800)]
    other = [str(70_000 + i) for i in range(4000)]
    docs = [(1, " ".join(other)), (2, " ".join(table[100:700])), (3, "a common word here"), (4, "Word!"), (5, "about 12 apples"), (6, "about 13 apples"), (7, "some 12 pears"), (8, "some 13 pears")]
    found = hits(spark, docs, [(10, " ".join(table)), (11, "word"), (12, "about 9 apples"), (13, "12 pears")])
    assert set(found) == {(2, 10), (4, 11), (5, 12), (6, 12), (7, 13)} and found[2, 10] == (593 / 793, True)


def test_decontamination_in_other_case(spark):
    item = "A train leaves town with Alice aboard and travels 120 km in 3 hours before it stops to let Bob join the others"
    german = "Am Morgen sah die alte Frau aus dem Haus am See den Hund und das Kind mit dem Ball im Garten"
    accent = "so then it was that Émile and Ödön walked on to the market with two baskets of pears"
    docs = [(1, item.upper()), (2, item.lower()), (3, item.title()), (4, german.upper()), (5, german.lower()), (6, item.upper().replace("120", "95"))]
    docs += [(7, accent.replace("Émile", "Åke")), (8, accent.upper())]
    found = hits(spark, docs, [(10, item), (11, german), (12, accent)])
    assert found == {(1, 10): (1.0, True), (2, 10): (1.0, True), (3, 10): (1.0, True), (4, 11): (1.0, True), (5, 11): (1.0, True), (6, 10): (1.0, False), (7, 12): (1.0, False), (8, 12): (1.0, True)}
    assert hits(spark, docs, [(10, item), (11, german), (12, accent)], max_index=0) == found


def test_decontamination_with_conflicting_slots(spark):
    item = "on the first day 12 of the boxes were sold at the old market and then again on a later day near the river 12 of the boxes were sold to the miller"
    other = "a man buys 3 red apples and also 5 green pears at the shop and wants to know how much he pays"
    pairs = "one man buys 4 red apples while walking along the long and dusty road to the town and then his friend buys 4 green pears at the shop of the baker"
    docs = [(1, item), (2, item[:-50] + item[-50:].replace("12", "13"))]
    docs += [(3, other.replace("3", "4").replace("5", "4")), (4, pairs.replace("buys 4 red", "buys 7 red").replace("buys 4 green", "buys 9 green"))]
    found = hits(spark, docs, [(10, item), (11, other), (12, pairs)])
    assert found[1, 10] == (1.0, True) and found[3, 11] == (1.0, False)
    # windows without the changed number: all but the up to 8 around it
    n, at = len(item.split()), item.split().index("12", 6)
    lost = sum(i <= at < i + 8 for i in range(n - 7))
    assert found[2, 10] == ((n - 7 - lost) / (n - 7), False)
    n, at = len(pairs.split()), pairs.split().index("4", 5)
    assert found[4, 12] == ((n - 7 - sum(i <= at < i + 8 for i in range(n - 7))) / (n - 7), False)
    assert set(found) == {(1, 10), (2, 10), (3, 11), (4, 12)}


def test_decontamination_of_runs_short_items_and_rows_without_id(spark):
    long = [f"beta{i}" for i in range(1000)]
    part = [f"gamma{i}" for i in range(59)]
    short, chinese, few = "How much is 3 plus 5?", "小明有三个苹果和五个梨他一共有多少个水果", "12 km"
    numbers = "values: 1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    items = [(10, " ".join(long)), (11, " ".join(part)), (12, short), (13, chinese), (14, few), (15, numbers.split(": ")[1])]
    docs = [
        (1, " ".join(long[300:700])), (2, " ".join(part[10:40])), (3, " ".join(part[:12])), (4, "He asked: how much is 4 plus 9? Twice: how much is 4 plus 9?"), (5, f"前言。“{chinese}？”后记"),
        (6, "it is 12 km away"), (7, "it is 13 km away"), (8, " ".join(str(500 + i) for i in range(60))), (9, "“" + "”—“".join(part) + "”"), (None, "a b c " + " ".join(part)), (None, " ".join(part[:12])), (None, " ".join(part[12:24])), (20, " ".join(part[:12])), (20, "clean " * 20),
    ]
    for most in (2_000_000, 0):
        found = hits(spark, docs, items, max_index=most)
        assert set(found) == {(1, 10), (2, 11), (4, 12), (5, 13), (6, 14), (9, 11), (None, 11)}
        assert found[2, 11] == (23 / 52, True) and found[4, 12] == (1.0, False) and found[5, 13] == found[9, 11] == found[None, 11] == (1.0, True)


def test_decontamination_of_reparameterised_questions(spark):
    item = "Alice buys 12 apples at the market. Bob sells 5 of his pears to her. How many pieces of fruit does Alice have now?"
    other = item.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "17").replace("5", "9")
    torn = other.replace("does Carol", "does Erin").replace("17", "12")
    lone = "The dog sleeps in the warm sun near the old red barn all day long"
    docs = [(1, item), (2, other), (3, f"Filler before it. {other} And after it."), (4, torn), (5, "Carol buys 17 apples. Nothing else of it is here at all today."), (6, lone.replace("The dog", "A dog"))]
    docs += [(7, "What is the capital of France?"), (8, "what is the capital of Spain"), (9, "The capital is large. France is too.")]
    items = [(10, item), (11, lone), (12, "What is the capital of France?")]
    for most in (2_000_000, 0):
        found = hits(spark, docs, items, max_index=most)
        assert set(found) == {(1, 10), (2, 10), (3, 10), (4, 10), (6, 11), (7, 12), (8, 12)}
        assert found[1, 10] == (1.0, True) and found[2, 10] == found[3, 10] == (1.0, False) and found[4, 10][0] < 1.0
        assert found[6, 11][0] < 1.0 and found[7, 12] == (1.0, True) and found[8, 12] == (1.0, False)


def brute_windows(item, text, size=8):
    """Share of an item's windows that a text holds, compared word by word."""
    w = lambda t: re.findall(r"[a-z]+", t.lower())
    a, b = w(item), w(text)
    held = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    return sum(tuple(a[i : i + size]) in held for i in range(len(a) - size + 1)) / (len(a) - size + 1)


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(4, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(10, 40)))) for i in range(12)]
    docs = []
    for n in range(150):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1].split()
            a = r.randint(0, len(w) - 1)
            parts += [" ".join(w[a : a + r.randint(1, len(w))]), word()] * r.randint(1, 3)
        docs.append((n, " ".join(parts)))
    # whole words of 13 in a row are a hit too
    w = lambda t: t.split()
    run = lambda a, b: any(tuple(w(a)[i : i + 13]) in {tuple(w(b)[k : k + 13]) for k in range(len(w(b)) - 12)} for i in range(len(w(a)) - 12))
    wanted = {(d, i): c for d, t in docs for i, x in items if (c := brute_windows(x, t)) >= 0.5 or run(x, t)}
    found = hits(spark, docs, items)
    assert {k: round(c, 9) for k, (c, _) in found.items()} == {k: round(c, 9) for k, c in wanted.items()} and wanted


# --- models by brute force ------------------------------------------------------------------------


def test_language_scores_by_brute_force(spark):
    import math

    r = random.Random(4)
    stems = {"aa": ["kor", "tul", "ven"], "bb": ["zha", "quo", "lys"], "cc": ["kor", "quo", "mip"]}
    text = lambda lang, n: " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(x, 20), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts: dict = {False: {}, True: {}}
    for _, t, lang in rows:
        for w in t.split():
            counts[False].setdefault(w, Counter())[lang] += 1
            s = f" {w} "
            for k in range(1, 5):
                for i in range(len(s) - k + 1):
                    counts[True].setdefault(s[i : i + k], Counter())[lang] += 1
    size = {g: Counter() for g in counts}
    for g, entries in counts.items():
        for c in entries.values():
            size[g].update(c)
    known = {g: {w for w, c in entries.items() if sum(c.values()) >= 2} for g, entries in counts.items()}
    value = lambda g, w, lang: math.log((counts[g][w][lang] + 0.5) / (size[g][lang] + 0.5 * 60_001))
    ask = [text("aa", 6), "kortul zhazha mipkor xyz", "quoquoquoquoquo", "unseen wordlys", "KOR tul"]
    df = spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string")
    for row in langid.identify(df, model).collect():
        total = {lang: 0.0 for lang in stems}
        for w in ask[row["doc_id"]].lower().split():
            if w in known[False]:
                parts = [(False, w)]
            else:
                s, parts = f" {w} ", []
                for i in range(len(s)):
                    parts += [(True, s[i : i + k]) for k in (4, 3, 2, 1) if i + k <= len(s) and s[i : i + k] in known[True]][:1]
            for lang in stems:
                n = 1 if parts and not parts[0][0] else max(1, len(parts))
                total[lang] += sum(value(g, x, lang) for g, x in parts) / n
        best = max(sorted(total), key=lambda x: total[x])
        assert row["lang_pred"] == best
        assert abs(row["score"] - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-9


def test_severity_by_brute_force(spark):
    r = random.Random(3)
    mild, bad, plain = ["grotty", "nasty"], ["vilestword", "horridword"], [f"word{i}" for i in range(40)]
    rows, grades = [], []
    for i in range(600):
        g = max(0, i % 6 - 3)
        words = [r.choice(plain) for _ in range(12)] + [r.choice(mild)] * (g == 1) * 2 + [r.choice(bad)] * (g == 2) * 2
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")
    model = toxicity.fit(docs, known)
    theta = model["thresholds"]
    assert theta[0] < theta[1] and len(model["at"]) > 0
    # the score of a text is the sum of the weights of its distinct words and stems, the same for both thresholds
    weight = dict(zip(model["at"].tolist(), model["weights"].tolist()))
    ask = [(1, "vilestword here"), (2, "GROTTY grotty"), (3, "word1 word2"), (4, ""), (5, None)]
    for row in toxicity.severity(spark.createDataFrame(ask, "doc_id long, text string"), model).collect():
        text = dict(ask)[row["doc_id"]]
        buckets = {b for x, at in toxicity.featurise(pa.array([text], pa.string())) for b in x[at[0] : at[1]].tolist()}
        score = sum(weight.get(b, 0.0) for b in buckets)
        q = [1 / (1 + np.exp(-(score - t))) for t in theta]
        assert abs(row["severity"] - sum(q)) < 1e-9 and abs(row["toxic_prob"] - q[0]) < 1e-9 and row["toxic"] == (q[0] >= 0.5)
    judged = toxicity.severity(docs, model).join(known, "doc_id").groupBy("grade").avg("severity").orderBy("grade").collect()
    assert judged[0][1] < 0.3 < 0.7 < judged[1][1] < judged[2][1]


def test_empty_tables_and_clashing_columns(spark):
    import public_tokenizers

    model = langid.fit(spark.createDataFrame([(1, "kor tul", "aa"), (2, "kor ven", "aa")], "doc_id long, text string, lang string"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert langid.identify(empty, model).count() == 0
    fitted = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, grade int"))
    assert toxicity.severity(empty, fitted).count() == 0
    clash = spark.createDataFrame([(1, "kor", "x", 1.0, True, b"z")], "doc_id long, text string, lang_pred string, severity double, toxic boolean, ids binary")
    assert langid.identify(clash, model).first()["lang_pred"] == "aa" and toxicity.severity(clash, fitted).first()["severity"] == 0.0
    ranks = token_counts.load_ranks()
    flat = token_counts.encode_flat(clash, ranks, public_tokenizers.PATTERN)
    assert flat.where("ids IS NOT NULL").count() == 1
    none = token_counts.encode_flat(empty, ranks, public_tokenizers.PATTERN)
    assert token_counts.scan(none.where("ids IS NOT NULL").select("file_id", "block", "n", "ids")).count() == 0


# --- neighbours -----------------------------------------------------------------------------------


def test_neighbours_order_ties_by_id(spark):
    r = np.random.default_rng(8)
    first = np.eye(1, 8)[0]
    X = np.vstack([first, *[np.concatenate([[1.0], r.standard_normal(7)]) for _ in range(127)]])  # equal products with the first
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(X)], "vec_id long, embedding array<double>, curve string")
    got = [x["vec_id"] for x in neighbours.search(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == list(range(1, 21))

@pytest.mark.parametrize("rows", [4096, 64])
def test_neighbours(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbours, "WINDOW_ROWS", rows)
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 8)) * r.random((400, 1))
    x[50:60] = x[49]
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0]), (1080, [None] * 8), (1100, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    got: dict = {}
    for row in neighbours.search(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    X = np.array([v for _, v in data])
    hits = 0
    for q in range(0, 400, 20):
        s = X @ X[q]
        order = [i for i in np.lexsort((np.arange(400), -np.round(s, 12))) if i != q][:20]
        assert len(got[q]) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in got[q])
        hits += len(set(order) & {i for i, _ in got[q]})
    assert set(got) == set(range(0, 400, 20)) and hits / (20 * 20) >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def nearest(X, ids, q, k=20):
    """{vec_id: best score} of the k nearest by brute force."""
    best: dict = {}
    for i, x in zip(ids, X):
        if i != q:
            best[i] = max(best.get(i, -np.inf), max(x @ y for j, y in zip(ids, X) if j == q))
    return dict(sorted(best.items(), key=lambda e: (-round(e[1], 12), e[0]))[:k])


def found_neighbours(spark, X, ids, queries):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, X)], "vec_id long, embedding array<double>")
    got: dict = {}
    for row in neighbours.search(df, df.where(F.col("vec_id").isin(queries)), 20).collect():
        got.setdefault(row["query_id"], {})[row["vec_id"]] = row["score"]
    return got


def test_neighbours_of_repeated_rows(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 8))
    near = x + r.standard_normal(x.shape) * 1e-3
    crowd = np.vstack([x[:100], *[x[:1]] * 60])
    cases = [(np.vstack([x, x]), [*range(200)] * 2), (np.vstack([x, near]), [*range(200)] * 2), (crowd, [*range(100)] + [200] * 30 + [*range(201, 231)])]
    for X, ids in cases:
        got = found_neighbours(spark, X, ids, [0, 7, 50])
        for q in (0, 7, 50):
            wanted = nearest(X, ids, q)
            assert got[q].keys() == wanted.keys() and all(abs(got[q][i] - s) < 1e-9 for i, s in wanted.items())


def test_neighbours_deal_a_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 128)
    best = neighbours._best

    def watched(query_ids, q, x, ids, k, least=None):
        assert least is None or (len(x) <= 200 and len(q) <= 200), (len(x), len(q))
        return best(query_ids, q, x, ids, k, least)

    monkeypatch.setattr(neighbours, "_best", watched)
    r = np.random.default_rng(6)
    X = r.standard_normal((1200, 8))
    X[:600] = X[0] + r.standard_normal((600, 8)) * 1e-7
    asked = list(range(0, 1200, 2))
    got = found_neighbours(spark, X, list(range(1200)), asked)
    assert set(got) == set(asked) and all(len(g) == 20 for g in got.values())
    scores = X @ X.T
    np.fill_diagonal(scores, -np.inf)
    for q in range(0, 600, 50):  # all candidates of a crowded query are in its crowd or better
        assert min(got[q].values()) >= np.sort(scores[q])[-20] - 1e-5


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(range(8), range(8), range(8), indexing="ij"), -1).reshape(-1, 3)
    ordered = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert len(np.unique(neighbours.hilbert(cells, 3))) == 512 and (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()
