"""Queries that grow: no side is sent whole, no pair is made twice, and nothing is worked out on every row that few texts need."""

import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.operators import clauses, matching
from larkspur.plans import carriers

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def query_plan(spark, name):
    return plan(carriers.QUERIES[name](spark, FOLDER))


def test_header_cells_are_not_broadcast(spark):
    assert "Broadcast" not in query_plan(spark, "cash_value_tables")


def test_responsibilities_are_not_broadcast(spark):
    assert "Broadcast" not in query_plan(spark, "responsibility_cards")


def test_best_choice_scores_each_text_once(spark):
    df = spark.createDataFrame([(1, "保险金颜"), (2, "保险金颜"), (3, "abc"), (4, None)], "k int, t string")
    found = matching.best_choice(df, "k", "t", ["保险金额", "投保人姓名"], 0.6)
    assert "levenshtein" not in plan(found)  # rows only take up what was written
    assert sorted((r.k, r.choice) for r in found.collect()) == [(1, "保险金额"), (2, "保险金额")]


def test_equal_names_are_not_paired_row_by_row(spark):
    row = lambda i, name, codes=(): (i, "c", name, list(codes))
    schema = "id int, company string, name string, codes array<string>"
    a = spark.createDataFrame([row(1, "red lamp"), row(2, "Red Lamp", ["x"]), row(3, "zzz")], schema)
    b = spark.createDataFrame([row(i, "red lamp") for i in range(10, 40)] + [row(50, "red lamps"), row(60, "other", ["X"]), row(12, "red lamp", ["X"])], schema)
    found = matching.catalog_matches(a, b, 3)
    assert "array_intersect" not in plan(found)
    got = sorted((r.candidate_id, r.product_id, r.score, r.reason) for r in found.collect())
    exact, code = (0.96, "exact_company_name"), (1.0, "exact_product_code")
    assert got == [(1, 10, *exact), (1, 11, *exact), (1, 12, *exact), (2, 10, *exact), (2, 12, *code), (2, 60, *code)]


def test_alias_pairs_come_once_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "甲"), (2, "乙"), (3, "丙"), (4, None)], "k int, c string")
    known = spark.createDataFrame([("A", "甲"), ("B", "甲"), ("A", "乙"), ("B", "乙")], "canonical string, alias string")
    pairs = matching.alias_pairs(df, df, "k", "c", known)
    assert "Aggregate" not in plan(pairs)
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_parent_tokens_round_half_to_even(spark):
    from larkspur.plans import states

    orders = spark.createDataFrame([(1, 25000.0), (2, 35000.0), (3, 25000.01)], "o_orderkey long, o_totalprice double")
    items = spark.createDataFrame([(k, 1, 4, 1, 7.0) for k in (1, 2, 3)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    got = states.parent_evidence(SimpleNamespace(orders=orders, lineitem=items)).collect()
    assert sorted((r.doc_id, r.shown, r.tokens) for r in got) == [(1, "parent", 2), (2, "parent", 4), (3, "parent", 3)]


def test_people_match_as_by_brute_force(spark):
    some = (None, 1, 2)
    members = [(i, "f" if i % 7 else None, "n", some[i % 3], some[i // 3 % 3], (i * 5) % 4 if i % 5 else None) for i in range(60)]
    asked = [(i, "f", " n " if i else " ", b, t) for i, (b, t) in enumerate((b, t) for b in (*some, 3) for t in (*some, 3))]
    found = matching.match_people(spark.createDataFrame(asked, "person_id int, family_id string, name string, birthday int, id_tail int"), spark.createDataFrame(members, "member_id int, family_id string, name string, birthday int, id_tail int, score int"))
    assert "Window" not in plan(found)
    wanted = {}
    for p, family, name, b, t in asked:
        fit = [m for m in members if name.strip() and m[1] == family and m[2] == name.strip() and None in (b, m[3], None if b == m[3] else 0) and None in (t, m[4], None if t == m[4] else 0)]
        fit.sort(key=lambda m: (-(b is not None and b == m[3]), -(t is not None and t == m[4]), m[5] is None, -(m[5] or 0), -((m[3] is not None) + (m[4] is not None)), m[0]))
        wanted[p] = fit[0][0] if fit else None
    assert {r.person_id: r.member_id for r in found.collect()} == wanted


def test_analyses_meet_as_sets_of_words(spark):
    rows = spark.createDataFrame([(1, 1, "a b", False), (1, 2, "B a", False), (1, 3, "c", False), (1, 4, "a b", True), (2, 5, "a", False)], "plan int, row int, title string, failed boolean")
    sources = spark.createDataFrame([(1, 9, "a b c"), (1, 8, "b a"), (1, 7, "x")], "plan int, source int, title string")
    found = clauses.merged_analyses(rows, sources)
    assert "array_intersect" not in plan(found) and "Window" not in plan(found)
    assert sorted((r.row, r.title, r.source) for r in found.collect()) == [(1, "a b", "8"), (2, "B a", "8"), (3, "c", "9"), (4, "note", ""), (5, "a", "")]


def test_forms_are_literals_and_complete(spark):
    forms = [(c + "1", f + "1") for c, f in N._FORMS.items()]
    df = spark.createDataFrame(forms, "c string, f string").coalesce(1)
    assert "json" not in plan(df.select(N.compatible(F.col("c"))))
    assert df.where(N.compatible(F.col("c")) != F.regexp_replace("f", r"[A-Za-z]\p{M}+", " ")).count() == 0


def test_labels_are_stripped_once_a_text(spark):
    assert "levenshtein" not in query_plan(spark, "label_strip")


def test_posting_lists_are_packed_in_one_pass():
    import numpy as np

    from larkspur.operators import phrases

    lists = [[0], [5, 6, 400], [3, 1 << 15, 1 << 30], [7], [0, 127, 255]]
    first = np.cumsum([0, *map(len, lists)])[:-1]
    packed = phrases.packed_lists(np.concatenate([np.array(x) for x in lists]), first).to_pylist()
    assert packed == [phrases.pack(np.diff(np.array(x), prepend=0)) for x in lists]
    assert phrases.packed_lists(np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []


def test_restoring_reads_what_cleaning_wrote(spark):
    assert "regexp_replace" not in query_plan(spark, "restored_pages")


def test_normal_form_is_the_same(spark):
    import re

    from larkspur.operators import pages

    def plain(t):
        t = re.sub(pages.ODD_SPACES, " ", re.sub(pages.CONTROLS, "", re.sub("\r\n?", "\n", t or "")))
        t = re.sub("\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", re.sub("[\t ]+", " ", t)))
        return re.sub(r"^[ \n]+|[ \n]+\Z", "", t)

    texts = ["", None, " a  b\tc ", "a \x01 b", "\ta\u3000\u3000b\u00a0", "x \r\n\r\r y\n\n\n\nz \n ", "\r", "a\x01\n \n\x02\n b", " \t\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.n for r in df.select("i", pages.normal(F.col("t")).alias("n")).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_sections_and_chunks_are_worked_out_once(spark):
    assert "RLIKE" not in query_plan(spark, "document_sections")
    assert "RLIKE" not in query_plan(spark, "document_tree")


def test_candidates_of_lines_are_worked_out_once(spark):
    assert "levenshtein" not in query_plan(spark, "scanned_fields")


def test_versions_are_not_broadcast(spark):
    assert "Broadcast" not in query_plan(spark, "published_versions")


def test_lines_of_a_document_are_dealt_once(spark):
    from larkspur.operators import sections

    schema = "document string, terms boolean, page int, text string, headings array<string>, tables array<array<array<string>>>, layout array<string>"
    pages = spark.createDataFrame([("d", True, 1, "第一条 甲\n乙", [], None, None), ("d", True, 2, "丙\n一、丁\n戊", [], None, None)], schema)
    tree = sections.document_tree(pages)
    assert plan(tree).count("Exchange ") == 1
    children = sorted((r.section, r.part, r.content, r.tokens, r.sequence) for r in tree.collect() if r.kind == "child")
    assert children == [(0, 0, "第一条 甲\n乙\n丙", 6, 0), (1, 0, "一、丁\n戊", 3, 1)]


def test_pieces_of_a_text_are_read_once(spark):
    from larkspur.operators import sections

    df = spark.createDataFrame([(" ".join(map(str, range(3000))), 7)], "t string, n int")
    cut = df.select(sections.hard_split(F.col("t"), F.col("n")).alias("x"))
    assert plan(cut).count("regexp_extract_all") == 1  # it was read again for each piece
    assert cut.first().x == [" ".join(map(str, range(i, min(i + 7, 3000)))) for i in range(0, 3000, 7)]


def test_ranges_of_patterns_are_the_characters_meant(spark):
    from larkspur.operators import sections

    blocks = [("".join(map(chr, range(max(i, 1), i + 4096))),) for i in range(0, 0x110000, 4096) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame(blocks, "t string")
    for ranges, plain in ((sections.SENTENCE.split("++")[0], "[^。！？!?；;]"), (sections.BETWEEN.removesuffix("*+"), r"[^\x{3400}-\x{9fff}A-Za-z0-9]")):
        assert df.where(F.regexp_replace("t", ranges, "") != F.regexp_replace("t", plain, "")).count() == 0


def test_restoring_sends_each_text_once(spark):
    assert query_plan(spark, "restored_pages").count("Exchange ") == 2  # the clean pages, and their edits


def test_written_tables_leave_no_shuffle_files(spark):
    from larkspur.sources.shared import DROPS, written

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, was = files(), spark.conf.get(DROPS)
    df = spark.range(1000).withColumn("x", F.md5(F.col("id").cast("string"))).repartition("x")
    assert written(df, "x").where("id >= 0").collect()
    assert spark.conf.get(DROPS) == was
    for _ in range(50):  # executors drop them in their own time
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
