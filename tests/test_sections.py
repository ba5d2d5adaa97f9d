"""The chunk tree: each rule with a case, and a plain version of packing and paths."""

import random
import re

from pyspark.sql import functions as F

from larkspur.operators import sections

SCHEMA = "document string, terms boolean, page int, text string, headings array<string>, tables array<array<array<string>>>, layout array<string>"


def tree(spark, rows, **options):
    return sections.document_tree(spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], SCHEMA), **options).collect()


def of(chunks, kind):
    return sorted((c for c in chunks if c["kind"] == kind), key=lambda c: (c["document"], c["section"] or 0, c["part"] or 0))


def test_sections_run_on_over_pages_of_terms(spark):
    rows = [
        ("d", True, 1, "第二条 责任\n一、甲项给付\n发生甲项，按约定给付。", ["第二条 责任"], None, None),
        ("d", True, 2, "给付后终止。\n二、乙项给付\n按第二条，首次发生时给付。\n第三条 其他\n每年确定。", ["二、乙项给付"], None, None),
    ]
    chunks = tree(spark, rows)
    children = of(chunks, "child")
    assert [c["path"] for c in children] == [["第二条 责任"], ["第二条 责任", "一、甲项给付"], ["第二条 责任", "二、乙项给付"], ["第三条 其他"]]
    first = children[1]
    assert (first["page_start"], first["page_end"], first["content"]) == (1, 2, "一、甲项给付\n发生甲项，按约定给付。\n给付后终止。")
    above = next(c for c in chunks if c["id"] == first["parent_id"])
    assert above["kind"] == "parent" and above["unit_ids"] == ["p1-l2", "p1-l3", "p2-l1"] and above["content"] == first["content"]
    assert children[2]["confidence"] == 0.98 and children[2]["reasons"] == ["中文序号标题", "解析器标题标记", "短行标题"] and not children[2]["review"]
    assert children[2]["previous_id"] == first["id"] and children[2]["next_id"] == children[3]["id"] and children[0]["previous_id"] == "" == children[3]["next_id"]
    pages = {c["page_start"]: c["id"] for c in of(chunks, "parent") if c["section"] is None}
    assert children[0]["parent_id"] == pages[1] and children[3]["parent_id"] == pages[2]


def test_other_documents_start_anew_on_each_page(spark):
    rows = [("d", False, p, f"一、标题{p}\n正文{p}" if p != 2 else "接着写", ["接着写"] if p == 3 else []) for p in (1, 2, 3)]
    children = of(tree(spark, rows), "child")
    assert [c["path"] for c in children] == [["一、标题1"], [], ["一、标题3"]]
    assert children[1]["review"] and children[1]["confidence"] == 0.45 and children[1]["unit_ids"] == ["p2-l1"]


def test_levels_end_each_other(spark):
    text = "（1）早\n一、乙\n（1）丙\n（2）丁。\n二、戊\n己\n第一条 庚\n（3）辛\n声明"
    lines = sections.with_paths(sections.heading_lines(spark.createDataFrame([("d", True, 1, text, ["声明"], None, None)], SCHEMA).withColumn("tables", F.array().cast("array<array<array<string>>>")))).orderBy("n").collect()
    assert [r["path"] for r in lines] == [["（1）早"], ["一、乙"], ["一、乙", "（1）丙"], ["一、乙", "（1）丙"], ["二、戊"], ["二、戊"], ["第一条 庚"], ["第一条 庚", "（3）辛"], ["第一条 庚", "声明"]]
    assert [r["level"] for r in lines] == [3, 2, 3, 0, 2, 0, 1, 3, 2]


def test_tables_repeat_their_header_and_leave_the_narrative(spark):
    rows = [["项", "甲"], ["免赔", "一万"], *[[f"行{i}", "值值值值值"] for i in range(30)]]
    layout = ["三档 区别", "免赔", "一万", "", None]
    chunks = tree(spark, [("d", False, 7, "三档 区别\n免赔\n一万", [], [rows, []], layout)], table_tokens=50)
    tables = of(chunks, "table")
    assert len(tables) > 3 and all(c["content"].startswith("项 | 甲\n") and c["tokens"] <= 50 for c in tables)
    assert [x for c in tables for x in c["content"].split("\n")[1:]] == [" | ".join(r) for r in rows[1:]]
    assert [c["content"] for c in of(chunks, "child")] == ["三档 区别"]
    parent = of(chunks, "parent")[0]
    assert parent["content"].startswith("项 | 甲\n免赔 | 一万") and {c["parent_id"] for c in tables} == {parent["id"]}
    only = tree(spark, [("d", False, 1, "x\ny", [], [[["x", "y"]]], ["x", "y"])])
    assert sorted((c["kind"], c["content"]) for c in only) == [("parent", "x | y"), ("table", "x | y")]


def plain_pack(parts, most, count):
    out, now = [], ""
    for p in parts:
        joined = f"{now}\n{p}" if now else p
        if now and count(joined) > most:
            out.append(now)
            now = p
        else:
            now = joined
    return out + [now] * bool(now)


def count(text):
    return len(re.findall(r"[㐀-鿿]", text)) + len(re.findall(r"[A-Za-z]+|\d+(?:\.\d+)?", re.sub(r"[㐀-鿿]", " ", text)))


def plain_split(text, most):
    out, now = [], ""
    for c in text:
        if now and count(now + c) > most:
            out.append(now.strip())
            now = c
        else:
            now += c
    return out + [now.strip()] * bool(now.strip())


def test_packing_against_a_plain_version(spark):
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "b2c", "3.5", "险种", "，", "—", "12", "。", "x"])
    rows = [([" ".join(word() for _ in range(r.randint(1, 30))).strip() or "x" for _ in range(r.randint(1, 8))], r.randint(3, 25)) for _ in range(60)]
    df = spark.createDataFrame(rows, "parts array<string>, most int")
    got = df.select("parts", "most", sections.packed(F.col("parts"), F.col("most")).alias("packed"), F.transform("parts", lambda p: sections.hard_split(p, F.col("most"))).alias("split")).collect()
    for g in got:
        assert g["packed"] == plain_pack(g["parts"], g["most"], count)
        assert [x for x in g["split"]] == [plain_split(p, g["most"]) if count(p) else [p] for p in g["parts"]]


def test_no_line_is_lost(spark):
    r = random.Random(6)
    lines = [r.choice(["", "第%d条 题" % i, "一、段", "（%d）目" % i, f"正文{i}，" + "长" * r.randint(0, 90) + "。" + "句" * r.randint(0, 40)]) for i in range(200)]
    rows = [("d", t, p, "\n".join(lines[p * 20 : p * 20 + 20]), []) for t in (True,) for p in range(10)]
    children = of(tree(spark, rows, terms_tokens=60, unit_tokens=50), "child")
    assert "".join(c["content"] for c in children).replace("\n", "") == "".join(lines)
    assert all(c["tokens"] <= 60 for c in children) and [c["sequence"] for c in children] == list(range(len(children)))
    assert tree(spark, []) == []
