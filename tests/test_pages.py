"""Cleaning of pages: each rule with a case, and the way back by the log."""

import pytest

from larkspur.operators import pages

SCHEMA = "document string, page int, at int, kind string, text string, position string, top double, bottom double, height double, headings array<string>"


def table(spark, rows):
    """Rows (document, page, at, kind, text) with anything else by name."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(dict(zip(names, r[:5]), **(r[5] if len(r) > 5 else {})).get(n) for n in names) for r in rows], SCHEMA)


def run(spark, rows):
    elements = table(spark, rows)
    clean, log = pages.cleaned_pages(elements)
    back = {(r["document"], r["page"], r["at"]): r["text"] for r in pages.restored_elements(clean, log).collect()}
    assert back == {(r[0], r[1], r[2]): r[4] for r in rows if r[4]}
    ops = {}
    for r in log.collect():
        ops.setdefault((r["document"], r["page"], r["rule"]), []).append((r["at"] if r["at"] is not None else r["line"], r["before"], r["after"]))
    return {(r["document"], r["page"]): (r["cleaned"], r["kept"], r["left_out"], r["decision"]) for r in clean.collect()}, ops


def test_edges_and_running_numbers_go(spark):
    rows = [x for p in (1, 2, 3) for x in [("d", p, 0, "text", "内部 资料"), ("d", p, 1, "text", f"第{p}页的内容。"), ("d", p, 2, "text", str(10 + p))]]
    rows += [("e", 1, 0, "text", "内部 资料"), ("e", 1, 1, "text", "7"), ("e", 2, 0, "text", "other"), ("e", 2, 1, "text", "8")]
    clean, ops = run(spark, rows)
    assert clean["d", 2] == ("第2页的内容。", [1], [0, 2], "pass")
    assert ops["d", 3, "exclude_repeated_edge"] == [(0, "内部 资料", "")] and ops["d", 3, "exclude_page_number"] == [(2, "13", "")]
    assert clean["e", 1] == ("内部 资料\n7", [0, 1], [], "pass")  # another document; two numbers prove nothing


def test_proven_numbers_and_business_numbers(spark):
    rows = [("p", 4, i, "text", x) for i, x in enumerate(["60", "105", "6000"])] + [("p", 4, 3, "footer", "4")]
    rows += [("q", 1, 0, "text", "3 / 9", {"position": "page_top"}), ("q", 1, 1, "text", "x。"), ("q", 1, 2, "text", "5", {"top": 0.95, "bottom": 0.99}), ("r", 1, 0, "text", "5", {"top": 50.0, "bottom": 60.0, "height": 800.0}), ("r", 1, 1, "text", "5", {"top": 400.0, "bottom": 410.0, "height": 800.0})]
    clean, _ = run(spark, rows)
    assert clean["p", 4] == ("60\n105\n6000", [0, 1, 2], [3], "pass")
    assert clean["q", 1] == ("x。", [1], [0, 2], "pass") and clean["r", 1] == ("5", [1], [0], "pass")


def test_broken_lines_merge_but_headings_lists_and_tables_stay(spark):
    heads = {"headings": ["责任 范围"]}
    texts = [("heading", "总则"), ("text", "没有经过结算的，\x00 "), ("text", "比例为"), ("text", "六成。"), ("text", "第二条 范围"), ("text", "（一）住院"), ("table", "项目 | 甲"), ("text", "又一\r\n\r\n\r\n行"), ("text", "责任范围"), ("text", ""), ("text", "尾"), ("text", None)]
    clean, ops = run(spark, [("d", 1, i, k, x, heads) for i, (k, x) in enumerate(texts)])
    assert clean["d", 1][0] == "总则\n没有经过结算的，比例为六成。\n第二条 范围\n（一）住院\n项目 | 甲\n又一行\n责任范围\n尾"
    assert ops["d", 1, "merge_broken_lines"] == [(1, "没有经过结算的，\n比例为", "没有经过结算的，比例为"), (1, "没有经过结算的，比例为\n六成。", "没有经过结算的，比例为六成。"), (5, "又一\n行", "又一行")]
    assert [x[0] for x in ops["d", 1, "normalize_control_characters"]] == [1] and [x[0] for x in ops["d", 1, "split_lines"]] == [7]


def test_merged_text_that_becomes_a_heading_takes_no_more(spark):
    heads = {"headings": ["保险责任"]}
    clean, _ = run(spark, [("d", 1, i, "text", x, heads) for i, x in enumerate(["保险", "责任", "正文", "接着"])])
    assert clean["d", 1][0] == "保险责任\n正文接着"


@pytest.mark.parametrize("text,wanted", [(None, ""), ("  a\t\tb \r\n c\x07", "a b\nc"), ("a\n\n\n\nb", "a\n\nb"), ("　x y ", "x y"), (" \n ", "")])
def test_normal_text(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(pages.normal(pages.F.col("t")).alias("t")).first()["t"] == wanted


def test_empty_table(spark):
    clean, log = pages.cleaned_pages(table(spark, []))
    assert clean.count() == 0 and log.count() == 0
