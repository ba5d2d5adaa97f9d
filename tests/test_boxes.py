"""Cash-value tables from boxes: each step with a case."""

from pyspark.sql import functions as F

from larkspur.operators import boxes

SCHEMA = "page string, i int, text string, confidence double, box array<array<double>>"


def at(x, y, w=40, h=20):
    return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]


def parse(spark, *pages):
    """Each page a list of (text, box or None[, confidence])."""
    rows = [(str(p), i, b[0], b[2] if len(b) > 2 else 0.9, b[1]) for p, page in enumerate(pages) for i, b in enumerate(page)]
    found = {int(r["page"]): r for r in boxes.cash_value_tables(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [(found[p]["status"], [(r["year"], r["age"], r["value"]) for r in found[p]["rows"]], found[p]["confidence"]) for p in range(len(pages))]


def test_texts(spark):
    texts = ["8,500", "8500元", "19 200", "31:50", "x", "", "-5", "12.", "第3年末", "12年木", "151", "0", "3.0", "｜7", "1．5", "2030/42", "150"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(boxes.number(F.col("t")), boxes.policy_year(F.col("t"))).collect()
    assert [r[0] for r in got] == [8500, 8500, 19200, 31.5, None, None, -5, 12, None, None, 151, 0, 3, None, None, None, 150]
    assert [r[1] for r in got] == [None, None, None, None, None, None, None, None, 3, 12, None, None, None, 7, None, None, 150]


def test_rows_move_with_their_boxes_and_are_read_from_the_left(spark):
    page = [("c", at(300, 104)), ("a", at(10, 90)), ("b", at(150, 100)), ("d", at(10, 130)), ("lone", None), ("e", at(5, 131)), ("flat", [[0.0], [200.0], [30.0], [220.0]])]
    df = boxes.page_items(spark.createDataFrame([("p", i, t, 0.9, b) for i, (t, b) in enumerate(page)], SCHEMA))
    rows = df.select(F.transform(boxes.clustered(F.col("items")), lambda r: F.transform(r, lambda b: b["text"])).alias("r")).first()["r"]
    assert rows == [["a", "b", "c"], ["e", "d"], ["flat"], ["lone"]]


def test_two_and_three_columns_and_years_with_ages(spark):
    head = [("保单年度", at(100, 50)), ("现金价值", at(350, 52))]
    two = head + [x for y, v in ((1, "8,500"), (2, "19,200"), (3, "31,800.50")) for x in ((str(y), at(110, 50 + 40 * y)), (v, at(355, 52 + 40 * y)))]
    three = [("保险年限", at(50, 50)), ("被保险年龄", at(200, 50)), ("现金价值", at(350, 50))] + [x for y in range(1, 7) for x in ((str(y), at(60, 50 + 40 * y)), (str(29 + y), at(210, 50 + 40 * y)), (f"{y},000", at(355, 52 + 40 * y)))]
    both = [("年份/年龄", at(50, 50)), ("现金价值", at(200, 50)), ("累计", at(350, 50))] + [x for y in range(3) for x in ((f"{2030 + y}/{42 + y}", at(60, 90 + 40 * y)), (f"{y + 1}00.5", at(210, 90 + 40 * y)), ("9", at(355, 90 + 40 * y)))]
    got = parse(spark, two, three, both, [("姓名", at(1, 1)), ("某某", at(90, 1))], [("年度现金流汇总", at(1, 1))], two[:-2])
    assert got[0] == ("ok", [(1, None, 8500), (2, None, 19200), (3, None, 31800.5)], 0.93)
    assert got[1][:2] == ("ok", [(y, 29.0 + y, 1000.0 * y) for y in range(1, 7)]) and got[1][2] == 0.96
    assert got[2][1] == [(2030 + y, 42.0 + y, 100 * (y + 1) + 0.5) for y in range(3)]
    assert got[3][0] == got[4][0] == "no table" and got[5] == ("failed", [(1, None, 8500), (2, None, 19200)], 0.0)


def test_repeated_groups_use_each_value_once(spark):
    page = [x for g in (0, 1) for x in (("保单年度末", at(100 + 500 * g, 50)), ("现金价值", at(300 + 500 * g, 55)))]
    for g in (0, 1):
        for k in range(4):
            y = 100 + 60 * k
            page += [(f"{1 + k + 4 * g}年末", at(105 + 500 * g, y)), (f"{(1 + k + 4 * g) * 1000}.00", at(310 + 500 * g, y + (25 if k == 1 else 0)))]
    got = parse(spark, page, page[:-1], [*page, ("3年末", at(106, 220 + 12))])
    assert got[0][:2] == ("ok", [(y, None, 1000.0 * y) for y in range(1, 9)])
    assert got[1][1] == [(y, None, 1000.0 * y) for y in range(1, 8)]  # a year without a value is left out
    assert [r for r in got[2][1] if r[0] == 3] == [(3, None, 3000.0)]


def test_boxes_without_places_are_read_in_order(spark):
    page = [("保单年度 现金价值", None)] + [(x, None) for y in (1, 2, 3, 4) for x in (str(y), "备注", f"{y}50.25")]
    counting = [("保单年度", at(100, 50)), ("现金价值", at(350, 50))] + [x for y in range(1, 7) for x in ((str(y), at(110, 50 + 40 * y)), (str(y + 1), at(355, 50 + 40 * y)))]
    weak = [(t, b, 0.2) for t, b in page]
    got = parse(spark, page, counting, weak)
    assert got[0][:2] == ("ok", [(y, None, float(f"{y}50.25")) for y in (1, 2, 3, 4)])
    assert got[1][0] == "failed" and got[2][0] == "failed" and got[2][2] == 0.65


def test_empty(spark):
    assert boxes.cash_value_tables(spark.createDataFrame([], SCHEMA)).count() == 0
    assert parse(spark, [(None, None), ("", at(1, 1))])[0][0] == "no table"


def test_structured_tables(spark):
    cells = [["保单年度", "现金价值", "保单年度", "现金价值"], ["1", "10.5", "3", "30"], ["2", "20", "4", None], ["合计", "—", "", ""]]
    df = spark.createDataFrame([(0, cells), (1, [["姓名"], ["甲"]]), (2, cells[:2]), (3, [])], "page int, cells array<array<string>>")
    got = {r["page"]: (r["status"], [(x["year"], x["value"]) for x in r["rows"]]) for r in boxes.structured_value_tables(df).collect()}
    assert got == {0: ("ok", [(1, 10.5), (2, 20.0), (3, 30.0)]), 1: ("no table", []), 2: ("failed", [(1, 10.5), (3, 30.0)]), 3: ("no table", [])}


def test_the_plan_holds_each_step_once(spark):
    df = boxes.cash_value_tables(spark.createDataFrame([], SCHEMA))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_results_match_the_places_of_their_pages_after_the_steps(spark):
    from larkspur.plans import carriers

    got = carriers.QUERIES["value_tables_from_boxes"](spark, "/root/testdata/sf0.001")
    assert got.where("page = '7'").orderBy("year").selectExpr("status", "year", "value").collect()[-1] == ("ok", 8, 8007.5)
