"""Fields by labels: misread ones, values below, labels inside others."""

from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.operators import labels

LABELS = [("insured", "被保险人"), ("insured", "被保险人姓名："), ("amount", "基本保险金额"), ("amount", "保险金额"), ("mode", "交费方式"), ("no", "No"), ("period", "保险期间"), ("blank", "")]


def fields(spark, pages):
    rows = [(p, i, x) for p, page in enumerate(pages) for i, x in enumerate(page)]
    df = spark.createDataFrame(rows, "page int, line_no int, text string")
    found = labels.best_fields(df, spark.createDataFrame(LABELS, "field string, label string")).collect()
    return [{r["field"]: (r["value"], r["score"], r["confidence"]) for r in found if r["page"] == p} for p in range(len(pages))]


def test_fields(spark):
    got = fields(spark, [
        ["投保人：甲，被保险人姓名： 乙，备注", "被保险人：丙"], ["基夲保险金额：10万", "保险全额 9"], ["交费方武", "  年交  备注", "NO:77"], ["被保验人: x", "被保险人: y"], ["没有", None, ""], ["保险期闸 终身；"], ["被保人：近"],
    ])
    assert got[0] == {"insured": ("丙", 98.0, "matcher-high")}
    assert got[1] == {"amount": ("10万", 88.0, "matcher")}  # the shorter label, whole, says more than the longer one, misread
    assert got[2] == {"mode": ("年交", 55.0, "review"), "no": ("77", 98.0, "matcher-high")}
    assert got[3] == {"insured": ("y", 98.0, "matcher-high")} and got[4] == {}
    assert got[5] == {"period": ("终身", 75.0, "matcher")} and got[6] == {"insured": ("近", 83.0, "matcher")}


def test_every_misread_label_is_met(spark):
    # one edit of four characters, two of eight or more: deletions, insertions and changes at any place
    label = "甲乙丙丁戊己庚辛"
    texts = [label[:i] + x + label[j:] for i in range(8) for j in (i, i + 1) for x in ("", "某")] + [label[:1] + label[2:5] + label[6:], "某" + label[:3] + "某" + label[3:], label[:2] + "某某" + label[4:]]
    lines = spark.createDataFrame([(i, 0, f"前{t}：值") for i, t in enumerate(texts)], "page int, line_no int, text string")
    got = labels.best_fields(lines, spark.createDataFrame([("f", label)], "field string, label string")).where("value = '值'")
    assert got.count() == len(texts)
    three = spark.createDataFrame([(0, 0, "甲某丙某戊某庚辛：值")], "page int, line_no int, text string")
    assert labels.best_fields(three, spark.createDataFrame([("f", label)], "field string, label string")).count() == 0


def test_scan_text_takes_the_compatibility_form(spark):
    text = spark.range(1).select(N.scan_text(F.lit("Ⅷ㈱１２ﬁ⑩㎏ café ｶﾞ 險：")).alias("x")).first()["x"]
    assert text == "viii株12fi10kgcaf" + spark.range(1).select(N.scan_text(F.lit("險")).alias("x")).first()["x"]
