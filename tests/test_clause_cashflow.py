"""Yearly entries of benefit clauses: texts are read once each, not by policy."""

from pyspark.sql import functions as F

from larkspur.operators import cashflow

SCHEMA = "policy_id long, name string, content string"


def expanded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({
        "clause_no": F.lit(1), "pension_age": F.lit(60), "effective_year": F.lit(2020), "birth_year": F.lit(1980), "end_year": F.lit(2050), "amount": F.lit(1000.0), "premium": F.lit(100.0),
        "total_premium": F.lit(500.0), "first_day": F.lit("2020-03-01").cast("date"), "born": F.struct(F.lit(1980).alias("year"), F.lit(5).alias("month"), F.lit(1).alias("day")),
    })
    return cashflow.expand_clauses(df)


def test_texts_are_read_once_each(spark):
    text = "自本合同生效之日起每满十周年，按已交保费的110%给付"
    df = expanded(spark, [(1, "年金", text), (2, "年金", text), (3, None, text)])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "周岁" not in plan and "周年" not in plan
    assert sorted(df.select("policy_id", "year", "amount").collect()) == [(p, y, 550.0) for p in (1, 2, 3) for y in (2030, 2040, 2050)]


def test_kinds_of_clauses(spark):
    texts = [
        (1, "深造金", "22周岁按有效保险金额的30%给付；十八至二十一周岁每年按有效保险金额的20%给付"), (2, "关爱金", "于45周岁、50 周岁时按基本保险金额2倍给付"), (3, "祝寿金", "生存至六十周岁保单生效对应日，按基本保险金额的50%给付"),
        (4, "满期金", "生存至保险期间届满，给付二者之较大者"), (5, "住院津贴", "按日给付"), (6, None, None), (7, "", ""), (8, "年金", "生效满十年的首个保单周年日起，每年按基本保险金额给付，养老年金开始领取日之前"),
    ]
    got = {}
    for r in expanded(spark, texts).orderBy("policy_id", "year").collect():
        got.setdefault(r["policy_id"], []).append((r["year"], r["age"], r["amount"]))
    assert got == {2: [(2025, 45, 2000.0), (2030, 50, 2000.0)], 3: [(2040, 60, 500.0)], 4: [(2050, 69, 1000.0)], 8: [(y, y - 1981, 1000.0) for y in range(2030, 2040)]}
