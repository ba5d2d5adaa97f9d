"""Carrier queries on policies: orders as policies, customers as the insured, lines as indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import policy as P
from larkspur.operators import cashflow, relations
from larkspur.plans.carriers import query

COVERAGES = ["终身", "至70周岁", "保至 60 岁", "20年", "2035-06-30", "至2040年12月31日零时", "30 年", "", "2021-02-30", "保险期间10年期"]
PAYMENTS = ["趸交", "10年交", "20 年", "5期", "一次交清", "", "2.5年"]


def pick(texts: list[str], key: Column) -> Column:
    """One of some texts, by a key."""
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (key % len(texts) + 1).cast("int"))


def sql_pick(texts: list[str], key: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + f"][CAST({key} % {len(texts)} + 1 AS INT)]"


def born(key: Column) -> Column:
    return F.make_date((1950 + key % 50).cast("int"), (1 + key % 12).cast("int"), (1 + key % 28).cast("int"))


def policies(t) -> DataFrame:
    """policy_id, member_id, effective, birthday, coverage, payment (texts), amount, premium."""
    b, k = born(F.col("o_custkey")), F.col("o_custkey") % 3
    birthday = F.when(k == 0, F.date_format(b, "yyyy-MM-dd")).when(k == 1, F.date_format(b, "yyyy年M月d日")).otherwise(F.date_format(b, "yyyy/M/d"))
    return t.orders.select(
        F.col("o_orderkey").alias("policy_id"), F.col("o_custkey").alias("member_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"), birthday.alias("birthday"),
        pick(COVERAGES, F.col("o_orderkey")).alias("coverage"), pick(PAYMENTS, F.col("o_orderkey")).alias("payment"), F.col("o_totalprice").alias("amount"), (F.floor(F.col("o_totalprice") * 5 + 0.5) / 100).alias("premium"), "o_orderstatus",
    )


POLICIES = f"""pol AS (SELECT o_orderkey AS policy_id, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS eff, b, {sql_pick(COVERAGES, "o_orderkey")} AS coverage, {sql_pick(PAYMENTS, "o_orderkey")} AS payment,
  o_totalprice AS amount, floor(o_totalprice * 5 + 0.5) / 100 AS premium, o_orderstatus FROM (SELECT *, make_date(1950 + o_custkey % 50, 1 + o_custkey % 12, 1 + o_custkey % 28) AS b FROM orders)),
ctx AS (SELECT *, CAST(year(eff) AS INT) AS begin_year, CAST(year(b) AS INT) AS birth_year, CAST(CASE coverage WHEN '终身' THEN year(b) + 105 WHEN '至70周岁' THEN year(b) + 70 WHEN '保至 60 岁' THEN year(b) + 60 WHEN '20年' THEN year(eff) + 20
  WHEN '2035-06-30' THEN 2035 WHEN '至2040年12月31日零时' THEN 2040 WHEN '30 年' THEN year(eff) + 30 WHEN '2021-02-30' THEN 2021 WHEN '保险期间10年期' THEN year(eff) + 10 ELSE 0 END AS INT) AS end_year,
  CASE payment WHEN '趸交' THEN 1.0 WHEN '一次交清' THEN 1.0 WHEN '10年交' THEN 10.0 WHEN '20 年' THEN 20.0 WHEN '5期' THEN 5.0 WHEN '2.5年' THEN 2.5 ELSE 0.0 END::DOUBLE AS years FROM pol)"""
#: Age at the anniversary in a year, as SQL; DuckDB's interval ends months as add_months does.
SQL_AGE = "CAST(CASE WHEN {y} >= begin_year AND date_diff('year', b, eff + to_years(CAST({y} - begin_year AS INT))) - CASE WHEN strftime(eff + to_years(CAST({y} - begin_year AS INT)), '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END >= 0 THEN date_diff('year', b, eff + to_years(CAST({y} - begin_year AS INT))) - CASE WHEN strftime(eff + to_years(CAST({y} - begin_year AS INT)), '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END ELSE {y} - birth_year END AS INT)"


@query(f"""
WITH {POLICIES}, e AS (SELECT *, CASE coverage WHEN '20年' THEN 20 WHEN '30 年' THEN 30 WHEN '保险期间10年期' THEN 10 END AS n, CASE coverage WHEN '至70周岁' THEN 70 WHEN '保至 60 岁' THEN 60 END AS a FROM ctx)
SELECT policy_id, birth_year, CAST(month(b) AS INT) AS birth_month, CAST(day(b) AS INT) AS birth_day, end_year, years, CASE WHEN years = 0 THEN NULL ELSE CAST(greatest(floor(years), 1) AS INT) END AS whole_years,
  CASE WHEN coverage = '2035-06-30' THEN '2035-06-30 23:59:59' WHEN coverage = '至2040年12月31日零时' THEN '2040-12-31 00:00:00'
    WHEN n IS NOT NULL THEN strftime((CASE WHEN strftime(eff, '%m%d') = '0229' AND (year(eff) + n) % 4 <> 0 THEN make_date(year(eff) + n, 3, 1) ELSE CAST(eff + to_years(n) AS DATE) END) - 1, '%Y-%m-%d') || ' 23:59:59'
    WHEN a IS NOT NULL THEN strftime(CAST(b + to_years(a) AS DATE), '%Y-%m-%d') || ' 23:59:59' END AS ends FROM e""")
def policy_terms(t):
    p = cashflow.with_terms(policies(t))
    ends = F.date_format(P.end_moment(F.col("cover"), F.col("begun_on"), F.col("born_on")), "yyyy-MM-dd HH:mm:ss")
    born = [F.col(f"born.{x}").alias(f"birth_{x}") for x in ("year", "month", "day")]
    return p.select("policy_id", *born, P.end_year(F.col("cover"), F.col("begun"), F.col("born")).alias("end_year"), "years", "whole_years", ends.alias("ends"))


STATES = ["有效", "in force", "退保", "承保", "lapsed", "", "正常", "审核中"]
NOW = "2016-07-01"


@query(f"""
WITH {POLICIES}, s AS (SELECT *, {sql_pick(STATES, "member_id")} AS state, CASE coverage WHEN '2035-06-30' THEN TIMESTAMP '2035-06-30 23:59:59' WHEN '至2040年12月31日零时' THEN TIMESTAMP '2040-12-31' WHEN '20年' THEN eff + INTERVAL 20 YEAR WHEN '30 年' THEN eff + INTERVAL 30 YEAR
  WHEN '保险期间10年期' THEN eff + INTERVAL 10 YEAR WHEN '至70周岁' THEN b + INTERVAL 70 YEAR + INTERVAL 1 DAY WHEN '保至 60 岁' THEN b + INTERVAL 60 YEAR + INTERVAL 1 DAY END AS stop FROM ctx)
SELECT policy_id, CASE WHEN policy_id % 50 = 0 OR state IN ('退保', 'lapsed', '审核中') THEN 'inactive' WHEN state = '' THEN 'unknown' WHEN eff > DATE '{NOW}' THEN 'future' WHEN stop <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS validity FROM s""")
def policy_validity(t):
    p = policies(t)
    state = P.record_validity([pick(STATES, F.col("member_id")), F.lit(None).cast("string")], F.col("policy_id") % 50 == 0, F.col("effective"), F.col("coverage"), F.col("birthday"), F.lit(NOW).cast("date"))
    return p.select("policy_id", state.alias("validity"))


NUMERALS = "一二三四五六七八九"


def numeral(n: Column) -> Column:
    """A number below a thousand in numerals, without zeros in between."""
    digit = lambda d: F.substring(F.lit(NUMERALS), d.cast("int"), F.lit(1))
    h, z, e = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    return F.concat(F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""), F.when(z > 0, F.concat(F.when((z == 1) & (h == 0), F.lit("")).otherwise(digit(z)), F.lit("十"))).otherwise(""), F.when(e > 0, digit(e)).otherwise(""))


@query("""
WITH n AS (SELECT *, CAST(p_partkey * 7 % 999 + 1 AS INT) AS n FROM part)
SELECT p_partkey, n, CASE WHEN p_size % 10 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_size + 0.5 END AS percent, CAST(1 + p_size % 10 AS DOUBLE) AS times FROM n""")
def chinese_numbers(t):
    n = (F.col("p_partkey") * 7 % 999 + 1).cast("int")
    parts = t.part.select("p_partkey", "p_size", F.when(n % 4 == 0, n.cast("string")).otherwise(numeral(n)).alias("n"))
    percent = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("按百分之"), numeral(F.col("p_size")), F.lit("给付"))).otherwise(F.concat(F.lit("百分之"), F.col("p_size").cast("string"), F.lit(".5")))
    times = F.when(F.col("p_size") % 10 == 9, F.lit("十")).otherwise(numeral(1 + F.col("p_size") % 10))
    return parts.select("p_partkey", P.chinese_integer(F.col("n")).alias("n"), P.chinese_percent(percent).alias("percent"), P.chinese_multiple(times).alias("times"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 3 THEN NULL WHEN 2 THEN l_quantity + 0.25 ELSE floor(l_extendedprice) END AS amount,
  CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(l_quantity AS INT) END AS policy_year, CAST(year(l_shipdate) AS INT) AS year, CAST(l_quantity AS INT) AS age FROM lineitem""")
def table_cells(t):
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    whole = F.floor("l_extendedprice").cast("bigint")
    money = F.when(k == 0, F.concat(F.lit("¥"), F.format_number(whole, 0), F.lit("元"))).when(k == 1, F.concat(F.lit(" "), whole.cast("string"))).when(k == 2, F.concat(q, F.lit("：25"))).otherwise("12-3")
    year = F.when(k == 0, F.concat(F.lit("第"), q, F.lit("年末"))).when(k == 1, F.concat(F.lit("|"), q, F.lit(" "))).when(k == 2, F.concat(q, F.lit("年度"))).otherwise(F.concat(q, F.lit(".0")))
    both = P.cell_year_age(F.concat(F.year("l_shipdate").cast("string"), F.lit(" / "), q))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.cell_number(money).alias("amount"), P.cell_policy_year(year).alias("policy_year"), both["year"].alias("year"), both["age"].alias("age"))


#: Indicators as rows of text, and what each is worked out from: basis, calculation, value, inputs.
INDICATORS = [
    ("基本保险金额×150%", "", "身故保险金", "", "basic_amount", "percent_of_basic_amount", 150.0, "policy.amount"),
    ("按基本保额的3倍给付", "", "重疾保险金", "", "basic_amount", "multiple_of_basic_amount", 3.0, "policy.amount"),
    ("基本保险金额", "基本保险金额", "满期金", "公式", "basic_amount", "basic_amount", None, "policy.amount"),
    ("现金价值与已交保险费的较大者", "", "身故保险金", "", "cash_value", "manual_formula", None, "cashValue,policyYear"),
    ("已交保险费的120%", "", "身故保险金", "", "total_paid_premium", "percent_of_total_paid_premium", 120.0, "policy.firstPremium,policy.paymentPeriodYears"),
    ("累计已支付保费", "", "退还保费", "", "total_paid_premium", "total_paid_premium", None, "policy.firstPremium,policy.paymentPeriodYears"),
    ("首次交纳的保险费的20%", "", "关爱金", "", "first_premium", "percent_of_first_premium", 20.0, "policy.firstPremium"),
    ("首期基本责任保险费2倍", "", "祝贺金", "", "first_basic_responsibility_premium", "multiple_of_first_premium", 2.0, "policy.firstPremium"),
    ("固定给付3万元", "", "住院关怀金", "", "unknown", "fixed_amount", 30000.0, ""),
    ("账户价值", "", "万能账户", "", "account_value", "account_value", None, "accountValue"),
    ("实际医疗费用扣除免赔额后的80%", "", "医疗保险金", "", "medical_expense", "medical_formula", None, "actualMedicalExpense,deductible,reimbursementRate,thirdPartyPaid,liabilityLimit"),
    ("日津贴额×住院天数", "", "住院津贴", "", "daily_allowance", "daily_allowance", None, "actualDays,dailyAmount,dayLimit"),
    ("按条款载明比例给付", "", "伤残保险金", "", "schedule_or_policy_table", "schedule_or_policy_table", None, "policyScheduleTable,policyYearOrAge"),
    ("", "年交保费", "豁免", "", "annual_premium", "first_premium", None, "policy.firstPremium"),
    ("", "基本保险金额", "身故保险金", "", "basic_amount", "basic_amount", None, "policy.amount"),
    ("90天", "", "等待期", "", "rule_parameter", "not_calculable", None, ""),
    ("现金价值不展示，基本保额", "", "身故保险金", "", "basic_amount", "basic_amount", None, "policy.amount"),
    ("", "", "其他", "", "unknown", "unknown", None, ""),
]


def indicators(t) -> DataFrame:
    """Lines as indicators: formula, basis, liability, unit by the part's key, and meta."""
    k = F.col("l_partkey")
    return P.with_calculation(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[pick([r[i] for r in INDICATORS], k).alias(c) for i, c in enumerate(("formula", "basis", "liability", "unit"))]))


def sql_numbers(column: int, key: str) -> str:
    return "([" + ", ".join("NULL" if r[column] is None else str(r[column]) for r in INDICATORS) + f"]::DOUBLE[])[CAST({key} % {len(INDICATORS)} + 1 AS INT)]"


ELIGIBLE = "NOT calculation IN ('manual_formula', 'cash_value', 'account_value', 'schedule_or_policy_table', 'medical_formula', 'daily_allowance', 'not_calculable', 'unknown')"
META = f"""meta AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_pick([r[4] for r in INDICATORS], "l_partkey")} AS basis, {sql_pick([r[5] for r in INDICATORS], "l_partkey")} AS calculation, {sql_numbers(6, "l_partkey")} AS value, {sql_pick([r[7] for r in INDICATORS], "l_partkey")} AS inputs FROM lineitem)"""


@query(f"""
WITH {META} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, basis, calculation, {ELIGIBLE} AS eligible,
  CASE WHEN calculation IN ('manual_formula', 'cash_value', 'account_value', 'schedule_or_policy_table', 'medical_formula', 'daily_allowance', 'not_calculable') THEN 'code_safety_rule' ELSE 'code_inference' END AS source, inputs FROM meta""")
def calculation_keys(t):
    return indicators(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "meta.basis", "meta.calculation", "meta.eligible", "meta.source", P.required_inputs(F.col("meta")).alias("inputs"))


@query(f"""
WITH {POLICIES}, {META}, a AS (SELECT m.*, CASE calculation WHEN 'fixed_amount' THEN value WHEN 'basic_amount' THEN amount WHEN 'percent_of_basic_amount' THEN amount * value / 100 WHEN 'multiple_of_basic_amount' THEN amount * value WHEN 'first_premium' THEN premium WHEN 'percent_of_first_premium' THEN premium * value / 100
  WHEN 'multiple_of_first_premium' THEN premium * value WHEN 'total_paid_premium' THEN premium * CASE WHEN years > 0 THEN years ELSE 1 END WHEN 'percent_of_total_paid_premium' THEN premium * CASE WHEN years > 0 THEN years ELSE 1 END * value / 100 END AS x FROM meta m JOIN ctx ON policy_id = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, calculation, floor(x * 100 + 0.5) / 100 AS amount FROM a WHERE x > 0""")
def calculated_amounts(t):
    terms = relations.once_each(policies(t), ["payment"], {"years": P.payment_years(F.col("payment"))})
    rows = indicators(t).join(terms, F.col("policy_id") == F.col("l_orderkey"))
    amount = P.calculated_amount(F.col("meta"), F.col("amount"), F.col("premium"), F.col("years"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "meta.calculation", amount.alias("amount")).where("amount IS NOT NULL")


@query("""
WITH c AS (SELECT c_custkey, CAST(c_custkey % 90 AS INT) AS age FROM customer)
SELECT c_custkey, CASE WHEN age < 18 THEN '若被保险人于18周岁的保单周年日之前身故,按已交保险费' WHEN age >= 61 THEN '若61周岁及以后身故,按基本保险金额' END AS clause FROM c""")
def age_clauses(t):
    text = F.lit("身故保险金：若被保险人于18周岁的保单周年日之前身故,按已交保险费；若 61周岁及以后身故,按基本保险金额。其他。")
    return t.customer.select("c_custkey", P.age_clause(F.col("c_custkey") % 90, text).alias("clause"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal + 1000 AS e, CAST(c_custkey % 7 AS DOUBLE) * 1000 AS d, CAST(c_nationkey AS DOUBLE) * 1000 AS a FROM customer)
SELECT c_custkey, round(e * 3 + 200000, 2) AS critical, 3000000.0::DOUBLE AS medical, round(greatest(e * 5, d + e * 5 - a, 0), 2) AS accident, round(greatest(d + 500 + 100 + e * 10 - a, 0), 2) AS life, 1200.0::DOUBLE AS wealth FROM c""")
def planning_targets(t):
    e, d, a = F.col("c_acctbal") + 1000, (F.col("c_custkey") % 7).cast("double") * 1000, F.col("c_nationkey").cast("double") * 1000
    targets = P.planning_targets(e, d, F.lit(500.0), F.lit(100.0), F.lit(700.0), a)
    return t.customer.select("c_custkey", *[F.round(c, 2).alias(k) for k, c in targets.items()])


PLAN_NAMES = ["险种名称", "保单号：1", "保险金额(元):", "重疾险计划一", "本合同终止", " ", "终身寿险 分红型", "性别:男", "受益人", "年金计划"]


@query(f"SELECT p_partkey, CAST(p_partkey % 10 AS INT) IN (3, 6, 9) OR CAST(p_partkey % 10 AS INT) = 2 AS kept, {sql_pick(PLAN_NAMES, 'p_partkey')} AS plan FROM part")
def plan_rows(t):
    plan = pick(PLAN_NAMES, F.col("p_partkey"))
    return t.part.select("p_partkey", P.is_plan_name(plan).alias("kept"), plan.alias("plan"))


# --- cashflow -------------------------------------------------------------------------------------

RULE_COLUMNS = "template int, rule_no int, timing string, start_kind string, start_at int, start_param string, stop_kind string, stop_at int, stop_param string, ages array<int>, least_year int, fixed double, factor double, basis string, liability string"
RULES = [
    (0, 1, "range", "policy_year", 5, "", "pension_start", None, "", None, None, None, 0.1, "基本保额", "生存金"),
    (0, 2, "range", "param", None, "领取起始年龄", "coverage_end", None, "", None, None, None, None, "基本保额", "年金"),
    (0, 3, "maturity", "", None, "", "", None, "", None, None, None, 1.0, "max", "满期金"),
    (1, 1, "points", "", None, "", "", None, "", [18, 25, 40, 60, 66], 3, None, 0.5, "已交保费", "关爱金"),
    (1, 2, "age", "", 60, "", "", None, "", None, None, 888.0, None, "", "祝寿金"),
    (1, 3, "range", "age", 30, "", "before_param", None, "领取起始年龄", None, None, None, 0.02, "max", "成长金"),
    (2, 1, "range", "policy_year", 0, "", "param", None, "领取起始年龄", None, None, 12.5, None, "", "年金"),
    (2, 2, "range", "param", None, "没有", "coverage_end", None, "", None, None, 5.0, None, "", "从头"),
]


def with_parameters(t) -> DataFrame:
    """Policies in context, each with the parameter that its lines give: an age of 50 to 70 by the first line."""
    lines = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("policy_id"), F.lit("领取起始年龄").alias("liability"), (50 + F.col("l_partkey") % 21).cast("double").alias("value"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("ordinal"))
    return cashflow.bind_parameters(cashflow.context(policies(t)), lines)


SQL_RULE_PARAMS = "par AS (SELECT l_orderkey AS policy_id, arg_min(CAST(50 + l_partkey % 21 AS INT), l_linenumber * 100000000 + l_partkey) AS p FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)"
SQL_IN_RULES = "pc AS (SELECT ctx.*, coalesce(p, 0) AS p, CAST(policy_id % 3 AS INT) AS template, premium * years AS paid FROM ctx LEFT JOIN par USING (policy_id))"


@query(f"""
WITH {POLICIES}, {SQL_RULE_PARAMS}, {SQL_IN_RULES},
r AS (SELECT *, 1 AS rule_no, '生存金' AS liability, amount * 0.1::DOUBLE AS x, unnest(range(begin_year + 5, birth_year + 54 + 1)) AS year FROM pc WHERE template = 0
  UNION ALL SELECT *, 2, '年金', amount, unnest(range(CASE WHEN p > 0 THEN birth_year + p ELSE begin_year END, end_year)) FROM pc WHERE template = 0
  UNION ALL SELECT *, 3, '成长金', greatest(paid, amount) * 0.02::DOUBLE, unnest(range(birth_year + 30, birth_year + p)) FROM pc WHERE template = 1 AND p > 0
  UNION ALL SELECT *, 1, '年金', 12.5::DOUBLE, unnest(range(begin_year, birth_year + p)) FROM pc WHERE template = 2 AND p > 0
  UNION ALL SELECT *, 2, '从头', 5.0::DOUBLE, unnest(range(begin_year, end_year)) FROM pc WHERE template = 2),
d AS (SELECT *, CAST(NULL AS INT) AS known FROM r WHERE year BETWEEN begin_year AND end_year
  UNION ALL SELECT *, 3, '满期金', greatest(paid, amount), end_year, NULL FROM pc WHERE template = 0 AND end_year >= begin_year
  UNION ALL SELECT pc.*, 1, '关爱金', paid * 0.5::DOUBLE, birth_year + a, a FROM pc, (SELECT unnest([18, 25, 40, 60, 66]) AS a) WHERE template = 1 AND birth_year + a - begin_year >= 3 AND birth_year + a <= end_year
  UNION ALL SELECT *, 2, '祝寿金', 888.0::DOUBLE, birth_year + 60, 60 FROM pc WHERE template = 1 AND birth_year + 60 BETWEEN begin_year AND end_year),
g AS (SELECT *, {SQL_AGE.format(y="year")} AS age_then, CASE coverage WHEN '2035-06-30' THEN '20350630' WHEN '至2040年12月31日零时' THEN '20401231' WHEN '2021-02-30' THEN '20210230' END AS last FROM d)
SELECT policy_id, CAST(rule_no AS INT) AS rule_no, CAST(year AS INT) AS year, CAST(CASE WHEN known IS NOT NULL THEN known
  WHEN liability = '满期金' AND last IS NOT NULL THEN CAST(substr(last, 1, 4) AS INT) - birth_year - CASE WHEN substr(last, 5) < strftime(b, '%m%d') THEN 1 ELSE 0 END ELSE age_then END AS INT) AS age, liability, round(x, 4) AS amount FROM g WHERE x > 0""")
def template_rules(t):
    rules = t.orders.sparkSession.createDataFrame(RULES, RULE_COLUMNS)
    p = with_parameters(t).withColumn("template", (F.col("policy_id") % 3).cast("int"))
    return cashflow.expand_rules(p, rules, "template").withColumn("amount", F.round("amount", 4))


CONDITIONS = ["生效满5年至养老年金开始前", "60周岁后首个保单周年日至保障期满前", "保障期满", "30周岁后每年", "生效满3年后至届满前", "其他条件", "生效满1年，到养老年金开始前"]


@query(f"""
WITH {POLICIES}, {META}, {SQL_RULE_PARAMS}, i AS (SELECT c.*, l_linenumber, l_partkey, l_suppkey, coalesce(p, 0) AS p, {sql_pick(CONDITIONS, "l_suppkey")} AS condition, calculation, value FROM meta JOIN ctx c ON policy_id = l_orderkey LEFT JOIN par USING (policy_id)),
s AS (SELECT *, CASE WHEN condition LIKE '生效满5年%' THEN begin_year + 5 WHEN condition LIKE '60周岁%' THEN birth_year + 60 WHEN condition = '保障期满' THEN end_year WHEN condition = '30周岁后每年' THEN birth_year + 30 WHEN condition LIKE '生效满3年%' THEN begin_year + 3 WHEN condition LIKE '生效满1年%' THEN begin_year + 1 END AS y0,
  CASE WHEN condition LIKE '%养老年金开始前' THEN least(end_year - 1, birth_year + CASE WHEN p > 0 THEN p ELSE 55 END - 1) WHEN condition LIKE '60周岁%' THEN end_year - 1 WHEN condition = '保障期满' THEN end_year WHEN condition = '30周岁后每年' THEN end_year ELSE end_year - 1 END AS y1 FROM i WHERE calculation IN ('percent_of_basic_amount', 'basic_amount') AND end_year > 0),
y AS (SELECT *, unnest(range(y0, y1 + 1)) AS year FROM s WHERE y0 IS NOT NULL)
SELECT policy_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS indicator_id, CAST(year AS INT) AS year, {SQL_AGE.format(y="year")} AS age, {sql_pick([r[2] for r in INDICATORS], "l_partkey")} AS liability, floor(CASE calculation WHEN 'basic_amount' THEN amount ELSE amount * value / 100 END * 100 + 0.5) / 100 AS amount FROM y""")
def indicator_cashflow(t):
    rows = indicators(t).where("meta.calculation IN ('percent_of_basic_amount', 'basic_amount')")
    rows = rows.withColumn("indicator_id", F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).withColumn("condition", pick(CONDITIONS, F.col("l_suppkey")))
    joined = rows.join(with_parameters(t), F.col("policy_id") == F.col("l_orderkey")).withColumn("pension_age", F.coalesce(F.try_element_at("params", F.lit("领取起始年龄")), F.lit(0)).cast("int"))
    amount = P.calculated_amount(F.col("meta"), F.col("amount"), F.col("premium"), F.col("years"))
    return cashflow.expand_indicators(joined.withColumn("amount", amount))


#: Clauses of responsibility texts: name and content.
CLAUSES = [
    ("年金", "自本合同生效之日起每满三周年，按基本保险金额的10%给付"),
    ("生存金", "生效满五年的首个保单周年日起至保险期间届满之前，每年按基本保险金额的5%给付"),
    ("祝寿金", "被保险人生存至六十周岁保单生效对应日，按基本保险金额给付"),
    ("满期金", "生存至保险期间届满，按已交保费的110%给付"),
    ("教育金", "18至21周岁每年按有效保险金额的20%给付；22周岁按有效保险金额的30%给付"),
    ("关爱金", "于15周岁、25周岁、35 周岁时按基本保险金额2倍给付"),
    ("住院津贴", "住院期间按日给付津贴"),
    ("养老年金", "养老年金开始领取日（含）起至本合同保险期间届满前，按基本保险金额给付"),
    ("年金", "自本合同生效之日起至本合同保险期间届满的年生效对应日前，每年给付，首次给付为首次交纳的保险费的20%，以后每年为基本保险金额的3%"),
]


def clauses(t) -> DataFrame:
    p = with_parameters(t).withColumn("pension_age", F.coalesce(F.try_element_at("params", F.lit("领取起始年龄")), F.lit(0)).cast("int"))
    return p.withColumns({"clause_no": (F.col("policy_id") % 9).cast("int"), "name": pick([c[0] for c in CLAUSES], F.col("policy_id")), "content": pick([c[1] for c in CLAUSES], F.col("policy_id"))})


CLAUSE_YEARS = f"""{SQL_RULE_PARAMS}, {SQL_IN_RULES}, k AS (SELECT *, CAST(policy_id % 9 AS INT) AS k FROM pc),
cl AS (SELECT *, NULL::INT AS a, unnest(range(begin_year + 3, end_year + 1, 3)) AS year, floor(amount * 10 / 100 + 0.5) AS x, '年金' AS liability FROM k WHERE k = 0
  UNION ALL SELECT *, NULL, unnest(range(begin_year + 5, end_year)), floor(amount * 5 / 100 + 0.5), '生存金' FROM k WHERE k = 1
  UNION ALL SELECT *, 60, birth_year + 60, amount, '祝寿金' FROM k WHERE k = 2 AND birth_year + 60 BETWEEN begin_year AND end_year
  UNION ALL SELECT *, NULL, end_year, floor(paid * 110 / 100 + 0.5), '满期金' FROM k WHERE k = 3 AND end_year > 0 AND floor(paid * 110 / 100 + 0.5) > 0
  UNION ALL SELECT *, a, birth_year + a, floor(amount * CASE a WHEN 22 THEN 30 ELSE 20 END / 100 + 0.5), CASE a WHEN 22 THEN '深造金' ELSE '大学教育金' END FROM (SELECT *, unnest([18, 19, 20, 21, 22]) AS a FROM k WHERE k = 4) WHERE birth_year + a BETWEEN begin_year AND end_year
  UNION ALL SELECT *, a, birth_year + a, amount * 2, '关爱金' FROM (SELECT *, unnest([15, 25, 35]) AS a FROM k WHERE k = 5) WHERE birth_year + a >= begin_year
  UNION ALL SELECT *, NULL, unnest(range(birth_year + p, end_year)), amount, '养老年金' FROM k WHERE k = 7 AND p > 0
  UNION ALL SELECT *, NULL, unnest(range(begin_year, end_year)), 0, '年金' FROM k WHERE k = 8)"""


@query(f"""
WITH {POLICIES}, {CLAUSE_YEARS.replace("SELECT *, a, birth_year", "SELECT * EXCLUDE (a), a, birth_year")}
SELECT policy_id, k AS clause_no, CAST(year AS INT) AS year, CASE WHEN a IS NULL THEN {SQL_AGE.format(y="year")} ELSE a END AS age, liability, CASE WHEN k < 8 THEN x WHEN year = begin_year THEN floor(premium * 20 / 100 + 0.5) ELSE floor(amount * 3 / 100 + 0.5) END AS amount FROM cl""")
def clause_cashflow(t):
    return cashflow.expand_clauses(clauses(t))


@query("""
WITH e AS (SELECT l_orderkey AS policy_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, 2030 + l_linenumber % 2 AS year, ['满期金', '满期保险金', '年金', ' 年金'][CAST(l_partkey % 4 + 1 AS INT)] AS liability, l_quantity AS amount, ['已交保费', '基本保额', ''][CAST(l_suppkey % 3 + 1 AS INT)] AS basis, ['responsibility', 'indicator', 'indicator_source_text'][CAST(l_linenumber % 3 + 1 AS INT)] AS source,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_partkey % 2 AS VARCHAR) END AS indicator_id FROM lineitem),
s AS (SELECT *, trim(liability) AS title, CASE source WHEN 'responsibility' THEN 10 WHEN 'indicator_source_text' THEN 20 ELSE 0 END + length(trim(liability)) AS score FROM e),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, year, title ORDER BY score DESC, seq) AS k FROM s) WHERE k = 1),
f AS (SELECT *, CASE WHEN title LIKE '满期%' AND basis <> '' THEN basis END AS same FROM u),
g AS (SELECT *, first_value(seq) OVER w AS s0, first_value(source) OVER w AS c0, first_value(indicator_id) OVER w AS i0 FROM f WINDOW w AS (PARTITION BY policy_id, year, same ORDER BY seq)),
h AS (SELECT *, CASE WHEN same IS NOT NULL AND s0 <> seq AND c0 <> source AND (i0 = '' OR indicator_id = '' OR i0 = indicator_id) THEN s0 ELSE seq END AS grp FROM g)
SELECT policy_id, CAST(seq AS INT) AS seq, CAST(year AS INT) AS year, title, amount FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, year, grp ORDER BY score DESC, seq) AS m FROM h) WHERE m = 1""")
def merged_entries(t):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    entries = t.lineitem.select(
        F.col("l_orderkey").alias("policy_id"), k.alias("seq"), (2030 + F.col("l_linenumber") % 2).cast("int").alias("year"), F.lit("").alias("product"), pick(["满期金", "满期保险金", "年金", " 年金"], F.col("l_partkey")).alias("liability"), F.col("l_quantity").alias("amount"),
        pick(["已交保费", "基本保额", ""], F.col("l_suppkey")).alias("basis"), pick(["responsibility", "indicator", "indicator_source_text"], F.col("l_linenumber")).alias("source"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise((F.col("l_partkey") % 2).cast("string")).alias("indicator_id"),
    )
    return cashflow.merge_entries(entries).select("policy_id", "seq", "year", F.trim("liability").alias("title"), "amount")


@query("""
WITH a AS (SELECT o_orderkey AS policy_id, 'template' AS source, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS amount FROM orders WHERE o_orderkey % 4 = 0),
b AS (SELECT l_orderkey AS policy_id, CAST(year(l_shipdate) AS INT) AS year, max(l_extendedprice) AS amount FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1, 2),
c AS (SELECT o_orderkey AS policy_id, CAST(year(o_orderdate) + 1 AS INT) AS year, o_totalprice AS amount FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0)
SELECT policy_id, year, source, amount FROM a UNION ALL SELECT policy_id, year, 'responsibility', amount FROM b UNION ALL SELECT c.policy_id, c.year, 'indicator', c.amount FROM c LEFT JOIN b USING (policy_id, year) WHERE b.policy_id IS NULL""")
def cashflow_tiers(t):
    def entry(df: DataFrame, source: str, seq: int) -> DataFrame:
        return df.select("policy_id", F.lit(seq).alias("seq"), "year", F.lit("").alias("product"), F.lit("年金").alias("liability"), "amount", F.lit("").alias("basis"), F.lit(source).alias("source"), F.lit("").alias("indicator_id"))

    orders = t.orders.select(F.col("o_orderkey").alias("policy_id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount"))
    templates = orders.where("policy_id % 4 = 0")
    texts = t.lineitem.groupBy(F.col("l_orderkey").alias("policy_id"), F.year("l_shipdate").alias("year")).agg(F.max("l_extendedprice").alias("amount"))
    others = orders.where("policy_id % 5 = 0").withColumn("year", F.col("year") + 1)
    return cashflow.by_tier(entry(templates, "template", 0), entry(texts, "responsibility", 1), entry(others, "indicator", 2), templates).select("policy_id", "year", "source", "amount")


@query(f"""
WITH {POLICIES}, {META}, j AS (SELECT m.*, c.amount, c.premium, c.years, CASE WHEN c.years >= 1 THEN c.years ELSE 1 END AS py, {sql_pick([r[0] for r in INDICATORS], "l_partkey")} AS formula, {sql_pick([r[2] for r in INDICATORS], "l_partkey")} AS liability FROM meta m JOIN ctx c ON policy_id = l_orderkey WHERE calculation NOT IN ('cash_value', 'account_value', 'schedule_or_policy_table', 'medical_formula', 'daily_allowance', 'not_calculable'))
SELECT l_orderkey AS policy_id, liability AS scenario, round(floor(CASE calculation WHEN 'fixed_amount' THEN value WHEN 'percent_of_basic_amount' THEN amount * value / 100 WHEN 'multiple_of_basic_amount' THEN amount * value WHEN 'percent_of_total_paid_premium' THEN premium * CASE WHEN years > 0 THEN years ELSE 1 END * value / 100
  WHEN 'total_paid_premium' THEN premium * CASE WHEN years > 0 THEN years ELSE 1 END WHEN 'percent_of_first_premium' THEN premium * value / 100 WHEN 'multiple_of_first_premium' THEN premium * value WHEN 'first_premium' THEN premium ELSE amount END * 100 + 0.5) / 100, 2) AS amount FROM j""")
def scenario_amounts(t):
    rows = indicators(t).join(policies(t), F.col("policy_id") == F.col("l_orderkey")).withColumns({"coverage_type": F.lit(""), "value": F.lit(None).cast("double")})
    return cashflow.scenarios(rows).select("policy_id", "scenario", F.round("amount", 2).alias("amount"))
