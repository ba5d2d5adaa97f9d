"""Column builders for policy texts: dates, terms, numerals, validity, calculation keys and amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import compact, half_up
from larkspur.operators.relations import once_each

# --- dates ----------------------------------------------------------------------------------------

#: A day as text, by year, month and day in Western or Chinese writing.
DAY = r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})"
LONG_DAY = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})"
SHORT_DAY = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
WHOLE_LIFE_AGE = 105


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the calendar has no such day."""
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def parts_day(parts: Column) -> Column:
    """The day of date parts, if the calendar has it."""
    return _day(parts["year"], parts["month"], parts["day"])


def date_parts(c: Column) -> Column:
    """year, month and day of the first date in a text; NULL without one or with month or day out of range."""
    y, m, d = (_int(F.regexp_extract(c, DAY, i)) for i in (1, 2, 3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def text_date(c: Column) -> Column:
    """The first date in a text, if the calendar has it."""
    long, short = ([_int(F.regexp_extract(c, p, i)) for i in (1, 2, 3)] for p in (LONG_DAY, SHORT_DAY))
    return F.when(long[0].isNotNull(), _day(*long)).when(short[0].isNotNull(), _day(*short))


def roll_years(d: Column, years: Column) -> Column:
    """The same day some years on, 29 February becoming 1 March where needed."""
    y = F.year(d) + years
    return F.coalesce(_day(y, F.month(d), F.dayofmonth(d)), _day(y, F.lit(3), F.lit(1)))


def payment_years(term: Column, default: int | None = 0) -> Column:
    """Years in which premiums are due: lump sums 1, else the number before 年 or 期."""
    t = compact(term)
    years, times = F.regexp_extract(t, r"(\d+(?:\.\d+)?)年", 1), F.regexp_extract(t, r"(\d+(?:\.\d+)?)期", 1)
    return (
        F.when(t.rlike("趸交|一次交清"), F.lit(1.0))
        .when(years != "", years.cast("double"))
        .when(times != "", times.cast("double"))
        .otherwise(F.lit(default).cast("double"))
    )


def whole_payment_years(term: Column) -> Column:
    """As payment_years, in whole years, 1 at least; NULL if the text names none."""
    return F.greatest(F.floor(payment_years(term, None)), F.lit(1)).cast("int") * F.when(payment_years(term, None).isNotNull(), 1)


def cover_facts(term: Column) -> Column:
    """What the text of a term says, as far as it does not depend on the policy: a struct that the two functions below read."""
    text = F.trim(F.coalesce(term, F.lit("")))
    tight = F.regexp_replace(text, r"\s+", "")
    return F.struct(
        text.contains("终身").alias("whole"),
        _int(F.regexp_extract(compact(text), r"(?:至|保至)?(\d{1,3})(?:周岁|岁)", 1)).alias("age"),
        _int(F.regexp_extract(text, r"(\d{4})[年\-]\d{1,2}[月\-]\d{1,2}", 1)).alias("day_year"),
        _int(F.regexp_extract(text, r"(\d+)\s*年", 1)).alias("years"),
        ((text == "") | text.rlike("终身|长期|至身故|身故")).alias("open"),
        text.rlike("零时|0时|00:00|凌晨").alias("midnight"),
        text_date(text).alias("day"),
        _int(F.regexp_extract(tight, r"^(?:保险期间|保障期间)?(\d{1,3})年(?:期)?$", 1)).alias("only_years"),
        _int(F.regexp_extract(tight, r"(?:至|保至)(\d{1,3})(?:周岁|岁)", 1)).alias("to_age"),
        date_parts(text).alias("parts"),
    )


def end_year(facts: Column, effective: Column, born: Column) -> Column:
    """Last year of cover, by date parts: whole life, to an age, to a day, or for some years; 0 if the text says nothing."""
    return (
        F.when(facts["whole"] & born.isNotNull(), born["year"] + WHOLE_LIFE_AGE)
        .when(facts["age"].isNotNull() & born.isNotNull(), born["year"] + facts["age"])
        .when(facts["day_year"].isNotNull(), facts["day_year"])
        .when(facts["years"].isNotNull() & effective.isNotNull(), effective["year"] + facts["years"])
        .otherwise(0)
    )


def end_moment(facts: Column, start: Column, born: Column) -> Column:
    """The moment when cover ends, by dates: the last of the day, or its first where the text says so; NULL if open or unknown."""
    last = F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")
    moment = lambda d: d.cast("timestamp_ntz") + last
    return F.when(~facts["open"], F.coalesce(
        F.when(facts["midnight"], facts["day"].cast("timestamp_ntz")).otherwise(moment(facts["day"])),
        moment(F.date_sub(roll_years(start, facts["only_years"]), 1)),
        moment(roll_years(born, facts["to_age"])),
    ))


def coverage_end_year(term: Column, effective: Column, birthday: Column) -> Column:
    """`end_year` of texts."""
    return end_year(cover_facts(term), date_parts(effective), date_parts(birthday))


def coverage_end(term: Column, effective: Column, birthday: Column) -> Column:
    """`end_moment` of texts."""
    return end_moment(cover_facts(term), text_date(effective), text_date(birthday))


def parts_age(born: Column, on: Column) -> Column:
    """Whole years from one set of date parts to another; NULL before birth."""
    age = on["year"] - born["year"] - F.when(on["month"] * 100 + on["day"] < born["month"] * 100 + born["day"], 1).otherwise(0)
    return F.when(age >= 0, age)


def age_in_year(year: Column, first: Column, born: Column) -> Column:
    """Age at the policy's anniversary in a calendar year; before its first year, or before birth, years since birth.

    first: a date, born: date parts, best held in columns, since this is asked for many years. The anniversary is the day of
    the first one, or the last of its month if that is earlier; only where the months are equal does the day matter.
    """
    leap = (F.month(first) == 2) & (F.dayofmonth(first) == 29) & ~((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)))
    on = F.month(first) * 100 + F.dayofmonth(first) - leap.cast("int")
    age = year - born["year"] - (on < born["month"] * 100 + born["day"]).cast("int")
    return F.coalesce(F.when((year >= F.year(first)) & (age >= 0), age), year - born["year"])


def age_at_end(facts: Column, end_year: Column, first: Column, born: Column) -> Column:
    """Age on the day that the term names, else in the last year of cover."""
    return F.coalesce(parts_age(born, facts["parts"]), F.when(end_year > 0, age_in_year(end_year, first, born)))


#: States that end or suspend a policy, and those that confirm it.
INACTIVE = r"(?i)(?:失效|停效|中止|终止|退保|过期|作废|无效|待生效|审核中|pending|future|unknown|archived|inactive|expired|lapsed|terminated|surrendered|cancelled|canceled|void)"
ACTIVE = r"(?i)^(?:有效|生效|承保|正常|active|valid|in[_\s-]?force)$"


def record_validity(statuses: list[Column], expired: Column, effective: Column, term: Column, birthday: Column, now: Column) -> Column:
    """inactive, unknown, future, expired or active, by state texts, the first day and the end of cover, in this order."""
    clean = [F.trim(F.coalesce(s, F.lit(""))) for s in statuses]
    any_of = lambda p: reduce(lambda a, b: a | b, [c.rlike(p) for c in clean])
    return (
        F.when(F.coalesce(expired, F.lit(False)) | any_of(INACTIVE), "inactive")
        .when(~any_of(ACTIVE), "unknown")
        .when(text_date(effective) > now, "future")
        .when(coverage_end(term, effective, birthday) < now.cast("timestamp_ntz"), "expired")
        .otherwise("active")
    )


# --- numerals -------------------------------------------------------------------------------------

#: Numerals and what they stand for.
DIGITS, VALUES = "零〇一二两三四五六七八九", "001223456789"


def _digit(c: Column) -> Column:
    return F.when(c.rlike(f"^[{DIGITS}]$"), F.translate(c, DIGITS, VALUES).cast("int"))


def chinese_integer(c: Column) -> Column:
    """A whole number in digits or in numerals below a thousand; 0 if it is neither."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")

    def below_hundred(t: Column) -> Column:
        head, tail = F.substring_index(t, "十", 1), F.regexp_replace(t, "^[^十]*十", "")
        tens, ones = F.when(head == "", 1).otherwise(_digit(head)), F.when(tail == "", 0).otherwise(_digit(tail))
        return F.coalesce(F.when(t.rlike(r"^\d+$"), t.try_cast("int")), _digit(t), F.when(t.contains("十"), tens * 10 + ones), F.lit(0))

    head, tail = F.substring_index(text, "百", 1), F.regexp_replace(text, "^[^百]*百", "")
    hundreds = F.when(head == "", 1).otherwise(_digit(head))
    return F.coalesce(F.when(text.contains("百"), hundreds * 100 + F.when(tail == "", 0).otherwise(below_hundred(tail))), below_hundred(text))


def chinese_percent(c: Column) -> Column:
    """The number after 百分之: digits, or tens in numerals; NULL without one."""
    digits = F.regexp_extract(c, r"百分之(\d+(?:\.\d+)?)", 1)
    # 九十 is looked for before 十, so the longer reading wins
    tens = [(w, F.lit(float(v))) for w, v in zip("九十 八十 七十 六十 五十 四十 三十 二十 十".split(), range(90, 0, -10))]
    first, *rest = tens
    worded = reduce(lambda a, x: a.when(c.contains("百分之" + x[0]), x[1]), rest, F.when(c.contains("百分之" + first[0]), first[1]))
    return F.when(c.rlike("百分之(?:一百|百)"), F.lit(100.0)).when(digits != "", digits.cast("double")).otherwise(worded)


def chinese_multiple(c: Column) -> Column:
    """The first number in digits, else a single numeral up to ten; NULL for neither."""
    text = F.trim(c)
    digits = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0)
    return F.when(digits != "", digits.cast("double")).when(text == "十", F.lit(10.0)).when(text.rlike("^[一二两三四五六七八九]$"), _digit(text).cast("double"))


def cell_number(c: Column) -> Column:
    """A number read from a table cell: separators and currency out, a colon before two last digits a point; else NULL."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?<=\d)[:：](?=\d{2}$)", "."), r"[,，\s元¥￥]", "")
    return F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))


def cell_policy_year(c: Column) -> Column:
    """A policy year from 1 to 150, written as `第5年末` or as a whole number; else NULL."""
    text = F.regexp_replace(c, r"[｜|\s]", "")
    named = F.regexp_extract(text, r"^(?:第)?(\d{1,3})(?:个)?年(?:度)?(?:末|未|木|底)?$", 1)
    plain = cell_number(text)
    whole = F.when(~text.rlike(r"[.．]") & (plain == F.floor(plain)), plain.cast("int"))
    got = F.when(named != "", _int(named)).otherwise(whole)
    return F.when(got.between(1, 150), got)


def cell_year_age(c: Column) -> Column:
    """year and age of a cell such as `2030/42`; else NULL."""
    pattern = r"^(\d{4})\s*[/／]\s*(\d{1,3})$"
    year = _int(F.regexp_extract(c, pattern, 1))
    return F.when(year.isNotNull(), F.struct(year.alias("year"), _int(F.regexp_extract(c, pattern, 2)).alias("age")))


# --- calculation ----------------------------------------------------------------------------------

#: Phrases that name what an amount is worked out from.
CASH = "现金价值|现价"
ACCOUNT = "账户价值|账户余额|个人账户|公共账户|账户|帐户"
FIRST = "首次.{0,20}(?:保险费|保费)|首期.{0,20}(?:保险费|保费)|首年.{0,20}(?:保险费|保费)"
PAID = "已交|已支付|所交|实际交纳|累计.{0,8}(?:保险费|保费)|(?:保险费|保费)之和"
ANNUAL = "年交保费|年缴保费|年度保险费|每年.{0,10}(?:保险费|保费)"
EXPENSE = "医疗费用|实际合理医疗费用|实际合理[^。；;，,]{0,20}费用|实际[^。；;，,]{0,20}费用|免赔额|报销|补偿"
DAILY = "给付天数|给付日数|住院天数|住院日数|实际日数|入住.{0,8}(?:天数|日数)|日津贴额|住院日额|保险单位数"
BASIC = "基本责任保险金额|基本保险金额|基本保险金|基本保额|有效保险金额|保险金额|保额"
TABLE = "条款载明|条款表|约定领取比例|领取计划|领取频率|领取金额|给付比例|赔付比例|赔偿比例|伤残等级|比例表|领取年龄"
FORMULA_TABLE = TABLE + "|保险单载明|保单载明"
UNCERTAIN = "(?i)(?:max|较大者|较高者|最大者|取大|两者|三者|条件给付|约定情形)"
PARAMETER = "等待期|赔付方式|领取起始年龄|开始领取年龄|领取年龄|缴费年期"
#: Pairs of basis and calculation that a given decision may name.
GIVEN = [
    "basic_amount:basic_amount", "basic_amount:percent_of_basic_amount", "basic_amount:multiple_of_basic_amount",
    "first_premium:first_premium", "first_premium:percent_of_first_premium", "first_premium:multiple_of_first_premium",
    "first_basic_responsibility_premium:first_premium", "first_basic_responsibility_premium:percent_of_first_premium", "first_basic_responsibility_premium:multiple_of_first_premium",
    "annual_premium:first_premium", "annual_premium:percent_of_first_premium", "annual_premium:multiple_of_first_premium",
    "total_paid_premium:total_paid_premium", "total_paid_premium:percent_of_total_paid_premium", "total_paid_premium:multiple_of_total_paid_premium",
    "unknown:fixed_amount",
]
#: Inputs that a calculation needs, by calculation key.
INPUTS = [
    (["fixed_amount"], [], []),
    (["basic_amount", "percent_of_basic_amount", "multiple_of_basic_amount"], ["basic_amount"], ["policy.amount"]),
    (["first_premium", "percent_of_first_premium", "multiple_of_first_premium"], ["first_premium", "first_basic_responsibility_premium", "annual_premium"], ["policy.firstPremium"]),
    (["total_paid_premium", "percent_of_total_paid_premium", "multiple_of_total_paid_premium"], ["total_paid_premium"], ["policy.firstPremium", "policy.paymentPeriodYears"]),
    (["cash_value"], ["cash_value"], ["cashValue", "policyYear"]),
    (["account_value"], ["account_value"], ["accountValue"]),
    (["schedule_or_policy_table"], ["schedule_or_policy_table"], ["policyScheduleTable", "policyYearOrAge"]),
    (["medical_formula"], ["medical_expense"], ["actualMedicalExpense", "deductible", "reimbursementRate", "thirdPartyPaid", "liabilityLimit"]),
    (["daily_allowance"], ["daily_allowance"], ["actualDays", "dailyAmount", "dayLimit"]),
    (["manual_formula"], [], ["manualFormulaInputs"]),
]

AMOUNT_WORDS = "基本保险金额|基本保险金|基本保额|保险金额|有效保险金额|保险费|保费"
FACTORS = [
    r"[×xX*]\s*(\d+(?:\.\d+)?)\s*(%|％|倍)",
    rf"(?:{AMOUNT_WORDS})[^。；;，,]{{0,24}}?(\d+(?:\.\d+)?)\s*(%|％|倍)",
    rf"(\d+(?:\.\d+)?)\s*(%|％|倍)[^。；;，,]{{0,12}}?(?:{AMOUNT_WORDS})",
]
MONEY = r"(\d+(?:\.\d+)?)\s*(万)?\s*(元|圆)"


def _join(*parts: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def numeric_spec(value: Column, unit: Column, *texts: Column) -> Column:
    """value and unit of an indicator: as given, else a factor or an amount of money found in its texts."""
    text, given = _join(*texts), F.trim(F.coalesce(unit, F.lit("")))
    out = F.when(value.isNotNull() & (given != ""), F.struct(value.cast("double").alias("value"), given.alias("unit")))
    for p in FACTORS:
        number, sign = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)
        out = out.when(number != "", F.struct(number.cast("double").alias("value"), F.replace(sign, F.lit("％"), F.lit("%")).alias("unit")))
    money = F.regexp_extract(text, MONEY, 1)
    worth = money.cast("double") * F.when(F.regexp_extract(text, MONEY, 2) != "", 10000).otherwise(1)
    out = out.when(money != "", F.struct(worth.alias("value"), F.lit("元").alias("unit")))
    return out.otherwise(F.struct(F.lit(None).cast("double").alias("value"), given.alias("unit")))


#: Texts of an indicator from which its calculation is told, in this order.
STATUSES = ["status", "quality_status", "scope"]
DECISION = ["value", "basis_key", "calculation_key", "decided_by", "excluded", "marked", "metadata_version"]
TEXTS = ["coverage_type", "liability", "formula", "basis", "unit", "value_text", "condition", "excerpt"]


def let(value: Column, body) -> Column:
    """body(value), worked out once however often body names it: also where a filter takes the expression along."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_calculation(rows: DataFrame, name: str = "meta") -> DataFrame:
    """Adds a struct basis, calculation, eligible, source, value, unit to indicators, by rules whose order matters.

    rows may hold TEXTS, value, STATUSES, excluded, marked (eligible as given) and metadata_version and, where a decision is
    given, basis_key, calculation_key and decided_by; columns that are missing count as blank. Rows that are excluded, or
    marked not eligible without any metadata, are rule parameters. The texts are many times the same, so each
    distinct row of inputs is worked out once.
    """
    inputs = [c for c in [*TEXTS, *STATUSES, *DECISION] if c in rows.columns]
    return once_each(rows, inputs, {name: calculation(set(inputs))})


def calculation(has: set[str]) -> Column:
    """The struct of `with_calculation`, from the columns that there are."""
    get = lambda k: F.coalesce(F.col(k), F.lit("")) if k in has else F.lit("")
    flag = lambda k, is_: F.coalesce(F.col(k) == is_, F.lit(False)) if k in has else F.lit(False)
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    first_of = lambda c: F.when(c.contains("基本责任"), "first_basic_responsibility_premium").otherwise("first_premium")
    read = F.struct(
        tight(get("basis")).alias("basis"),
        F.regexp_replace(tight(get("formula")), "现金价值不展示|现金价值不统计|现金价值不参与展示", "").alias("formula"),
        tight(_join(*[get(k) for k in TEXTS], sep="")).alias("text"),
        F.trim(get("liability")).alias("liability"),
        numeric_spec(F.col("value") if "value" in has else F.lit(None), get("unit"), get("formula"), get("value_text"), get("excerpt")).alias("spec"),
    )

    def told(x: Column) -> Column:
        basis, formula, text = x["basis"], x["formula"], x["text"]
        parameter = (
            (F.trim(get("coverage_type")) == "规则参数")
            | tight(_join(*[get(k) for k in STATUSES])).rlike("rule_parameter|not_quantifiable|non_calculable|unquantifiable")
            | flag("excluded", True)
            | (flag("marked", False) & (F.trim(get("metadata_version")) == "") & (F.trim(get("basis_key")) == "") & (F.trim(get("calculation_key")) == ""))
            | x["liability"].rlike(f"^(?:{PARAMETER})$")
            | text.rlike("保险责任赔付机制|豁免后续应交保险费|后续应交保险费|后续保险费")
        )
        named = (
            F.when(formula.rlike(CASH), "cash_value")
            .when(formula.rlike(ACCOUNT), "account_value")
            .when(formula.rlike(FIRST), first_of(formula))
            .when(formula.rlike(PAID), "total_paid_premium")
            .when(formula.rlike(EXPENSE), "medical_expense")
            .when(formula.rlike(DAILY), "daily_allowance")
            .when(formula.rlike(BASIC), "basic_amount")
            .when(either(formula, basis).rlike(FORMULA_TABLE), "schedule_or_policy_table")
            .when(text.rlike(FIRST), first_of(text))
            .when(text.rlike(ANNUAL), "annual_premium")
            .when(text.rlike(PAID), "total_paid_premium")
            .when(text.rlike(CASH), "cash_value")
            .when(text.rlike(ACCOUNT), "account_value")
            .when(text.rlike(EXPENSE), "medical_expense")
            .when(either(basis, formula).rlike(DAILY), "daily_allowance")
            .when(either(basis, formula).rlike(BASIC), "basic_amount")
            .when(text.rlike(TABLE), "schedule_or_policy_table")
            .when(text.rlike(DAILY), "daily_allowance")
        )
        basic = text.rlike("基本保险金额|基本保险金|基本保额|保险金额")
        unit = F.replace(x["spec"]["unit"], F.lit("％"), F.lit("%"))
        return F.struct(parameter.alias("rule"), named.alias("named"), either(formula, text).rlike(UNCERTAIN).alias("unsure"), basic.alias("basic"), x["spec"]["value"].alias("value"), unit.alias("unit"))

    def decided(x: Column) -> Column:
        given_basis, given_key = F.trim(get("basis_key")), F.trim(get("calculation_key"))
        given = (given_key != "") & F.concat_ws(":", either(given_basis, F.lit("unknown")), given_key).isin(GIVEN) & (x["named"].isNull() | (x["named"] == given_basis))
        key = F.coalesce(x["named"], F.when(given, either(given_basis, F.lit("unknown"))))
        return F.struct(key.alias("key"), F.when(given, given_key).alias("given"), *[x[c].alias(c) for c in ("rule", "unsure", "basic", "value", "unit")])

    def worked(x: Column) -> Column:
        key, value, unit = x["key"], x["value"], x["unit"]
        premium = key.isin("first_premium", "first_basic_responsibility_premium", "annual_premium")
        percent, times = value.isNotNull() & (unit == "%"), value.isNotNull() & (unit == "倍")
        unsafe = F.when(x["unsure"], "manual_formula").when(key.isin("cash_value", "account_value", "schedule_or_policy_table", "daily_allowance"), key).when(key == "medical_expense", "medical_formula")
        plain = (
            F.when(x["given"].isNotNull(), x["given"])
            .when(value.isNotNull() & unit.rlike("^(?:元|圆)$"), "fixed_amount")
            .when((key == "basic_amount") & percent, "percent_of_basic_amount")
            .when((key == "basic_amount") & times, "multiple_of_basic_amount")
            .when((key == "basic_amount") & unit.rlike("公式|^$") & x["basic"], "basic_amount")
            .when(premium & percent, "percent_of_first_premium")
            .when(premium & times, "multiple_of_first_premium")
            .when(premium, "first_premium")
            .when((key == "total_paid_premium") & percent, "percent_of_total_paid_premium")
            .when((key == "total_paid_premium") & times, "multiple_of_total_paid_premium")
            .when(key == "total_paid_premium", "total_paid_premium")
        )
        return F.struct(unsafe.alias("unsafe"), plain.alias("plain"), *[x[c].alias(c) for c in ("key", "given", "rule", "value", "unit")])

    def final(x: Column) -> Column:
        return F.struct(
            F.when(x["rule"], "rule_parameter").otherwise(F.coalesce(x["key"], F.lit("unknown"))).alias("basis"),
            F.when(x["rule"], "not_calculable").otherwise(F.coalesce(x["unsafe"], x["plain"], F.lit("unknown"))).alias("calculation"),
            (~x["rule"] & x["unsafe"].isNull() & x["plain"].isNotNull() & ~(x["given"].isNotNull() & flag("marked", False))).alias("eligible"),
            F.when(x["rule"] | x["unsafe"].isNotNull(), "code_safety_rule").when(x["given"].isNotNull(), F.when(F.trim(get("decided_by")) == "model_semantic", "model_semantic").otherwise("structured_semantic")).otherwise("code_inference").alias("source"),
            x["value"].alias("value"),
            x["unit"].alias("unit"),
        )

    return let(let(let(let(read, told), decided), worked), final)


def calculated_amount(meta: Column, base: Column, premium: Column, years: Column) -> Column:
    """Amount of an eligible calculation, rounded half up to cents; NULL where it is not positive or not eligible."""
    paid, value = premium * F.when(years > 0, years).otherwise(1), F.coalesce(meta["value"], F.lit(0.0))
    amount = None
    for name, of in (("basic_amount", base), ("first_premium", premium), ("total_paid_premium", paid)):
        for key, worth in ((name, of), (f"percent_of_{name}", of * value / 100), (f"multiple_of_{name}", of * value)):
            amount = (F if amount is None else amount).when(meta["calculation"] == key, worth)
    amount = half_up(amount.when(meta["calculation"] == "fixed_amount", value), 2)
    return F.when(meta["eligible"] & (amount > 0), amount)


def required_inputs(meta: Column) -> Column:
    """Inputs that the calculation or, failing that, its basis needs, joined by commas; the first line that fits counts."""
    fits = lambda keys, bases: meta["calculation"].isin(keys) | (meta["basis"].isin(bases) if bases else F.lit(False))
    return reduce(lambda a, x: a.when(fits(x[0], x[1]), ",".join(x[2])), INPUTS[1:], F.when(fits(INPUTS[0][0], INPUTS[0][1]), "")).otherwise("")


def age_clause(age: Column, *texts: Column) -> Column:
    """The first clause on an age before or after which the insured now is; NULL without one."""
    text = F.regexp_replace(_join(*texts), r"\s+", "")
    clauses = F.transform(F.split(text, "(?=若)"), lambda c: F.regexp_extract(c, "^[^。；;]*", 0))
    pattern = r"(\d{1,3})周岁[^。；;]{0,40}?(之前|以前|前|以后|及以后|后)"

    def applies(c: Column) -> Column:
        limit, side = F.regexp_extract(c, pattern, 1).try_cast("int"), F.regexp_extract(c, pattern, 2)
        return F.when(side.contains("前"), age < limit).otherwise(age >= limit) & (side != "")

    return F.get(F.filter(clauses, applies), F.lit(0))


def planning_targets(expense: Column, debt: Column, education: Column, parents: Column, retirement: Column, assets: Column, *, recovery_years: float = 3, recovery_reserve: float = 200_000, medical: float = 3_000_000, accident_years: float = 5, life_years: float = 10) -> dict[str, Column]:
    """Wanted cover of a family by dimension."""
    return {
        "critical": expense * recovery_years + recovery_reserve,
        "medical": F.lit(float(medical)),
        "accident": F.greatest(expense * accident_years, debt + expense * accident_years - assets, F.lit(0.0)),
        "life": F.greatest(debt + education + parents + expense * life_years - assets, F.lit(0.0)),
        "wealth": F.greatest(education + retirement, F.lit(0.0)),
    }


#: Headings and labels that are no plan names.
PLAN_HEADINGS = "险种名称 子险种名称 保单号 险种性质 保单生效日 保单期满日 合同成立日期 每期交费日 每期缴费日 交费方式 缴费方式 交费期间 缴费期间 交费期满日 缴费期满日 保险金额 保险金额元 标准保费 标准保费元 加费 加费元 出生日期 性别 受益顺序 受益人 与被保险人关系 受益份额 证件名称 证件号码 币种 特别约定 可选责任 可选责任的约定 基本责任 基本责任的约定 营业单位代码 销售人员代码 营业单位名称 销售人员姓名".split()
PLAN_LABELS = r"^(?:保单(?:生效日|期满日|号|状态)[:：]|合同(?:成立日期|生效日期|终止日期)[:：]|险种性质[:：]|(?:每期)?[交缴]费日[:：]|[交缴]费(?:方式|期间|期满日)[:：]|被?保险人姓名[:：]|投保人姓名[:：]|保险金额(?:元)?[:：]|币种[:：]|特别约定[:：]|营业单位(?:代码|名称)[:：]|销售人员(?:代码|姓名)[:：]|标准保费|加费|出生日期|性别|受益(?:顺序|人|份额)|与被保险人关系|证件(?:名称|号码)|可选责任|基本责任)"
PLAN_CLAUSES = "本合同|保险期间内|不得变更|经确定"


def is_plan_name(c: Column) -> Column:
    """Whether a text can name a plan: not blank, no heading or label of a form, no clause."""
    name = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return (name != "") & ~name.isin(PLAN_HEADINGS) & ~name.rlike(PLAN_CLAUSES) & ~name.rlike(PLAN_LABELS)
