"""Yearly cashflow of policies: rules of templates, conditions of indicators, clauses of responsibility texts.

Everything is declared per policy and exploded into years, so the work is one narrow map over policies and one
window per policy; no step brings policies together. Arrays are exploded with their empty ones kept and then let go: a
plain explode would make the optimiser copy the whole expression of the years into a filter below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import policy as P
from larkspur.functions.columns import half_up
from larkspur.operators.relations import best_per_key, once_each

#: Default age at which a pension starts, where no parameter says so.
PENSION_AGE = 55
#: Rules that are sent to all tasks; more are joined by their template's key.
MOST_BROADCAST_RULES = 10_000


def context(policies: DataFrame) -> DataFrame:
    """Adds effective_year, birth_year, end_year, total_premium, first_day, born (date parts), end_age and years (of payment) to policies.

    policies: policy_id, effective, birthday, coverage, payment (texts), amount, premium. Texts repeat over policies, so
    each one is read once.
    """
    read = with_terms(policies)
    year = lambda c: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int"), F.lit(0))
    read = read.withColumns({"effective_year": year(F.col("effective")), "birth_year": year(F.col("birthday")), "total_premium": F.col("premium") * F.col("years"), "first_day": P.parts_day(F.col("begun")), "end_year": P.end_year(F.col("cover"), F.col("begun"), F.col("born"))})
    read = read.withColumn("end_age", P.age_at_end(F.col("cover"), F.col("end_year"), F.col("first_day"), F.col("born")))
    return read.select(*policies.columns, "effective_year", "birth_year", "end_year", "total_premium", "first_day", "born", "end_age", "years")


def with_terms(policies: DataFrame) -> DataFrame:
    """Adds what the texts of policies say: cover (facts), years, whole_years, begun and born (date parts), begun_on and born_on (dates)."""
    for column, made in (
        ("coverage", {"cover": P.cover_facts(F.col("coverage"))}),
        ("payment", {"years": P.payment_years(F.col("payment")), "whole_years": P.whole_payment_years(F.col("payment"))}),
        ("effective", {"begun": P.date_parts(F.col("effective")), "begun_on": P.text_date(F.col("effective"))}),
        ("birthday", {"born": P.date_parts(F.col("birthday")), "born_on": P.text_date(F.col("birthday"))}),
    ):
        policies = once_each(policies, [column], made)
    return policies


def bind_parameters(policies: DataFrame, indicators: DataFrame, on: str = "policy_id") -> DataFrame:
    """Adds params: a map from an indicator's liability to the value of its first row by ordinal."""
    first = best_per_key(indicators.where(F.col("value").isNotNull()), [on, "liability"], [F.col("ordinal")])
    maps = first.groupBy(on).agg(F.map_from_entries(F.collect_list(F.struct("liability", "value"))).alias("params"))
    return policies.join(maps, on, "left")


def timing_bound(kind: Column, number: Column, param: Column, end: bool) -> Column:
    """Calendar year of a bound: policy_year, age, pension_start, coverage_end, param (an age) or before_param; 0 if unknown."""
    age = F.coalesce(F.try_element_at(F.col("params"), param), F.lit(0)).cast("int")
    birth = F.col("birth_year")
    return (
        F.when(kind == "policy_year", F.col("effective_year") + number)
        .when(kind == "age", birth + number)
        .when(kind == "pension_start", birth + PENSION_AGE - 1)
        .when(kind == "coverage_end", F.col("end_year") - 1)
        .when((kind == "param") & (age > 0), birth + age - (1 if end else 0))
        .when((kind == "before_param") & (age > 0), birth + age - 1)
        .otherwise(0)
    )


def rule_amount(fixed: Column, factor: Column, basis: Column) -> Column:
    """A fixed amount, or a factor times the basic amount, the premiums paid, or the larger of both; else 0."""
    times, base, paid = F.coalesce(factor, F.lit(1.0)), F.col("amount"), F.col("total_premium")
    return F.coalesce(
        fixed,
        F.when(basis == "基本保额", base * times).when(basis == "已交保费", paid * times).when(basis == "max", F.greatest(paid, base) * times),
        F.lit(0.0),
    )


def expand_rules(policies: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """policy_id, rule_no, year, age, liability, amount: each rule of a policy's template as yearly entries.

    policies: what `context` and `bind_parameters` give, with the template's key. rules: key, rule_no, timing (range,
    points, age, maturity), start_kind, start_at, start_param, stop_kind, stop_at, stop_param, ages, least_year, fixed,
    factor, basis, liability. Years before the policy begins or after it ends do not occur.
    """
    few = rules.limit(MOST_BROADCAST_RULES + 1).count() <= MOST_BROADCAST_RULES
    p = policies.join(F.broadcast(rules) if few else rules, on)
    begin, end, birth = F.col("effective_year"), F.col("end_year"), F.col("birth_year")
    first = timing_bound(F.col("start_kind"), F.col("start_at"), F.col("start_param"), False)
    last = timing_bound(F.col("stop_kind"), F.col("stop_at"), F.col("stop_param"), True)
    p = p.withColumns({"_lo": F.greatest(first, begin).cast("int"), "_hi": F.least(last, end).cast("int")})
    lo, hi = F.col("_lo"), F.col("_hi")
    # Years only travel through the arrays; ages are told afterwards, in generated code.
    at_ages = F.transform(F.coalesce("ages", F.array().cast("array<int>")), lambda a: (birth + a).cast("int"))
    late = F.coalesce(F.col("least_year"), F.lit(0))
    years = (
        F.when((F.col("timing") == "range") & (lo <= hi), F.sequence(lo.cast("int"), hi.cast("int")))
        .when(F.col("timing") == "points", F.filter(at_ages, lambda y: (y >= begin) & (y <= end) & (y - begin >= late)))
        .when((F.col("timing") == "age") & (birth + F.col("start_at")).between(begin, end), F.array((birth + F.col("start_at")).cast("int")))
        .when((F.col("timing") == "maturity") & (end >= begin), F.array(end.cast("int")))
    )
    priced = p.withColumn("_amount", rule_amount(F.col("fixed"), F.col("factor"), F.col("basis"))).where("_amount > 0").withColumn("year", F.explode_outer(years)).where("year IS NOT NULL")
    day, born, year = F.col("first_day"), F.col("born"), F.col("year")
    age = (
        F.when(F.col("timing").isin("points", "age"), year - birth)
        .when(F.col("timing") == "maturity", F.coalesce(F.col("end_age"), end - birth))
        .otherwise(P.age_in_year(year, day, born))
    )
    return priced.select("policy_id", "rule_no", "year", age.cast("int").alias("age"), "liability", F.col("_amount").alias("amount"))


#: Phrases of conditions that name the years of a payment.
AFTER_YEARS, AFTER_AGE = r"生效满(\d+)年", r"(\d+)周岁后"
BEFORE_END, AT_END = "届满前|保障期满前", "保障期满|届满"


def condition_years(condition: Column, pension_age: Column) -> Column:
    """first and last year that a condition names; NULL if it names none."""
    text = F.trim(F.coalesce(condition, F.lit("")))
    years, age = F.regexp_extract(text, AFTER_YEARS, 1), F.regexp_extract(text, AFTER_AGE, 1)
    end, birth = F.col("end_year"), F.col("birth_year")
    pension = birth + F.when(pension_age > 0, pension_age).otherwise(PENSION_AGE) - 1
    first = F.when(years != "", F.col("effective_year") + years.try_cast("int")).when(age != "", birth + age.try_cast("int")).when(text.rlike(AT_END), end)
    last = (
        F.when(years != "", F.when(text.contains("养老年金开始前"), F.least(end - 1, pension)).otherwise(end - 1))
        .when(age != "", F.when(text.rlike(BEFORE_END), end - 1).otherwise(end))
        .when(text.rlike(AT_END), end)
    )
    last = F.when(text.contains("到养老年金开始前"), F.least(last, pension)).otherwise(last)
    return F.when((end > 0) & first.isNotNull(), F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))


def expand_indicators(rows: DataFrame) -> DataFrame:
    """Rows of indicators joined to their policies' context -> one row per year that the condition names.

    rows: policy_id, indicator_id, liability, condition, amount (as calculated), pension_age and the context columns.
    """
    years = P.let(condition_years(F.col("condition"), F.col("pension_age")), lambda s: F.when(s["first"] <= s["last"], F.sequence(s["first"], s["last"])))
    out = rows.where("amount > 0").withColumn("year", F.explode_outer(years)).where("year IS NOT NULL")
    age = P.age_in_year(F.col("year"), F.col("first_day"), F.col("born")).cast("int")
    return out.select("policy_id", "indicator_id", "year", age.alias("age"), "liability", "amount")


#: What a clause says of its amount.
PAID_CLAUSE, BASIC_CLAUSE = "实际交纳.*?保险费|已交保费|所交保费", "基本保险金额|基本保险金|基本保额"
LARGER_CLAUSE = "max|二者之[较最]大|三者之[最]"


def amount_facts(text: Column) -> dict[str, Column]:
    """What a clause says of its amount, apart from any policy."""
    percent = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    return {
        "_share": percent(r"(\d+)\s*%"), "_times": percent(r"基本保险金额[的]?\s*(\d+)\s*倍"), "_of_basic": percent(r"基本保险金额[的]?\s*(\d+)\s*%"),
        "_paid": text.rlike(PAID_CLAUSE), "_basic": text.rlike(BASIC_CLAUSE), "_larger": text.rlike(LARGER_CLAUSE),
    }


def clause_amount(facts: dict[str, Column], amount: Column, paid: Column) -> Column:
    """Amount of a benefit clause: a share of the premiums paid, a multiple or share of the basic amount, or the larger."""
    return (
        F.when(facts["_paid"], F.when(facts["_share"].isNotNull(), half_up(paid * facts["_share"] / 100, 0)).otherwise(paid))
        .when(facts["_times"].isNotNull(), amount * facts["_times"])
        .when(facts["_of_basic"].isNotNull(), half_up(amount * facts["_of_basic"] / 100, 0))
        .when(facts["_basic"], amount)
        .when(facts["_larger"], F.greatest(paid, amount))
        .otherwise(amount)
    )


#: Clauses on ages of education, by name, age and pattern.
EDUCATION = r"(?:十八|18)(?:[—\-至到－]+)(?:二十一|21)周岁.*?有效保险金额(?:[（(][^）)]*[）)])?(?:的)?(\d+(?:\.\d+)?)%"
NAMED_AGES = [("深造金", 22, "二十二"), ("立业金", 25, "二十五"), ("婚嫁金", 28, "二十八")]
NUMERALS = r"[一二三四五六七八九十百千万两\d]+"
#: Words of a benefit that is certain, and of one that is not.
CERTAIN = "生存|满期|期满|年金|养老金|教育金|祝寿|祝贺|关爱金|婚嫁|成家|返还"
UNCERTAIN = "医疗|医药|住院|门诊|治疗|费用|报销|补偿|赔付比例|免赔|理赔|疾病|意外|伤害|伤残|全残|津贴"


def clause_facts(name: Column, content: Column) -> dict[str, Column]:
    """What the texts of a clause say of its amount and years, apart from any policy."""
    text = F.coalesce(content, F.lit(""))
    tight = F.regexp_replace(text, r"\s+", "")
    told = lambda c, pattern, i=1: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    shares = [EDUCATION, *[rf"(?:{w}|{a})周岁.*?有效保险金额(?:[（(][^）)]*[）)])?(?:的)?(\d+(?:\.\d+)?)%" for _, a, w in NAMED_AGES]]
    first_share = r"首次给付.*?首次交纳的保险费的(\d+(?:\.\d+)?)%.*?以后每年.*?基本保险金额的(\d+(?:\.\d+)?)%"
    wait = told(text, r"生效满(五|十|[2-9]\d*|10)年.*?首个保单周年日")
    ages = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*周岁"), 1), lambda a: a.try_cast("int"))))
    on_day = told(text, rf"(?:于|生存至)\s*(?:年满)?\s*({NUMERALS})\s*周岁(?:保单)?生效对应日")
    at_last = told(text, rf"年满\s*({NUMERALS})\s*周岁的年生效对应日")
    certain = F.concat(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", ""), tight)
    return amount_facts(text) | {
        "_shares": F.array(*[told(tight, s).try_cast("double") for s in shares]),
        "_every": P.chinese_integer(F.regexp_extract(tight, rf"(?:合同)?生效之日起每满({NUMERALS})周年", 1)),
        "_yearly": tight.rlike("自本合同生效之日起.*?至本合同保险期间届满的年生效对应日前") & tight.contains("每年"),
        "_at_first": told(tight, first_share, 1).try_cast("double"), "_later": told(tight, first_share, 2).try_cast("double"),
        "_waits": wait.isNotNull(), "_waited": F.when(wait == "五", 5).when(wait == "十", 10).otherwise(wait.try_cast("int")),
        "_before_pension": text.rlike("养老年金开始领取日.*?(?:之前|不含)"), "_from_pension": text.rlike("开始领取日.*?(?:起|含).*?至.*?届满.*?前"),
        "_listed": text.rlike(r"\d+\s*周岁(?:[、，,]\s*\d+\s*周岁)+"), "_ages": ages,
        "_least": F.coalesce(F.regexp_extract(text, r"生效满(\d+)年.*?已经过", 1).try_cast("int"), F.lit(0)),
        "_point": F.coalesce(on_day, at_last).isNotNull() & ~text.rlike("至.*?(?:前|之前|不含)|起.*?至|开始领取日"),
        "_point_age": P.chinese_integer(F.coalesce(on_day, at_last)), "_at_last": at_last.isNotNull(),
        "_at_end": text.rlike("保险期间届满|保障期满|届满") & ~text.rlike("之前|不含|起"),
        "_unsure": certain.rlike(UNCERTAIN) & ~certain.rlike(CERTAIN),
    }


def expand_clauses(clauses: DataFrame) -> DataFrame:
    """Benefit clauses of policies -> yearly entries, by the first pattern that fits.

    clauses: policy_id, clause_no, name, content, pension_age and the context columns. Patterns in order: ages of
    education; every so many years; each year to the end; from so many years on; from the start of the pension; a list
    of ages; one age; the end of cover. Texts repeat over policies, so each one is read once.
    """
    facts = clause_facts(F.col("name"), F.col("content"))
    clauses = once_each(clauses, ["name", "content"], facts)
    f = {k: F.col(k) for k in facts}
    clauses = clauses.withColumn("_worth", clause_amount(f, F.col("amount"), F.col("total_premium")))
    name, worth = F.col("name"), F.col("_worth")
    begin, birth, end, base = (F.col(c) for c in ("effective_year", "birth_year", "end_year", "amount"))
    pension = F.coalesce("pension_age", F.lit(0))
    kind = "array<struct<year:int,age:int,amount:double,liability:string>>"
    none = F.array().cast(kind)
    inside = lambda x: (x["year"] >= begin) & (x["year"] <= end)

    def entry(year: Column, value: Column, age: Column | None = None, liability: Column = name) -> Column:
        return F.struct(year.cast("int").alias("year"), (F.lit(None) if age is None else age).cast("int").alias("age"), value.cast("double").alias("amount"), liability.alias("liability"))

    def yearly(first: Column, last: Column, step: Column | int = 1, value=None) -> Column:
        years = F.sequence(first.cast("int"), F.greatest(first, last).cast("int"), F.lit(step) if isinstance(step, int) else step.cast("int"))
        made = F.transform(years, lambda y: entry(y, worth if value is None else value(y)))
        return F.when(first <= last, made).otherwise(none)

    def percent_entry(i: int, ages: list[int], liability: str) -> Column:
        share = F.get(f["_shares"], F.lit(i))
        value = half_up(base * share / 100, 0)
        made = F.array(*[entry(birth + a, value, F.lit(a), F.lit(liability)) for a in ages])
        return F.when(share.isNotNull(), F.filter(made, inside)).otherwise(none)

    named = F.when(
        F.exists(f["_shares"], lambda s: s.isNotNull()),
        F.concat(percent_entry(0, [18, 19, 20, 21], "大学教育金"), *[percent_entry(1 + i, [a], liability) for i, (liability, a, _) in enumerate(NAMED_AGES)]),
    ).otherwise(none)
    from_start = lambda y: F.when(f["_at_first"].isNull(), worth).otherwise(half_up(F.when(y == begin, F.col("premium") * f["_at_first"]).otherwise(base * f["_later"]) / 100, 0))
    until = F.when(f["_before_pension"] & (pension > 0), birth + pension - 1).otherwise(end - 1)
    patterns = [
        (f["_every"] > 0, yearly(begin + f["_every"], end, f["_every"])),
        (f["_yearly"], yearly(begin, end - 1, 1, from_start)),
        (f["_waits"], yearly(begin + f["_waited"], until)),
        (f["_from_pension"], F.when(pension > 0, yearly(birth + pension, end - 1)).otherwise(none)),
        (f["_listed"], F.filter(F.transform(f["_ages"], lambda a: entry(birth + a, worth, a)), lambda x: x["year"] >= begin + f["_least"])),
        (f["_point"], F.filter(F.array(entry(F.when(f["_at_last"], end).otherwise(birth + f["_point_age"]), worth, f["_point_age"])), inside)),
        (f["_at_end"], F.when(end > 0, F.array(entry(end, worth))).otherwise(none)),
    ]
    fitting = reduce(lambda a, x: a.when(x[0], x[1]), patterns[1:], F.when(*patterns[0])).otherwise(none)
    clauses = clauses.withColumn("_named", named)
    chosen = F.when(f["_unsure"], none).when(F.size("_named") > 0, F.col("_named")).when(worth > 0, fitting).otherwise(none)
    rows = clauses.select("policy_id", "clause_no", "first_day", "born", F.inline_outer(chosen)).where("year IS NOT NULL")
    return rows.select("policy_id", "clause_no", "year", F.coalesce("age", P.age_in_year(F.col("year"), F.col("first_day"), F.col("born")).cast("int")).alias("age"), "liability", "amount")


#: Titles of the payment at the end of cover.
MATURITY = "^(?:满期生存保险金|满期保险金|满期金|满期返还|期满保险金|期满金)$"
SOURCE_SCORES = {"indicator_source_text": 20, "responsibility": 10}


def merge_entries(entries: DataFrame) -> DataFrame:
    """One entry per policy, year, product and benefit: the one that tells most.

    entries: policy_id, seq, year, product, liability, amount, basis (what it is worked out from), source, indicator_id.
    Entries of one title merge first; then those at the end of cover that have the same basis, but come from different
    sources and not from two indicators. A tie goes to the earlier one.
    """
    title = F.regexp_replace(F.coalesce("liability", F.lit("")), r"\s+", "")
    score = F.lit(0)
    for source, worth in SOURCE_SCORES.items():
        score = F.when(F.col("source") == source, worth).otherwise(score)
    scored = entries.withColumns({"_title": title, "_score": score + F.length(title)})
    by_title = best_per_key(scored, ["policy_id", "year", "product", "_title"], [F.desc("_score"), F.col("seq")])
    basis = F.when(F.col("basis").rlike("实际交纳|已交保费|所交保费"), "paid").when(F.col("basis").rlike("基本保额|基本保险金额|基本保险金"), "basic")
    same = F.when(F.col("_title").rlike(MATURITY), basis)
    keyed = by_title.withColumn("_same", same)
    # the first entry of a kind takes in those of other sources
    w = Window.partitionBy("policy_id", "year", "product", "_same").orderBy("seq")
    lead = F.first(F.struct("seq", "source", F.coalesce("indicator_id", F.lit("")).alias("id"))).over(w)
    mine = F.coalesce("indicator_id", F.lit(""))
    joins = (lead["seq"] != F.col("seq")) & (lead["source"] != F.col("source")) & ((lead["id"] == "") | (mine == "") | (lead["id"] == mine))
    grouped = keyed.withColumn("_group", F.when(F.col("_same").isNotNull() & joins, lead["seq"]).otherwise(F.col("seq")))
    best = best_per_key(grouped, ["policy_id", "year", "product", "_group"], [F.desc("_score"), F.col("seq")])
    return best.drop("_title", "_score", "_same", "_group")


def by_tier(template: DataFrame, text: DataFrame, indicator: DataFrame, has_template: DataFrame) -> DataFrame:
    """Entries of templates where a policy has one; else those of texts and indicators, merged. All have merge_entries' columns."""
    rest = text.unionByName(indicator).join(has_template.select("policy_id"), "policy_id", "left_anti")
    return template.unionByName(merge_entries(rest))


def scenarios(rows: DataFrame) -> DataFrame:
    """policy_id, scenario, amount of the indicators that are no cashflow and can be worked out.

    rows: indicators joined to their policies: coverage_type, liability, unit, basis, formula, value, amount, premium,
    payment, and meta, what P.with_calculation gives. Amounts that the rules leave open follow the larger of both where the
    formula says max, else a multiple of the premiums paid, else the basic amount by its factor.
    """
    rows = once_each(rows, ["payment"], {"_years": P.payment_years(F.col("payment"))})
    meta = F.col("meta")
    paid = F.col("premium") * F.greatest(F.col("_years"), F.lit(1.0))
    ruled = P.calculated_amount(meta, F.col("amount"), F.col("premium"), F.col("_years"))
    words = F.regexp_replace(F.concat_ws(" ", "formula", "basis", "liability", "coverage_type"), r"\s+", "")
    share = F.regexp_extract("formula", r"(\d+)%", 1)
    value, unit = F.coalesce(F.col("value"), F.lit(0.0)), F.coalesce("unit", F.lit(""))
    open_ = (
        F.when(F.lower("formula").contains("max"), F.greatest(half_up(paid * F.coalesce(share.try_cast("double"), F.lit(100.0)) / 100, 0), F.col("amount")))
        .when(words.rlike("实际交纳|已交保费|所交保费"), F.when((value != 0) & F.concat_ws(" ", unit, "formula").rlike("倍|×"), half_up(paid * value, 0)).otherwise(paid))
        .when((value != 0) & words.rlike("基本保额|基本保险金额|基本保险金") & unit.contains("倍"), F.col("amount") * value)
        .when((value != 0) & words.rlike("基本保额|基本保险金额|基本保险金") & unit.contains("%"), half_up(F.col("amount") * value / 100, 0))
        .otherwise(F.col("amount"))
    )
    unsure = meta["calculation"].isin("cash_value", "account_value", "schedule_or_policy_table", "medical_formula", "daily_allowance", "not_calculable")
    ratio_only = unit.contains("%") & ~words.rlike("基本保额|基本保险金额|基本保险金") & words.rlike("赔付比例|给付比例|报销比例|实际医疗费用|医疗费用|特定医疗费用|条款载明比例")
    kept = rows.where(~F.coalesce("coverage_type", F.lit("")).isin("现金流", "规则参数") & ~unsure & ~ratio_only)
    scenario = F.coalesce(F.nullif("liability", F.lit("")), F.nullif("coverage_type", F.lit("")), F.lit("保障责任"))
    return kept.select("policy_id", scenario.alias("scenario"), F.coalesce(ruled, open_).alias("amount"))
