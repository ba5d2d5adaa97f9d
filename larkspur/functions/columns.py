"""Column builders: each takes and returns Column expressions, so plans stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """NULL for null, empty and all-blank text; else the trimmed text."""
    return F.nullif(F.trim(c), F.lit(""))


def or_default(c: Column, default) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def compact(c: Column) -> Column:
    """Lower-cased text without white space, for comparison."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def half_up(c: Column, digits: int = 2) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits on doubles."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number(c: Column) -> Column:
    """A finite double from text with separators, currency signs and units; else NULL."""
    got = F.regexp_replace(c, r"[,\s$€¥]", "").try_cast("double")
    return F.when(F.isnan(got) | (F.abs(got) == float("inf")), None).otherwise(got)


# --- similarity -----------------------------------------------------------------------------------


def ngrams(c: Column, n: int) -> Column:
    """Distinct runs of n characters; the whole text if it is shorter (and not empty)."""
    size = F.length(c)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def set_cosine(a: Column, b: Column) -> Column:
    product = F.size(a) * F.size(b)
    return F.when(product == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(product.cast("double")))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common prefix over the length of the longer text."""
    shortest, longest = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.when(shortest == 0, F.lit(0.0)).otherwise(F.size(same) / longest)


def composite_similarity(a: Column, b: Column) -> Column:
    """Containment counts at least 0.88 when the lengths are near; else the better of a weighted mean and the prefix."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    contained = F.contains(a, b) | F.contains(b, a)
    mean = 0.45 * edit_similarity(a, b) + 0.35 * set_cosine(ngrams(a, 2), ngrams(b, 2)) + 0.2 * set_cosine(ngrams(a, 3), ngrams(b, 3))
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(contained & (ratio >= 0.75), F.greatest(F.lit(0.88), ratio))
        .when(contained, ratio * 0.9)
        .otherwise(F.greatest(mean, 0.95 * prefix_ratio(a, b)))
    )


# --- dates ----------------------------------------------------------------------------------------


def add_years(d: Column, years: Column) -> Column:
    """The same day some years on; 29 February becomes the 28th where needed."""
    return F.add_months(d, (years * 12).cast("int"))


def age_at(birth: Column, day: Column) -> Column:
    """Whole years lived on a day; NULL before birth."""
    passed = (F.month(day) * 100 + F.dayofmonth(day)) >= (F.month(birth) * 100 + F.dayofmonth(birth))
    age = F.year(day) - F.year(birth) - F.when(passed, 0).otherwise(1)
    return F.when(age >= 0, age)


# --- text -----------------------------------------------------------------------------------------


def first_label(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule (pattern, label) whose pattern occurs."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(default))


def topics(c: Column, rules: list[tuple[str, str | None, str]]) -> Column:
    """Labels of all rules (pattern, pattern that excludes, label) that fit a text, in their order, each once."""
    fits = lambda p, out: c.rlike(p) & (~c.rlike(out) if out else F.lit(True))
    return F.array_distinct(F.array_compact(F.array(*[F.when(fits(p, out), F.lit(label)) for p, out, label in rules])))


def all_labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all rules whose pattern occurs, in order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), label) for p, label in rules]))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace {{name}} by its value; unknown names stay."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Han characters, plus words and numbers of other scripts."""
    # the blank after a token is taken with it, so that the next one mostly begins where the search goes on
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?:[A-Za-z]++|[\x{3400}-\x{9fff}]|[0-9]++(?:\.[0-9]++)?+) ?+"))


def html_text(c: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, common entities decoded, white space folded."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: What is taken out of texts, in this order, and what stands for it.
PRIVATE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b[0-9]{17}[0-9Xx]\b", "[ID]"),
    (r"\b[0-9]{16,19}\b", "[CARD]"),
    (r"\b1[3-9][0-9]{9}\b", "[MOBILE]"),
    (r"\b0[0-9]{2,3}-[0-9]{7,8}\b", "[PHONE]"),
    (r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b", "[PHONE]"),
]


def redact(c: Column) -> Column:
    out = c
    for pattern, mark in PRIVATE:
        out = F.regexp_replace(out, pattern, mark)
    return out


#: Direct identifiers of people, in this order, and what stands for each.
DIRECT = [
    (r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d(?:[-\s]?\d){8}(?!\d)", "[手机号已脱敏]"),
    (r"(?<!\d)\d{3,4}[-\s]\d{7,8}(?!\d)", "[固定电话已脱敏]"),
    (r"(?<!\d)\d{17}[0-9Xx](?!\d)", "[身份证号已脱敏]"),
    (r"(?<!\d)(?:\d[ -]?){15,18}\d(?!\d)", "[银行卡号已脱敏]"),
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[邮箱已脱敏]"),
    (r"(?i)((?:保单号|合同号|保险合同号)\s*[：:]?\s*)[A-Z0-9_-]{6,40}", "$1[已脱敏]"),
    (r"(?i)((?:微信号|微信|WeChat)\s*[：:]\s*)[A-Z][-_A-Z0-9]{5,19}", "$1[已脱敏]"),
]
#: Labels of addresses, and the part of one that may stay.
ADDRESS = r"((?:家庭地址|居住地址|联系地址|住址|(?<!详细)地址)\s*[：:]?\s*)"
REGION, HIDDEN = r"([^\n，,。；;]{2,32}?(?:区|县|旗))", "[详细地址已脱敏]"


def redact_direct(c: Column, names: list[Column] = (), addresses: list[Column] = ()) -> Column:
    """A text without names, addresses beyond their region, numbers, mail, policy numbers and chat names."""
    out = c
    for name in names:
        out = F.when(F.trim(name) != "", F.replace(out, name, F.lit("[客户姓名已脱敏]"))).otherwise(out)
    for address in addresses:
        region = F.regexp_extract(address, f"^{REGION}[^区县旗]", 1)
        out = F.when(F.trim(address) != "", F.replace(out, address, F.concat(region, F.lit(HIDDEN)))).otherwise(out)
    for pattern, mark in DIRECT:
        out = F.regexp_replace(out, pattern, mark)
    out = F.regexp_replace(out, ADDRESS + REGION + r"[^\n，,。；;区县旗\[][^\n，,。；;]*", f"$1$2{HIDDEN}")
    return F.regexp_replace(out, ADDRESS + r"(?![^\n，,。；;]*(?:区|县|旗))[^\n，,。；;\[]{3,100}", f"$1{HIDDEN}")


def strict_json(c: Column, most: int) -> Column:
    """A JSON text in one canonical form; NULL if it does not parse or has more than `most` bytes."""
    return F.when(F.octet_length(c) <= most, F.to_json(F.try_parse_json(c)))


def content_key(*parts: Column, digits: int = 24) -> Column:
    """Stable key of some values: a shortened SHA-256 over their texts, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits)


# --- nested values --------------------------------------------------------------------------------


def nested_sum(entries: Column, field: str) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda a, e: a + F.coalesce(e[field], F.lit(0.0)))


def nested_max(entries: Column, field: str) -> Column:
    """The greatest value of a field, 0 at least."""
    return F.aggregate(entries, F.lit(0.0), lambda a, e: F.greatest(a, F.coalesce(e[field], F.lit(0.0))))


def unique_parts(*texts: Column) -> Column:
    """Distinct parts of some texts, split at list marks, in the order in which they come."""
    parts = F.flatten(F.array(*[F.transform(F.split(F.coalesce(t, F.lit("")), "[、，,;；/／]+"), lambda x: F.trim(x)) for t in texts]))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def json_merge(payload: Column, fields: dict[str, Column]) -> Column:
    """A flat JSON object with some fields set; the given ones win. What is no object counts as empty."""
    old = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(*fields))
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_concat(kept, new))


def backfilled(items: Column, field: str, value) -> Column:
    """An array of structs whose blank field is filled by value(item)."""
    return F.transform(items, lambda x: x.withField(field, F.coalesce(blank_to_null(x[field]), value(x))))


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def without_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without heavy columns; names that are not there do not matter."""
    return df.drop(*names)


def given_equal(values: dict) -> Column:
    """Equality on each column whose value is given (neither null nor blank)."""
    return all_of([F.col(c) == v for c, v in values.items() if v is not None and str(v).strip()])


def in_given(column: str, values: list) -> Column:
    """Whether a column is one of the given values; no value given means no restriction."""
    kept = list(dict.fromkeys(v for v in values if v is not None and str(v).strip()))
    return F.col(column).isin(kept) if kept else F.lit(True)


# --- evidence -------------------------------------------------------------------------------------

#: Kinds of sources by the authority that they have, and what counts as formal.
EXTERNAL = ["legacy_external_reference", "open_web_reference"]
FORMAL_EVIDENCE = ["insurer_official", "regulatory", "customer"]


def evidence_authority(kind: Column, level: Column, material: Column) -> Column:
    """external, customer, regulatory, insurer_official or other, by a source's kind and level."""
    k, v = F.trim(F.coalesce(kind, F.lit(""))), F.trim(F.coalesce(level, F.lit("")))
    return (
        F.when(k.isin(EXTERNAL) | (v == "external_legacy_reference") | (F.trim(material) == "external_reference"), "external")
        .when((k == "customer_policy_terms") | (v == "customer_policy_terms") | ((k == "customer_policy_photo") & (v == "customer_policy_photo_reviewed")), "customer")
        .when((k == "jrcpcx") | (v == "regulatory_industry_terms"), "regulatory")
        .when((k == "insurer_official") | (v == "insurer_official"), "insurer_official")
        .otherwise("other")
    )


def verification_status(authority: Column, given: Column) -> Column:
    """The given status, else pending for external and verified for formal evidence."""
    return F.coalesce(blank_to_null(given), F.when(authority == "external", "pending_review").when(authority.isin(FORMAL_EVIDENCE), "verified"), F.lit(""))


#: Markers of an uncertain reading.
UNCERTAIN_MARKS = ["review", "low", "uncertain", "unknown", "needs-review", "need-review", "不确定", "未知", "需确认", "待确认"]


def rate(value: float, default: float = 0.6) -> float:
    """A threshold between 0 and 1; numbers above 1 are percentages."""
    return default if not value > 0 else min(value / 100, 1.0) if value > 1 else value


def is_certain(confidence: Column, least: float) -> Column:
    """Whether a reading is certain: blank, no marker of doubt, and no number below the threshold."""
    mark = F.lower(F.trim(F.coalesce(confidence, F.lit(""))))
    return (mark == "") | (~mark.isin(UNCERTAIN_MARKS) & F.coalesce(mark.try_cast("double") >= least, F.lit(True)))


#: Words that route a product to its category, in this order: first by name, then by text.
NAME_CATEGORIES = [("医疗", "medical"), ("重大疾病|重疾|防癌", "critical_illness"), ("年金|养老", "annuity"), ("两全", "endowment"), ("护理", "long_term_care"), ("意外", "accident")]
TEXT_CATEGORIES = [
    ("医疗保险金|住院|门诊|免赔额|报销|医疗费用|医保目录|药品医疗保障", "medical"),
    ("重大疾病|重疾|轻度疾病|中度疾病|重度疾病|特定疾病", "critical_illness"),
    ("投资连结|投连险|投资账户|单位价格|买入价|卖出价", "investment_linked"),
    ("万能保险|万能型|个人账户价值|保单账户价值|结算利率|最低保证利率", "universal_life"),
    ("长期护理|护理保险金|护理状态|失能护理|长期照护", "long_term_care"),
    ("年金|养老金|养老年金|生存保险金|祝寿金|教育金", "annuity"),
    ("两全|满期保险金|满期生存保险金", "endowment"),
    ("增额终身寿|增额寿|保额递增", "incremental_whole_life"),
    ("定期寿险|定期人寿", "term_life"),
    ("意外伤害保险|意外身故|意外伤残|意外医疗|交通意外", "accident"),
    ("终身寿险|人寿保险", "ordinary_whole_life"),
    ("医疗保险|医疗险", "medical"),
]
#: Words that give a product a tag, and what asks for the larger model.
FEATURES = [
    ("traffic_accident_extra", "交通工具意外|交通意外|公共交通|航空意外|驾乘意外|自驾车意外"),
    ("participating", "分红型|分红保险|红利|累积红利保险金额|保单红利|红利分配"),
    ("disease_grouping", r"疾病分组|分组给付|分为\d+组|单组给付限额|同组疾病"),
    ("children", "少儿|儿童|未成年|前10年关爱|前十年关爱"),
    ("multi_pay", "多次给付|多倍给付|第二次|第三次|再次给付|累计给付限额"),
    ("optional_responsibility", "可选责任|选择责任|附加责任|可附加"),
    ("account_value", "账户价值|结算利率|最低保证利率|保单账户|个人账户"),
    ("investment_risk", "投资风险|投资账户|投资连结|账户单位|单位价格|不保证收益"),
]
LARGE_CATEGORIES = "critical_illness annuity endowment long_term_care universal_life investment_linked participating_life".split()
LARGE_TEXT = "可选责任|以下二者|以下三者|较大者|账户价值|累计给付限额|疾病分组"


def route_category(name: Column, text: Column) -> Column:
    """category, tags and tier (pro, flash) of a product from its name and text."""
    whole = F.concat_ws("\n", name, text)
    category = F.coalesce(first_label(name, NAME_CATEGORIES), first_label(whole, TEXT_CATEGORIES), F.lit("other"))
    tags = all_labels(whole, [(p, tag) for tag, p in FEATURES])
    large = category.isin(LARGE_CATEGORIES) | F.array_contains(tags, "participating") | whole.rlike(LARGE_TEXT) | (F.length(whole) > 5000)
    return F.struct(category.alias("category"), tags.alias("tags"), F.when(large, "pro").otherwise("flash").alias("tier"))
