"""Column builders for names of companies, products, people and relations: folding, aliases and scores."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.functions.columns import composite_similarity, jaccard, ngrams

# --- folding --------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility form of a text. Spark has none of its own, so this is an Arrow function over whole batches."""
    return _nfkc(c)


#: The printable ASCII characters in full width, in order, and the ideographic space.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def narrow(c: Column) -> Column:
    """Full-width ASCII in its usual width: what most texts need of NFKC, without leaving the JVM."""
    return F.translate(c, WIDE, NARROW)


#: Characters that the compatibility form writes as one other character, and those that it writes as several.
_FORMS = {chr(i): unicodedata.normalize("NFKC", chr(i)) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000}
SINGLE = {c: f for c, f in _FORMS.items() if f != c and len(f) == 1}
SEVERAL = {c: f for c, f in _FORMS.items() if len(f) > 1}


def compatible(c: Column) -> Column:
    """Compatibility form of a text, character by character, within the JVM; a letter with a combining mark counts as one that is neither."""
    one = F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))
    # plain literals, so that neither the list of forms nor a large class of characters is gone through for every row
    several, forms = "".join(SEVERAL), F.split(F.lit("\x00".join(SEVERAL.values())), "\x00")
    place = lambda x: F.instr(F.lit(several), F.nullif(x, F.lit("")))
    spelled = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.get(forms, place(x) - 1), x)), "")
    return F.regexp_replace(F.when(F.translate(one, several, "") != one, spelled).otherwise(one), r"[A-Za-z]\p{M}+", " ")


def canonical(c: Column) -> Column:
    """Comparable text: compatibility form, no white space, lower case."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"\s+", ""))


#: Characters that scans mix up, and what stands for each.
VARIANTS, PLAIN = "險険費繳額稱證號單劃畫臺週責終產産護紅類間问閒缴￥¥", "险险费缴额称证号单划画台周责终产产护红类间间间交元元"
#: Punctuation that counts as a space.
MARKS = r"[|｜/／\\()\[\]{}（）【】,，.。;；、\-_=+~`'\"“”‘’<>《》!?！？]"


def scan_text(c: Column, tight: bool = True) -> Column:
    """Text of a scan for comparison: variants folded, only Han, letters a to z and digits left (and colons, unless tight)."""
    low = F.regexp_replace(F.lower(compatible(F.coalesce(c, F.lit("")))), "[：﹕]", ":")
    folded = F.translate(F.regexp_replace(low, MARKS, " "), VARIANTS, PLAIN)
    kept = F.regexp_replace(folded, r"[^\p{IsHan}a-z0-9:\s]", " ")
    return F.replace(F.regexp_replace(kept, r"\s+", ""), F.lit(":"), F.lit("")) if tight else F.trim(F.regexp_replace(kept, r"\s+", " "))


#: Legal forms and document titles that are no part of a name.
COMPANY_FORMS = [r"(?:人寿|财产|养老|健康)?保险股份有限公司", r"(?:人寿|财产|养老|健康)?保险有限责任公司", r"(?:人寿|财产|养老|健康)?保险有限公司", "股份有限公司|有限责任公司|有限公司"]
LEADING_COMPANY = r"^[\p{IsHan}]{2,14}(?:人寿|财产|养老|健康)?保险(?:股份有限公司|有限责任公司)"
TITLES = "保险股份有限公司|保险有限责任公司|股份有限公司|有限责任公司|产品说明书|产品说明|保险条款|利益条款|条款"
NAME_MARKS = r"[《》<>「」『』【】\[\]（）().,，。；;：:、·-]"


def company_core(c: Column) -> Column:
    """A company's name without its legal form."""
    text = F.lower(F.regexp_replace(F.regexp_replace(narrow(F.coalesce(c, F.lit(""))), r"\s+", ""), NAME_MARKS, ""))
    return reduce(lambda a, p: F.regexp_replace(a, p, ""), COMPANY_FORMS, text)


def product_core(c: Column, company: Column, strict: bool = False) -> Column:
    """A product's name without its company and document titles; strict keeps 保险 inside it."""
    fold = lambda x: F.regexp_replace(F.regexp_replace(narrow(F.coalesce(x, F.lit(""))), r"\s+", ""), NAME_MARKS, "")
    owner = fold(company)
    text = F.when(owner != "", F.replace(fold(c), owner, F.lit(""))).otherwise(fold(c))
    text = F.regexp_replace(F.regexp_replace(text, LEADING_COMPANY, ""), TITLES, "")
    return F.regexp_replace(text, "保险$" if strict else "保险", "")


#: Words for relations, and for kinds of products, that mean the same.
RELATIONS = {"丈夫": "配偶", "妻子": "配偶", "先生": "配偶", "太太": "配偶", "夫妻": "配偶", "爸爸": "父亲", "妈妈": "母亲", "孩子": "子女", "小孩": "子女"}
KNOWN_RELATIONS = "本人 配偶 儿子 女儿 子女 儿媳 女婿 孙子 孙女 外孙 外孙女 父亲 母亲 父母 外公 外婆 爷爷 奶奶 其他 待确认".split()
PRODUCT_KINDS = {"意外保险": "意外险", "意外伤害保险": "意外险", "医疗保险": "医疗险", "护理保险": "护理险", "年金保险": "年金险", "年金": "年金险", "两全及生存": "两全保险", "人寿险": "寿险", "人寿保险": "寿险", "重大疾病": "重疾险"}
#: Words in a name or text that tell the kind, in this order.
KIND_WORDS = [("重大疾病|重疾", "重疾险"), ("医疗", "医疗险"), ("护理", "护理险"), ("年金", "年金险"), ("两全", "两全保险"), ("终身寿险|定期寿险|寿险", "寿险"), ("意外", "意外险"), ("恶性肿瘤|防癌|特定疾病|疾病保险", "疾病保险")]
NO_KIND = r"^(?:-|全部|产品分类：|P[123])$"
BROAD_KINDS = r"^(?:健康(?:险|保险)?|寿险|年金险|两全保险|医疗险|护理险|意外险|疾病保险)$"


def alias(c: Column, names: dict[str, str]) -> Column:
    """The name that stands for a text, or the text itself."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.trim(c)), F.trim(c))


def relation(c: Column) -> Column:
    """A relation under its one name; blank if it is none of the known ones."""
    name = alias(F.coalesce(c, F.lit("")), RELATIONS)
    return F.when(name.isin(KNOWN_RELATIONS), name).otherwise("")


def product_kind(kind: Column, *texts: Column) -> Column:
    """A kind under its one name; broad or missing kinds give way to what the texts say."""
    raw, text = F.trim(F.coalesce(kind, F.lit(""))), F.concat_ws(" ", *texts)
    named = F.when(raw.rlike(NO_KIND), "").otherwise(alias(raw, PRODUCT_KINDS))
    told = reduce(lambda a, x: a.when(text.rlike(x[0]), x[1]), KIND_WORDS[1:], F.when(text.rlike(KIND_WORDS[0][0]), KIND_WORDS[0][1])).otherwise("")
    return F.when(named == "", told).when(named.rlike(BROAD_KINDS), F.coalesce(F.nullif(told, F.lit("")), named)).otherwise(named)


def excerpt(c: Column, place: Column, length: int = 280, before: int = 40) -> Column:
    """So many characters from a little before a place (from 0), white space folded."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.trim(F.substring(text, F.greatest(place - before, F.lit(0)) + 1, F.lit(length)))


# --- scores ---------------------------------------------------------------------------------------


def chars(c: Column) -> Column:
    """Distinct characters of a text."""
    return ngrams(c, 1)


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest text that both hold: the longest run of the first that occurs in the second.

    A fold over the starts in the shorter text: each start only tries runs longer than the best so far, so one pass
    over its characters is enough.
    """
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ends = F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1)))
    # the best run that ends at a place is at most one longer than the best one before it
    longer = lambda best, end: F.when((end > best) & F.contains(long, F.substring(short, (end - best).cast("int"), (best + 1).cast("int"))), best + 1).otherwise(best)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.aggregate(ends, F.lit(0), longer))


#: Words that tell kinds of products apart, and the weights of the name score.
KIND_TERMS = "两全 年金 终身寿 重大疾病 医疗 护理 意外 万能 投连 投资连结 增额 分红 养老 寿险".split()


def name_score(a: Column, b: Column, kinds_a: Column, kinds_b: Column) -> Column:
    """Likeness of two product cores, from 0 to 1; kinds_a and kinds_b are the full names, whose kinds help or hurt."""
    shorter = F.least(F.length(a), F.length(b))
    run = common_substring(a, b) / shorter
    mean = 0.35 * jaccard(ngrams(a, 3), ngrams(b, 3)) + 0.25 * jaccard(ngrams(a, 2), ngrams(b, 2)) + 0.2 * jaccard(chars(a), chars(b)) + 0.2 * run
    base = F.greatest(F.when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(0.0), mean)
    of = lambda c: F.array_compact(F.array(*[F.when(c.contains(t), t) for t in KIND_TERMS]))
    shared = F.arrays_overlap(of(kinds_a), of(kinds_b))
    clash = (F.size(of(kinds_a)) > 0) & (F.size(of(kinds_b)) > 0) & ~shared & (run < 0.75)
    score = base + F.when(shared, 0.08).when(clash, -0.06).otherwise(0.0)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def company_score(query: Column, candidate: Column, same_alias: Column) -> Column:
    """Tiers of a company suggestion: alias 400, equal 320, beginning 240, inside 180 less the place, then by cores."""
    tight = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    q, c, qc, cc = tight(query), tight(candidate), company_core(query), company_core(candidate)
    at, core_at = F.instr(c, q) - 1, F.instr(cc, qc) - 1
    ranked = (
        F.when(same_alias, 400)
        .when(c == q, 320)
        .when(at == 0, 240)
        .when(at > 0, 180 - F.least(at, F.lit(40)))
        .when((qc == "") | (cc == ""), 0)
        .when(cc == qc, 160)
        .when(core_at == 0, 140)
        .when(core_at > 0, 120 - F.least(core_at, F.lit(40)))
    )
    return F.when((q == "") | (c == ""), 0).otherwise(F.coalesce(ranked, F.lit(0)))


#: Punctuation that the list search takes for spaces.
LIST_MARKS = r"[，。、“”‘’（）()【】\[\]{}:：;；,./\\|_·-]+"


def list_score(query: str, *fields: Column) -> Column:
    """Score of a row for a search text: whole text inside 120, letters in order 75, else terms and letters, 45 at least; 0 if less."""
    import re

    fold = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), LIST_MARKS, " "), r"\s+", " "))
    asked = re.sub(r"\s+", " ", re.sub(LIST_MARKS, " ", query.lower())).strip()
    if not asked:
        return F.lit(1.0)
    merged = F.concat_ws(" ", *[F.nullif(fold(f), F.lit("")) for f in fields])
    tight, q = F.replace(merged, F.lit(" "), F.lit("")), asked.replace(" ", "")
    at = F.instr(tight, F.lit(q))
    ordered = tight.rlike(".*?".join(re.escape(c) for c in q))
    terms, letters = asked.split(" "), list(dict.fromkeys(q))
    hits = lambda c, words: reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("double") for w in words])
    term_hits = reduce(lambda a, b: a + b, [(F.contains(merged, F.lit(w)) | F.contains(tight, F.lit(w))).cast("double") for w in terms])
    mixed = term_hits / len(terms) * 70 + hits(tight, letters) / len(letters) * 30
    return F.when(merged == "", 0.0).when(at > 0, 120 - (at - 1) / 10000).when(ordered, 75.0).when(mixed >= 45, mixed).otherwise(0.0)


#: Characters that occur in all labels and so tell nothing.
COMMON_CHARS = "保险合同名称公司金额期间方式交费缴费基本首期"


def salient_overlap(a: Column, b: Column) -> Column:
    """Whether two texts share a character that tells something, or one has none."""
    of = lambda c: F.array_except(chars(scan_text(c)), F.array(*[F.lit(x) for x in dict.fromkeys(COMMON_CHARS)]))
    return (F.size(of(a)) == 0) | (F.size(of(b)) == 0) | F.arrays_overlap(of(a), of(b))


def windows(c: Column, size: Column) -> Column:
    """A text and its runs of one character less to two more than `size`."""
    n = F.length(c)
    of = lambda k: F.when(k <= n, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(c, i.cast("int"), k.cast("int")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), *[of(F.greatest(size + d, F.lit(1))) for d in (-1, 0, 1, 2)]))


def strip_label(c: Column, labels: list[str], least: float = 0.7) -> Column:
    """A text without the label before its colon, where that is like one of the labels."""
    text = F.trim(F.coalesce(c, F.lit("")))
    head, rest = F.regexp_extract(text, "^([^:：]*)[:：]", 1), F.trim(F.regexp_replace(text, "^[^:：]*[:：]", ""))
    like = reduce(lambda a, b: a | b, [composite_similarity(scan_text(head), scan_text(F.lit(x))) >= least for x in labels])
    return F.when(text.rlike("[:：]") & like, rest).otherwise(text)


#: Words for the same severity.
SEVERITIES = [("轻症(?:疾病)?", "轻度疾病"), ("中症(?:疾病)?", "中度疾病"), ("重大疾病", "重度疾病"), ("重疾", "重度疾病")]
NUMBERED = r"第[一二三四五六七八九十\d]+次|第[一二三四五六七八九十\d]+至第?[一二三四五六七八九十\d]+次"


def title_core(c: Column) -> Column:
    """A responsibility's title without its scope and with one word for each severity."""
    text = F.regexp_replace(F.regexp_replace(narrow(F.coalesce(c, F.lit(""))), r"\s+", ""), r"\((?:可选责任|基本责任)[^)]*\)$", "")
    return reduce(lambda a, x: F.regexp_replace(a, x[0], x[1]), SEVERITIES, text)


def titles_match(a: Column, b: Column) -> Column:
    """Whether two titles mean one responsibility: equal, or the second ends with the first, unless that is numbered."""
    x, y = title_core(a), title_core(b)
    return (x != "") & (y != "") & ((x == y) | (~x.rlike(NUMBERED) & F.endswith(y, x)))


# --- people ---------------------------------------------------------------------------------------


def id_number(c: Column) -> Column:
    """18 or 15 characters of an identity number; blank without one."""
    kept = F.upper(F.regexp_replace(narrow(F.coalesce(c, F.lit(""))), r"[^\dXx]", ""))
    long = F.regexp_extract(kept, r"\d{17}[\dX]", 0)
    return F.when(long != "", long).otherwise(F.regexp_extract(kept, r"\d{15}", 0))


def id_birthday(c: Column) -> Column:
    """Birthday that an identity number holds; NULL if there is none."""
    n = id_number(c)
    short_year = F.substring(n, 7, 2)
    text = F.when(F.length(n) == 18, F.concat_ws("-", F.substring(n, 7, 4), F.substring(n, 11, 2), F.substring(n, 13, 2))).when(
        F.length(n) == 15, F.concat_ws("-", F.concat(F.when(short_year.try_cast("int") >= 30, "19").otherwise("20"), short_year), F.substring(n, 9, 2), F.substring(n, 11, 2))
    )
    return text.try_cast("date")


def is_mobile(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"^1[3-9]\d{9}$")


#: Labels and numbers that make a line private, and words of product lines.
PRIVATE_LINE = r"\d{17}[\dXx]|\d{15}|1[3-9]\d{9}|(?:投保人|要保人|被保(?:险)?人|受益人|证件号码|证件号|身份证|保单号|合同号|客户号|手机号|联系电话|出生日期|生日|家庭住址|联系地址|地址)[:：]|(?:保单载明|本保单|您已选择|已选择|已投保|本次投保|保险单载明|投保的保险责任).*(?:可选责任|附加责任)"


def public_lines(c: Column, *values: Column) -> Column:
    """A text without blank and private lines, and without those that hold one of the values."""
    secrets = F.array_compact(F.array(*[F.nullif(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", ""), F.lit("")) for v in values])) if values else F.array().cast("array<string>")
    tight = lambda line: F.regexp_replace(line, r"\s+", "")
    keep = lambda line: (tight(line) != "") & ~line.rlike(PRIVATE_LINE) & ~F.exists(secrets, lambda v: F.contains(tight(line), v))
    return F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), keep), "\n")
