"""Carrier queries on names: folding, aliases, scores, and joins by likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.functions import names as N
from larkspur.operators import matching, relations
from larkspur.plans.carriers import query
from larkspur.plans.policies import pick, sql_pick

FORMS = ["{}人寿保险股份有限公司", "{} 财产保险有限责任公司", "《{}》保险有限公司", "{}有限公司", "{}"]
CITIES = ["新安", "北方", "东海", "南山", "西域"]
SUFFIXES = ["终身寿险", "重大疾病保险条款", "年金保险（分红型）", "医疗保险产品说明书", "两全保险"]


def wide(c):
    return F.translate(c, N.NARROW, N.WIDE)


@query("""
SELECT p_partkey, lower(replace(p_name, ' ', '')) || 'ⅱ' AS name, replace(p_name, ' ', '') || 'x' AS kept FROM part""".replace("|| 'ⅱ'", "|| 'ii'"))
def canonical_names(t):
    return t.part.select("p_partkey", N.canonical(F.concat(wide(F.upper("p_name")), F.lit("　Ⅱ"))).alias("name"), F.replace(N.narrow(F.concat(wide(F.col("p_name")), F.lit("ｘ"))), F.lit(" "), F.lit("")).alias("kept"))


@query("""
SELECT p_partkey, '险种' || lower(replace(p_name, ' ', '')) || '费额' || p_size || '元' AS folded FROM part""")
def scan_folding(t):
    text = F.concat(F.lit("險種（".replace("種", "种")), F.upper("p_name"), F.lit("）：費　額|"), wide(F.col("p_size").cast("string")), F.lit("￥"))
    return t.part.select("p_partkey", N.scan_text(text).alias("folded"))


@query(f"""
SELECT s_suppkey, {sql_pick(CITIES, "s_suppkey // 5")} AS company, {sql_pick(["终身寿", "重大疾病", "年金分红型", "医疗", "两全"], "s_nationkey")} AS product,
  {sql_pick(["终身寿险", "重大疾病保险", "年金保险分红型", "医疗保险", "两全保险"], "s_nationkey")} AS strict_long FROM supplier""".replace("AS product,", "|| CASE s_nationkey % 5 WHEN 0 THEN '险' ELSE '' END AS product,"))
def company_cores(t):
    city, k = pick(CITIES, F.floor(F.col("s_suppkey") / 5)), F.col("s_suppkey")
    company = F.concat(pick([f.split("{}")[0] for f in FORMS], k), city, pick([f.split("{}")[1] for f in FORMS], k))
    product = F.concat(city, pick(SUFFIXES, F.col("s_nationkey")))
    strict = N.product_core(product, city, strict=True)
    # the strict form only drops 保险 at the end
    strict = F.concat(strict, F.when(F.col("s_nationkey") % 5 == 0, "").when(F.col("s_nationkey") % 5 == 2, "").otherwise("保险"))
    return t.supplier.select("s_suppkey", N.company_core(company).alias("company"), N.product_core(product, city).alias("product"), strict.alias("strict_long"))


RELATIVES = ["丈夫", "本人", "妈妈", "邻居", " 孩子 ", "太太", "外孙女", ""]
KINDS = ["年金", "意外伤害保险", "-", "健康险", "寿险", "重大疾病", "", "防癌险"]


@query(f"""
SELECT c_custkey, {sql_pick(["配偶", "本人", "母亲", "", "子女", "配偶", "外孙女", ""], "c_custkey")} AS relation,
  CASE c_custkey % 8 WHEN 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN '医疗险' ELSE '年金险' END WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN '医疗险' ELSE '意外险' END WHEN 5 THEN '重疾险' WHEN 7 THEN '防癌险'
    WHEN 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN '医疗险' ELSE '健康险' END WHEN 4 THEN CASE WHEN c_nationkey % 2 = 0 THEN '医疗险' ELSE '寿险' END ELSE CASE WHEN c_nationkey % 2 = 0 THEN '医疗险' ELSE '' END END AS kind FROM customer""")
def aliases(t):
    title = F.when(F.col("c_nationkey") % 2 == 0, "百万医疗计划").otherwise("普通计划")
    return t.customer.select("c_custkey", N.relation(pick(RELATIVES, F.col("c_custkey"))).alias("relation"), N.product_kind(pick(KINDS, F.col("c_custkey")), title).alias("kind"))


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x, instr(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' the ') - 1 AS place FROM documents)
SELECT doc_id, trim(substr(x, CAST(greatest(place - 40, 0) AS BIGINT) + 1, 280)) AS excerpt FROM d WHERE place >= 0""")
def excerpts(t):
    x = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.documents.select("doc_id", "text", (F.instr(x, " the ") - 1).alias("at")).where("at >= 0").select("doc_id", N.excerpt(F.col("text"), F.col("at")).alias("excerpt"))


GRAMS = "list_distinct(CASE WHEN length({0}) = 0 THEN [] ELSE list_transform(range(1, CAST(greatest(length({0}) - {1} + 1, 1) AS BIGINT) + 1), lambda i: substr({0}, i, {1})) END)"
SQL_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"
#: Length of the longest common substring, as SQL over all substrings of the first.
SQL_COMMON = "coalesce((SELECT max(length(substr({a}, i::BIGINT, n::BIGINT))) FROM range(1, length({a}) + 1) r(i), range(1, length({a}) + 1) s(n) WHERE i + n <= length({a}) + 1 AND contains({b}, substr({a}, i::BIGINT, n::BIGINT))), 0)"


@query(f"""
WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, {GRAMS.format("p_name", 2)} AS g FROM n), p AS (SELECT a.p_name AS a, b.p_name AS b FROM g a JOIN g b ON a.p_name < b.p_name AND {SQL_JACCARD.format("a.g", "b.g")} >= 0.3)
SELECT a, b, CAST({SQL_COMMON.format(a="a", b="b")} AS INT) AS common FROM p""")
def common_substrings(t):
    n = t.part.select("p_name").distinct()
    pairs = matching.jaccard_pairs(n, n, "p_name", "p_name", 0.3).where("left_key < right_key").select(F.col("left_key").alias("a"), F.col("right_key").alias("b"))
    return pairs.select("a", "b", N.common_substring(F.col("a"), F.col("b")).cast("int").alias("common"))


KIND_OF = ["终身寿险", "重大疾病险", "", "年金", "医疗险"]


@query(f"""
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '') AS x, {sql_pick(KIND_OF, "p_partkey")} AS kind FROM part), g AS (SELECT x || kind AS x, kind, {GRAMS.format("(x || kind)", 1)} AS g1, {GRAMS.format("(x || kind)", 2)} AS g2, {GRAMS.format("(x || kind)", 3)} AS g3 FROM n),
p AS (SELECT a.x AS a, b.x AS b, a.kind AS ka, b.kind AS kb, {SQL_COMMON.format(a="a.x", b="b.x")} / CAST(least(length(a.x), length(b.x)) AS DOUBLE) AS run, 0.35 * ({SQL_JACCARD.format("a.g3", "b.g3")}) + 0.25 * ({SQL_JACCARD.format("a.g2", "b.g2")}) + 0.2 * ({SQL_JACCARD.format("a.g1", "b.g1")}) AS m, contains(a.x, b.x) OR contains(b.x, a.x) AS held FROM g a JOIN g b ON a.x < b.x AND {SQL_JACCARD.format("a.g2", "b.g2")} >= 0.5)
SELECT a, b, round(greatest(0, least(1, greatest(CASE WHEN held THEN 0.92 ELSE 0 END, m + 0.2 * run) + CASE WHEN ka <> '' AND ka = kb THEN 0.08 WHEN ka <> '' AND kb <> '' AND run < 0.75 THEN -0.06 ELSE 0 END)), 6) AS score FROM p""")
def name_scores(t):
    x = t.part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), pick(KIND_OF, F.col("p_partkey"))).alias("x")).distinct()
    pairs = matching.jaccard_pairs(x, x, "x", "x", 0.5).where("left_key < right_key").select(F.col("left_key").alias("a"), F.col("right_key").alias("b"))
    return pairs.select("a", "b", F.round(N.name_score(F.col("a"), F.col("b"), F.col("a"), F.col("b")), 6).alias("score"))


ASKED = "新安人寿"


@query(f"""
WITH s AS (SELECT s_suppkey, {sql_pick(["新安人寿", "新安人寿保险股份有限公司", "老新安人寿", "新安保险有限公司", "北方"], "s_suppkey")} AS company FROM supplier)
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 20 = 19 THEN 400 ELSE {sql_pick(["X", "Y", "Z", "W", "V"], "s_suppkey").replace("'X'", "320").replace("'Y'", "240").replace("'Z'", "179").replace("'W'", "0").replace("'V'", "0")} END AS INT) AS score FROM s""")
def company_scores(t):
    company = pick(["新安人寿", "新安人寿保险股份有限公司", "老新安人寿", "新安保险有限公司", "北方"], F.col("s_suppkey"))
    return t.supplier.select("s_suppkey", N.company_score(F.lit(ASKED), company, F.col("s_suppkey") % 20 == 19).cast("int").alias("score"))


@query("""
WITH x AS (SELECT p_partkey, lower(p_name || ' ' || regexp_replace(p_brand, '#', '#')) AS m FROM part), y AS (SELECT *, replace(m, ' ', '') AS z FROM x)
SELECT p_partkey, round(CASE WHEN contains(z, 'redwid') THEN 120 - (instr(z, 'redwid') - 1) / 10000.0::DOUBLE WHEN regexp_matches(z, 'r.*?e.*?d.*?w.*?i.*?d') THEN 75 ELSE s END, 6) AS score
FROM (SELECT *, (contains(m, 'red') OR contains(z, 'red'))::INT / 2.0 * 70 + (contains(m, 'wid') OR contains(z, 'wid'))::INT / 2.0 * 70 + ((contains(z, 'r'))::INT + (contains(z, 'e'))::INT + (contains(z, 'd'))::INT + (contains(z, 'w'))::INT + (contains(z, 'i'))::INT) / 5.0 * 30 AS s FROM y)
WHERE contains(z, 'redwid') OR regexp_matches(z, 'r.*?e.*?d.*?w.*?i.*?d') OR s >= 45""")
def list_scores(t):
    score = N.list_score("Red, wid", F.col("p_name"), F.col("p_brand"))
    return t.part.select("p_partkey", F.round(score, 6).alias("score")).where("score > 0")


LABELS = ["保险金额：", "保险金颜：", "金额:", "无关：", ""]


@query(f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN '无关：' || p_size WHEN 4 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS stripped, p_partkey % 5 <> 3 AS salient FROM part""".replace("WHEN 3 THEN '无关：' || p_size", "WHEN 3 THEN '无关：' || p_size WHEN 2 THEN '金额:' || p_size"))
def label_strip(t):
    text = F.concat(pick(LABELS, F.col("p_partkey")), F.col("p_size").cast("string"))
    asked = pick(["红利", "红利发放", "保险金额", "无关", "分红利率"], F.col("p_partkey"))
    # few texts are different: each is read once
    rows = t.part.select("p_partkey", text.alias("text"), asked.alias("asked"))
    rows = relations.once_each(rows, ["text"], {"stripped": N.strip_label(F.col("text"), ["保险金额"])})
    return relations.once_each(rows, ["asked"], {"salient": N.salient_overlap(F.col("asked"), F.lit("红色利润"))}).select("p_partkey", "stripped", "salient")


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{2,4}'))), ',') AS numbers, regexp_extract(text, '([A-Z][a-z]+)\\.', 1) AS last_word FROM documents""")
def regex_captures(t):
    numbers = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{2,4})"), 1))), ",")
    return t.documents.select("doc_id", numbers.alias("numbers"), F.regexp_extract("text", r"([A-Z][a-z]+)\.", 1).alias("last_word"))


@query("""
SELECT c_custkey, '保险责任：身故保险金' || chr(10) || '给付 ' || c_nationkey || '万元' AS kept FROM customer""")
def public_lines(t):
    text = F.concat(F.lit("投保人："), F.col("c_name"), F.lit("\n保险责任：身故保险金\r\n \n住 "), F.col("c_name"), F.lit(" 处\n电话13800138000\n给付 "), F.col("c_nationkey").cast("string"), F.lit("万元"))
    return t.customer.select("c_custkey", N.public_lines(text, F.col("c_name")).alias("kept"))


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '元' AS shown, format('{:,}', CAST(floor(o_totalprice / 10000) AS BIGINT)) || '万' AS short FROM orders")
def formatted_numbers(t):
    whole = F.floor("o_totalprice").cast("bigint")
    return t.orders.select("o_orderkey", F.concat(F.format_number(whole, 0), F.lit("元")).alias("shown"), F.concat(F.format_number(F.floor(F.col("o_totalprice") / 10000).cast("bigint"), 0), F.lit("万")).alias("short"))


@query("""
WITH c AS (SELECT *, CASE WHEN c_custkey % 5 = 4 THEN '00' ELSE lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') END AS m, lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS d, 1930 + c_custkey % 90 AS y FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN '110101' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || m || d || '123' ELSE '110101' || y || m || d || '123X' END AS id, CASE WHEN m <> '00' THEN y || '-' || m || '-' || d END AS birthday, c_custkey % 3 = 0 AS mobile FROM c""")
def identity_numbers(t):
    y, k = 1930 + F.col("c_custkey") % 90, F.col("c_custkey")
    m = F.when(k % 5 == 4, "00").otherwise(F.lpad((1 + k % 12).cast("string"), 2, "0"))
    d = F.lpad((1 + k % 28).cast("string"), 2, "0")
    long = F.concat(F.lit("110101 "), y.cast("string"), m, d, F.lit("-123x"))
    short = F.concat(F.lit("110101"), F.lpad((y % 100).cast("string"), 2, "0"), m, d, F.lit("123"))
    text = F.when(k % 5 == 3, short).otherwise(long)
    mobile = F.when(k % 3 == 0, "13912345678 ").when(k % 3 == 1, "12912345678").otherwise("1391234567")
    return t.customer.select("c_custkey", N.id_number(text).alias("id"), N.id_birthday(text).cast("string").alias("birthday"), N.is_mobile(mobile).alias("mobile"))


TITLES = [("重疾保险金", "重度疾病保险金"), ("身故保险金", "意外身故保险金"), ("第二次重疾保险金", "首次或第二次重疾保险金"), ("轻症疾病保险金（可选责任）", "轻度疾病保险金"), ("身故", ""), ("年金", "养老金")]


@query(f"SELECT p_partkey, {sql_pick(['t', 't', 'f', 't', 'f', 'f'], 'p_partkey')} = 't' AS same FROM part")
def title_matches(t):
    a, b = (pick([x[i] for x in TITLES], F.col("p_partkey")) for i in (0, 1))
    return t.part.select("p_partkey", N.titles_match(a, b).alias("same"))


# --- joins ----------------------------------------------------------------------------------------


@query(f"""
WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, {GRAMS.format("p_name", 2)} AS g FROM n)
SELECT a.p_name AS left_name, b.p_name AS right_name, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 6) AS jaccard, round(2 * len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) AS DOUBLE), 6) AS dice, round(len(list_intersect(a.g, b.g)) / sqrt(len(a.g) * len(b.g)), 6) AS cosine, levenshtein(a.p_name, b.p_name) AS edits
FROM g a JOIN g b ON a.p_name < b.p_name WHERE len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE) >= 0.3""")
def similarity_join(t):
    names = t.part.select("p_name").distinct()
    pairs = matching.jaccard_pairs(names, names, "p_name", "p_name", 0.3).where("left_key < right_key")
    a, b = C.ngrams(F.col("left_key"), 2), C.ngrams(F.col("right_key"), 2)
    return pairs.select(F.col("left_key").alias("left_name"), F.col("right_key").alias("right_name"), F.round("score", 6).alias("jaccard"), F.round(C.dice(a, b), 6).alias("dice"), F.round(C.set_cosine(a, b), 6).alias("cosine"), F.levenshtein("left_key", "right_key").cast("bigint").alias("edits"))


SCANNED = ["保险金颜", "投保人姓名x", "生效日其", "abc", "交费期間"]


@query(f"""
WITH r AS (SELECT p_partkey, {sql_pick(["保险金额", "投保人姓名", "生效日期", "", "缴费期间"], "p_partkey")} AS choice, {sql_pick(["0.88", "1.0", "0.88", "0", "1.0"], "p_partkey")} AS score FROM part) SELECT p_partkey, choice, CAST(score AS DOUBLE) AS score FROM r WHERE choice <> ''""")
def best_choices(t):
    found = matching.best_choice(t.part.select("p_partkey", pick(SCANNED, F.col("p_partkey")).alias("text")), "p_partkey", "text", ["保险金额", "投保人姓名", "生效日期", "缴费期间"], 0.6)
    return found.select("p_partkey", "choice", F.round("score", 6).alias("score"))


@query(f"""
WITH a AS (SELECT p_partkey AS id, p_brand AS company, regexp_replace(lower(p_name), '\\s', '', 'g') AS name, CASE WHEN p_partkey % 40 = 0 THEN 'C' || p_partkey END AS code FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey AS id, p_brand AS company, regexp_replace(lower(p_name), '\\s', '', 'g') AS name, CASE WHEN p_partkey % 40 = 1 THEN 'C' || (p_partkey - 1) END AS code FROM part WHERE p_partkey % 2 = 1),
ag AS (SELECT *, {GRAMS.format("name", 2)} AS g FROM a), bg AS (SELECT *, {GRAMS.format("name", 2)} AS g FROM b),
p AS (SELECT ag.id AS candidate_id, bg.id AS product_id, coalesce(ag.code = bg.code, false) AS coded, ag.company = bg.company AS same, ag.name = bg.name AS exact, 2 * len(list_intersect(ag.g, bg.g)) / CAST(len(ag.g) + len(bg.g) AS DOUBLE) AS d FROM ag JOIN bg ON ag.company = bg.company OR ag.code = bg.code),
s AS (SELECT candidate_id, product_id, CASE WHEN coded THEN 1.0 WHEN same AND exact THEN 0.96 WHEN same AND d >= 0.55 THEN round(0.55 + d * 0.35, 3) END AS score, CASE WHEN coded THEN 'exact_product_code' WHEN same AND exact THEN 'exact_company_name' ELSE 'similar_company_name' END AS reason FROM p)
SELECT candidate_id, product_id, CAST(score AS DOUBLE) AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, product_id) AS k FROM s WHERE score IS NOT NULL) WHERE k <= 5""")
def catalog_matches(t):
    form = lambda df, code: df.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("company"), F.col("p_name").alias("name"), code.alias("codes"))
    none = F.array().cast("array<string>")
    k = F.col("p_partkey")
    a = form(t.part.where("p_partkey % 2 = 0"), F.when(k % 40 == 0, F.array(F.concat(F.lit("c"), k.cast("string")))).otherwise(none))
    b = form(t.part.where("p_partkey % 2 = 1"), F.when(k % 40 == 1, F.array(F.concat(F.lit("C"), (k - 1).cast("string")))).otherwise(none))
    return matching.catalog_matches(a, b)


@query("""
WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS x FROM part), b AS (SELECT DISTINCT p_name AS x FROM part)
SELECT a.x AS left_key, b.x AS right_key FROM a JOIN b ON contains(a.x, b.x) OR contains(b.x, a.x)""")
def containment_join(t):
    a, b = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("x")).distinct(), t.part.select(F.col("p_name").alias("x")).distinct()
    return matching.containment_pairs(a, b, "x", "x")


@query("""
WITH s AS (SELECT s_suppkey, ['新安', '新安人寿', '平和', '平和集团', '北方'][CAST(s_suppkey % 5 + 1 AS INT)] AS c FROM supplier), m AS (SELECT s_suppkey, CASE WHEN c LIKE '新安%' THEN 'a' WHEN c LIKE '平和%' THEN 'b' ELSE c END AS k FROM s)
SELECT x.s_suppkey AS left_key, y.s_suppkey AS right_key FROM m x JOIN m y ON x.k = y.k WHERE x.s_suppkey < y.s_suppkey""")
def alias_join(t):
    names = t.supplier.select("s_suppkey", pick(["新安保险有限公司", "新安人寿", "平和", "平和集团股份有限公司", "北方"], F.col("s_suppkey")).alias("company"))
    # each nation's first supplier lists its other names
    known = t.region.select(F.when(F.col("r_regionkey") % 2 == 0, "新安").otherwise("平和").alias("canonical"), F.when(F.col("r_regionkey") % 2 == 0, "新安人寿").otherwise("平和集团").alias("alias")).distinct()
    return matching.alias_pairs(names, names, "s_suppkey", "company", known).where("left_key < right_key")


@query("""
WITH a AS (SELECT c_custkey AS person_id, c_nationkey AS family_id, CAST(c_custkey % 3 AS VARCHAR) AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 END AS bd, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS tail FROM customer),
m AS (SELECT s_suppkey AS member_id, s_nationkey AS family_id, CAST(s_suppkey % 3 AS VARCHAR) AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 END AS bd, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 7 END AS tail, s_suppkey % 4 AS score FROM supplier),
j AS (SELECT person_id, member_id, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(a.bd = m.bd, false) DESC, coalesce(a.tail = m.tail, false) DESC, score DESC, (m.bd IS NOT NULL)::INT + (m.tail IS NOT NULL)::INT DESC, member_id) AS k FROM a JOIN m USING (family_id, name) WHERE coalesce(a.bd = m.bd, true) AND coalesce(a.tail = m.tail, true))
SELECT a.person_id, j.member_id FROM a LEFT JOIN j ON a.person_id = j.person_id AND k = 1""")
def person_match(t):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    asked = t.customer.select(k.alias("person_id"), F.col("c_nationkey").alias("family_id"), (k % 3).cast("string").alias("name"), F.when(k % 4 != 0, k % 5).alias("birthday"), F.when(k % 2 == 0, k % 7).alias("id_tail"))
    members = t.supplier.select(s.alias("member_id"), F.col("s_nationkey").alias("family_id"), (s % 3).cast("string").alias("name"), F.when(s % 3 != 0, s % 5).alias("birthday"), F.when(s % 5 != 0, s % 7).alias("id_tail"), (s % 4).alias("score"))
    return matching.match_people(asked, members)
