"""Carrier queries on decisions by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import relations, rules
from larkspur.plans.carriers import query
from larkspur.plans.policies import pick, sql_pick

ID = "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey"


def line_id():
    return F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")


WORDS = ["等待期90天", "a longer piece of text", " ", "限额", "x"]


@query(f"""
WITH e AS (SELECT l_orderkey, {sql_pick(WORDS, "l_partkey")} AS content, CASE WHEN l_linenumber % 4 <> 0 THEN 1 - l_discount * 4 END AS c, l_orderkey % 2 = 0 AS native FROM lineitem), f AS (SELECT *, content LIKE '%期%' OR content LIKE '%限额%' AS crit, length(content) AS w FROM e WHERE trim(content) <> ''),
g AS (SELECT l_orderkey, min(c) AS minimum, sum(c * w) / sum(w) FILTER (c IS NOT NULL) AS weighted, min(c) FILTER (crit) AS critical_minimum, count(*) FILTER (c IS NULL) AS missing, bool_and(native) AS native FROM f GROUP BY 1)
SELECT l_orderkey, round(minimum, 6) AS minimum, round(weighted, 6) AS weighted, round(critical_minimum, 6) AS critical_minimum, missing, CASE WHEN critical_minimum < 0.85 THEN 'blocked' WHEN minimum < 0.7 OR (missing > 0 AND NOT native) THEN 'review_required' ELSE 'pass' END AS decision FROM g""")
def evidence_decisions(t):
    rows = t.lineitem.select("l_orderkey", pick(WORDS, F.col("l_partkey")).alias("content"), F.when(F.col("l_linenumber") % 4 != 0, 1 - F.col("l_discount") * 4).alias("confidence"))
    done = rules.evidence_decision(rows, ["l_orderkey"], F.col("content").rlike("期|限额"), F.col("l_orderkey") % 2 == 0)
    return done.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("minimum", "weighted", "critical_minimum")], "missing", "decision")


CHUNKS = ["", "保障 计划", "12 34", "词", "text of a chunk"]


@query(f"""
WITH c AS (SELECT l_orderkey AS doc_id, {ID} AS chunk_id, ['child', 'table', 'parent'][CAST(l_suppkey % 3 + 1 AS INT)] AS kind, {sql_pick(CHUNKS, "l_partkey")} AS content, CAST(l_linenumber % 7 AS INT) AS page, CAST(l_quantity AS INT) AS tokens, 1 - l_discount * 4 AS conf, CAST(l_partkey % 3 AS VARCHAR) AS hash FROM lineitem),
m AS (SELECT *, min(chunk_id) FILTER (kind <> 'parent') OVER (PARTITION BY doc_id, hash) AS f FROM c),
k AS (SELECT chunk_id, doc_id, concat_ws(',', CASE WHEN content = '' THEN 'empty_content' END, CASE WHEN page = 0 THEN 'missing_page_reference' END, CASE WHEN kind = 'table' AND content IN ('', '12 34') THEN 'isolated_table_values' END, CASE WHEN kind <> 'parent' AND chunk_id <> f THEN 'duplicate_content' END) AS b, concat_ws(',', CASE WHEN kind <> 'parent' AND tokens < 4 THEN 'very_short_content' END, CASE WHEN conf < 0.7 THEN 'low_ocr_confidence' END) AS w FROM m)
SELECT chunk_id, concat_ws(',', nullif(b, ''), nullif(w, '')) AS checks, CASE WHEN b <> '' THEN 'blocked' WHEN w <> '' THEN 'review_required' ELSE 'pass' END AS decision FROM k""")
def chunk_gate(t):
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), line_id().alias("chunk_id"), pick(["child", "table", "parent"], F.col("l_suppkey")).alias("kind"), pick(CHUNKS, F.col("l_partkey")).alias("content"), (F.col("l_linenumber") % 7).alias("first_page"), (F.col("l_linenumber") % 7).alias("last_page"),
        F.col("l_quantity").cast("int").alias("tokens"), (1 - F.col("l_discount") * 4).alias("confidence"), (F.col("l_partkey") % 3).cast("string").alias("hash"),
    )
    return rules.chunk_gate(chunks)


@query("""
WITH v AS (SELECT o_orderkey AS version_id, o_custkey AS product, 'L' || o_orderkey % 2 AS label, o_orderdate AS first, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 900 DAY END AS last FROM orders),
a AS (SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 4 = 0 THEN 'L1' ELSE '' END AS label, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '1998-06-01' END AS day FROM customer),
m AS (SELECT ask_id, version_id FROM a JOIN v ON product = ask_id AND (a.label = '' OR a.label = v.label) AND (day IS NULL OR (first <= day AND (last IS NULL OR last >= day)))), n AS (SELECT ask_id, count(version_id) AS n, min(version_id) AS v FROM a LEFT JOIN m USING (ask_id) GROUP BY 1)
SELECT ask_id, CASE WHEN n = 1 THEN v END AS version_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM n""")
def resolved_versions(t):
    versions = t.orders.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("product"), F.concat(F.lit("L"), (F.col("o_orderkey") % 2).cast("string")).alias("label"), F.col("o_orderdate").alias("first"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("last"))
    k = F.col("c_custkey")
    asked = t.customer.select(k.alias("ask_id"), k.alias("product"), F.when(k % 4 == 0, "L1").otherwise("").alias("label"), F.when(k % 7 != 0, F.lit("1998-06-01").cast("timestamp_ntz")).alias("day"))
    return rules.resolve_versions(asked, versions)


@query("""
WITH l AS (SELECT p_partkey AS key, p_brand AS company, p_name AS name FROM part WHERE p_partkey % 5 <> 0), r AS (SELECT p_partkey AS key, p_partkey * 10 + n AS record, 'T' || p_size % 3 AS target, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part, (SELECT unnest([0, 1]) AS n) WHERE p_partkey % 7 <> 0 AND (n = 0 OR p_partkey % 11 = 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY record) AS k FROM r), d AS (SELECT k.*, l.company, CASE WHEN l.key IS NULL THEN 'delete' WHEN k > 1 THEN 'delete_repeat' WHEN l.name <> k.name THEN 'update' ELSE 'keep' END AS action FROM k LEFT JOIN l ON l.key = k.key),
v AS (SELECT company, target, row_number() OVER (PARTITION BY company ORDER BY count(*) DESC, target) AS n FROM d WHERE company IS NOT NULL AND k = 1 GROUP BY 1, 2), c AS (SELECT l.*, v.target AS t FROM l LEFT JOIN v ON v.company = l.company AND n = 1 WHERE key NOT IN (SELECT key FROM r))
SELECT action, key, record, target FROM d WHERE action <> 'keep' UNION ALL SELECT CASE WHEN t IS NULL THEN 'no_target' ELSE 'create' END, key, NULL, t FROM c""")
def reconcile_plan(t):
    k = F.col("p_partkey")
    local = t.part.where("p_partkey % 5 <> 0").select(k.alias("key"), F.col("p_brand").alias("company"), F.col("p_name").alias("name"))
    copies = t.part.where("p_partkey % 7 <> 0").select("*", F.explode(F.when(k % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"))
    remote = copies.select(k.alias("key"), (k * 10 + F.col("n")).alias("record"), F.concat(F.lit("T"), (F.col("p_size") % 3).cast("string")).alias("target"), F.when(k % 6 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    known = t.part.limit(0).select(F.col("p_brand").alias("company"), F.lit("T").alias("target"))
    return rules.reconcile_plan(local, remote, ["name"], known)


ACTIONS = ["replace_amount", "exclude_amount", "note", "replace_amount"]
VALUES = ["1,200", "5", "7", "x"]


@query(f"""
WITH p AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1), c AS (SELECT user_id AS o_custkey, {sql_pick(ACTIONS, "event_id")} AS action, {sql_pick(VALUES, "event_id")} AS v, ts, event_id FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC, event_id DESC) AS k FROM c WHERE action <> 'note') WHERE k = 1)
SELECT coalesce(p.o_custkey, l.o_custkey) AS o_custkey, round(CASE WHEN action IS NULL THEN s WHEN action = 'replace_amount' AND v = '1,200' THEN 1200 ELSE 0 END, 2) AS amount, action IS NOT NULL AND NOT (action = 'replace_amount' AND v = '1,200') AS excluded FROM p FULL JOIN l ON p.o_custkey = l.o_custkey""")
def corrected_parts(t):
    parts = t.orders.select("o_custkey", F.col("o_totalprice").alias("amount"))
    corrections = t.events.select(F.col("user_id").alias("o_custkey"), pick(ACTIONS, F.col("event_id")).alias("action"), pick(VALUES, F.col("event_id")).alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return rules.corrected_parts(parts, corrections, ["o_custkey"]).withColumn("amount", F.round("amount", 2))


@query("""
WITH e AS (SELECT l_orderkey AS case_id, l_partkey % 10 AS chunk_id, CASE WHEN l_suppkey % 5 = 0 THEN 'v2' ELSE 'v1' END AS ver, l_linenumber % 6 <> 0 AS cited FROM lineitem), c AS (SELECT o_orderkey AS case_id, o_orderkey % 10 AS need, (o_orderkey + 3) % 10 AS bad, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE '' END AS ver FROM orders),
g AS (SELECT c.case_id, max(CASE WHEN e.chunk_id = need THEN 1 ELSE 0 END) AS hits, max(CASE WHEN e.chunk_id = bad THEN 1 ELSE 0 END) AS forbidden, count(*) FILTER (c.ver <> '' AND e.ver <> c.ver) AS wrong_version, count(e.case_id) AS evidence, count(*) FILTER (e.cited) AS cited FROM c LEFT JOIN e ON e.case_id = c.case_id GROUP BY 1)
SELECT case_id, CAST(1 AS INT) AS required, CAST(hits AS INT) AS hits, CAST(forbidden AS INT) AS forbidden, wrong_version, evidence, cited, hits = 1 AND forbidden = 0 AND wrong_version = 0 AND cited = evidence AS passed FROM g""")
def evaluated_cases(t):
    k = F.col("o_orderkey")
    cases = t.orders.select(k.alias("case_id"), F.array(k % 10).alias("required"), F.array((k + 3) % 10).alias("forbidden"), F.when(k % 2 == 0, "v1").otherwise("").alias("version"))
    evidence = t.lineitem.select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 10).alias("chunk_id"), F.when(F.col("l_suppkey") % 5 == 0, "v2").otherwise("v1").alias("version"), (F.col("l_linenumber") % 6 != 0).alias("cited"))
    return rules.evaluate_cases(cases, evidence)


@query(f"""
WITH r AS (SELECT l_orderkey, l_quantity AS y, CASE WHEN l_partkey % 4 = 0 THEN l_quantity + 1 ELSE l_extendedprice END AS v, CAST(l_linenumber AS INT) AS age, 1 - l_discount AS c, lag(l_quantity) OVER w AS py, lag(l_linenumber) OVER w AS pa FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, {ID}, l_extendedprice)),
g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (y >= py) AS up, count(*) FILTER (v = floor(v) AND v BETWEEN 1 AND 150 AND abs(v - y) <= 1) AS near, count(*) FILTER (age < pa) AS down, coalesce(avg(c) FILTER (c > 0), 0.8) AS rd FROM r GROUP BY 1),
s AS (SELECT *, up >= 0.5 * (n - 1) AS o FROM g), c AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE floor((rd * 0.4 + CASE WHEN o THEN 1.0 ELSE 0.3 END::DOUBLE * 0.3 + (CASE WHEN o THEN 0.5 ELSE 0 END + CASE WHEN down = 0 THEN 0.3 ELSE 0 END + CASE WHEN n >= 5 THEN 0.2 ELSE 0.1 END)::DOUBLE * 0.3) * 100 + 0.5) / 100 END AS conf FROM s)
SELECT l_orderkey, n >= 3 AND o AND NOT (n >= 5 AND near >= 0.5 * n) AND conf >= 0.7 AS valid, CAST(conf AS DOUBLE) AS confidence FROM c""")
def scanned_table_scores(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", line_id().alias("id"), "l_extendedprice", F.col("l_quantity").alias("policy_year"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_extendedprice")).alias("value"), F.col("l_linenumber").alias("age"), (1 - F.col("l_discount")).alias("confidence"))
    return rules.table_scores(rows, "l_orderkey", ["l_linenumber", "id", "l_extendedprice"])


MATERIAL = ["健康服务 适用人群 问诊", "本产品适用人群 健康服务", "保险责任 给付", "投保年龄 价格", "无"]


@query(f"""
SELECT p_partkey, {sql_pick(["health_services", "target_audience,health_services", "coverage", "underwriting,plan_pricing", ""], "p_partkey")} AS topics FROM part""")
def chunk_topics(t):
    return t.part.select("p_partkey", F.array_join(rules.chunk_topics(pick(MATERIAL, F.col("p_partkey")), F.lit(False)), ",").alias("topics"))


@query("""
WITH v(n, line, lvl, tail) AS (VALUES (0, '开头', 0, ''), (1, '第一条 总则', 1, ''), (2, '一、范围', 2, '第一条 总则'), (3, '正文', 0, '第一条 总则 / 一、范围'), (4, '（1）细则', 3, '第一条 总则 / 一、范围'), (5, '二、责任', 2, '第一条 总则'), (6, '（2）说明。', 0, '第一条 总则 / 二、责任'), (7, '第二条 其他', 1, ''), (8, '文', 0, '第二条 其他'))
SELECT p_partkey, CAST(n AS INT) AS "at", line, CAST(lvl AS INT) AS level, CASE WHEN lvl > 0 THEN CASE WHEN tail = '' THEN line ELSE tail || ' / ' || line END ELSE tail END AS path FROM part, v""")
def heading_paths(t):
    docs = t.part.select("p_partkey", F.lit("开头\n第一条 总则\n一、范围\n正文\n（1）细则\n二、责任\n（2）说明。\n第二条 其他\n 文 ").alias("text"))
    return rules.heading_paths(docs, "p_partkey", "text").select("p_partkey", "at", "line", "level", "path")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey || '|' || l_linenumber AS k FROM lineitem), i AS (SELECT DISTINCT l_orderkey || '|' || l_linenumber AS k FROM lineitem WHERE l_partkey % 9 <> 0), m AS (SELECT k FROM l WHERE k NOT IN (SELECT k FROM i))
SELECT (SELECT count(*) FROM m) AS lost, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM m ORDER BY k LIMIT 20)) AS sample""")
def data_loss(t):
    return rules.data_loss(t.lineitem, t.lineitem.where("l_partkey % 9 <> 0"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderkey % 3 = 0 OR o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1997-01-01')")
def closed_validity(t):
    stop = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS"))
    return t.orders.where(relations.valid_at(F.col("o_orderdate"), stop, F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")


BLANKS = ["", "  ", "有", " Active "]


@query(f"SELECT p_partkey, {sql_pick(['', '', '有', 'active'], 'p_partkey')} AS state FROM part WHERE p_partkey % 4 >= 2 UNION ALL SELECT p_partkey, 'active' FROM part WHERE p_partkey % 4 < 2")
def blank_predicates(t):
    return t.part.select("p_partkey", F.lower(C.or_default(pick(BLANKS, F.col("p_partkey")), "active")).alias("state"))


NUMBERS = ["1,234.5", "$ 7", "", "abc", "NaN", "￥"]


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN 7 END::DOUBLE AS n, CASE p_partkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN 7 ELSE 0 END::DOUBLE AS n0 FROM part")
def safe_numbers(t):
    n = C.number(pick(NUMBERS, F.col("p_partkey")))
    return t.part.select("p_partkey", n.alias("n"), F.coalesce(n, F.lit(0.0)).alias("n0"))


@query("SELECT user_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def zone_days(t):
    day = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd")
    return t.events.groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN NULL ELSE '{\"k\":' || json_extract(props, '$.k') || '}' END AS payload FROM events")
def strict_payloads(t):
    text = F.when(F.col("event_id") % 3 == 0, "{broken").when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"x":"'), F.repeat(F.lit("y"), F.lit(200)), F.lit('"}'))).otherwise(F.col("props"))
    return t.events.select("event_id", C.strict_json(text, 100).alias("payload"))


@query(r"""
SELECT c_custkey, '客户[客户姓名已脱敏] 电话[手机号已脱敏] 座机[固定电话已脱敏] 证件[身份证号已脱敏] 邮箱[邮箱已脱敏] 保单号：[已脱敏] 微信：[已脱敏] 地址：北京市朝阳区[详细地址已脱敏]，住[详细地址已脱敏]' AS safe FROM customer""")
def direct_identifiers(t):
    text = F.concat(F.lit("客户"), F.col("c_name"), F.lit(" 电话+86 138-0013-8000 座机010-12345678 证件11010119900101123X 邮箱a.b@c.org 保单号：AB_123456 微信：wx_abc123 地址：北京市朝阳区某街1号，住幸福里5栋"))
    return t.customer.select("c_custkey", C.redact_direct(text, names=[F.col("c_name")], addresses=[F.lit("幸福里5栋")]).alias("safe"))
