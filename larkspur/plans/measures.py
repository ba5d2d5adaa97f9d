"""Carrier queries on measures, sorts, predicates and nested columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import relations, rollup
from larkspur.plans.carriers import query
from larkspur.plans.policies import pick, sql_pick

# --- aggregates -----------------------------------------------------------------------------------


@query("""
SELECT o_custkey, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END), ''), 'unnamed') AS insured, count(*) AS policies, round(sum(o_totalprice), 2) AS premium FROM orders GROUP BY 1, 2""")
def insured_rollup(t):
    insured = C.or_default(F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")), "unnamed")
    return t.orders.groupBy("o_custkey", insured.alias("insured")).agg(F.count(F.lit(1)).alias("policies"), F.round(F.sum("o_totalprice"), 2).alias("premium"))


@query("""
SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, max(l_quantity) AS highest, count(*) AS n FROM lineitem GROUP BY 1""")
def nested_reduce(t):
    # the entries of a policy as one nested array, as policies carry them
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("cumulative"))).alias("entries"))
    return nested.select("l_orderkey", F.round(C.nested_sum(F.col("entries"), "amount"), 2).alias("total"), C.nested_max(F.col("entries"), "cumulative").alias("highest"), F.size("entries").cast("bigint").alias("n"))


@query("""
WITH i AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_extendedprice END) AS fit, bool_or(l_returnflag = 'R') AS named FROM lineitem GROUP BY 1)
SELECT o_custkey, round(sum(CASE WHEN coalesce(named, false) THEN coalesce(fit, 0) WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END), 2) AS medical FROM orders LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY 1""")
def sum_with_fallback(t):
    named = F.col("l_returnflag") == "R"
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(named & (F.col("l_linestatus") == "F"), F.col("l_extendedprice"))).alias("fit"), F.max(named).alias("named"))
    amount = rollup.with_fallback(F.col("named"), F.col("fit"), F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))
    return t.orders.join(rows, "o_orderkey", "left").groupBy("o_custkey").agg(F.round(F.sum(amount), 2).alias("medical"))


@query("""
WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN l_extendedprice END) AS payout FROM lineitem GROUP BY 1)
SELECT o_custkey, round(sum(CASE WHEN payout > 0 THEN payout ELSE cash END), 2) AS wealth, round(sum(CASE WHEN payout > 0 THEN cash ELSE 0 END), 2) AS reference_only FROM (SELECT o_custkey, coalesce(payout, 0) AS payout, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS cash FROM orders LEFT JOIN p ON o_orderkey = l_orderkey) GROUP BY 1""")
def wealth_dimension(t):
    payout = t.lineitem.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("payout"))
    both = t.orders.join(payout, "o_orderkey", "left").withColumns({"payout": F.coalesce("payout", F.lit(0.0)), "cash": F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)})
    counted, shown = rollup.payout_or_cash(F.col("payout"), F.col("cash"))
    return both.groupBy("o_custkey").agg(F.round(F.sum(counted), 2).alias("wealth"), F.round(F.sum(shown), 2).alias("reference_only"))


@query("""
SELECT 'type' AS dimension, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'filled', 'p_name', count(nullif(trim(p_name), '')) FROM part UNION ALL SELECT 'repeated', 'p_name', count(*) - count(DISTINCT p_name) FROM part""")
def column_statistics(t):
    return rollup.column_statistics(t.part, {"type": "p_type", "brand": "p_brand"}, ["p_name"], ["p_name"])


@query("""
WITH i AS (SELECT unnest([{'d': 'flag', 'v': l_returnflag}, {'d': 'status', 'v': l_linestatus}], recursive := true), l_orderkey * 10 + l_linenumber AS k, l_partkey, l_suppkey FROM lineitem)
SELECT d AS dimension, v AS value, count(*) AS n, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k, l_partkey, l_suppkey) FROM (SELECT k, l_partkey, l_suppkey FROM i j WHERE j.d = i.d AND j.v = i.v ORDER BY k, l_partkey, l_suppkey LIMIT 3)) AS samples FROM i GROUP BY 1, 2""")
def sampled_histograms(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_partkey", "l_suppkey", F.explode(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))).alias("dimension", "value"))
    return rollup.histogram_with_samples(rows, ["dimension", "value"], ["k", "l_partkey", "l_suppkey"], "k", 3)


@query("""
SELECT p_brand AS company, p_name AS product, count(*) AS records, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS codes, min(p_partkey) AS first_id, substr(sha256(lower(p_brand)), 1, 4) AS bucket FROM part GROUP BY 1, 2""")
def suggestion_index(t):
    return rollup.suggestion_index(t.part.select(F.col("p_brand").alias("company"), F.col("p_name").alias("product"), F.col("p_type").alias("code"), F.col("p_partkey").alias("id")))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS policies FROM lineitem GROUP BY 1")
def reference_counts(t):
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("policies"))


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def table_row_counts(t):
    return reduce(lambda a, b: a.unionByName(b), [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in NAMES])


@query("""
WITH m AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS hi, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS lo, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, c_custkey, hi <= 3 OR lo = 1 OR (hi = 4 AND n <= 4) AS shown FROM m""")
def shown_members(t):
    return rollup.shown_members(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "shown")


@query("""
WITH r AS (SELECT p_partkey, p_size > 25 AS pending, row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_partkey) AS k FROM part), q AS (SELECT *, k <= CASE WHEN pending THEN 12 ELSE 28 END AS first FROM r),
f AS (SELECT *, row_number() OVER (ORDER BY first DESC, p_partkey) AS n FROM q) SELECT p_partkey, pending FROM f WHERE n <= 60""")
def filled_sample(t):
    rows = t.part.select("p_partkey", (F.col("p_size") > 25).alias("pending"))
    return rollup.filled_sample(rows, "pending", {True: 12, False: 28}, "p_partkey", 60)


@query("""
WITH e AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT DISTINCT doc_id, trim(unnest([l[1], l[len(l)]])) AS line FROM e) SELECT line, count(*) AS pages FROM x WHERE line <> '' GROUP BY 1 HAVING count(*) >= 2""")
def edge_lines(t):
    lines = F.split("text", "\n")
    edges = t.documents.select("doc_id", F.explode(F.array(F.get(lines, F.lit(0)), F.element_at(lines, -1))).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''").distinct()
    return edges.groupBy("line").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2")


@query("""
WITH a AS (SELECT c_nationkey, count(*) AS n, bit_xor(hash(c_custkey)) AS h FROM customer GROUP BY 1), b AS (SELECT c_nationkey, bool_and(c_acctbal >= -990 OR c_custkey = 0) AS same FROM customer GROUP BY 1) SELECT c_nationkey, same FROM b""")
def snapshot_equality(t):
    changed = t.customer.withColumn("c_custkey", F.when(F.col("c_acctbal") < -990, 0).otherwise(F.col("c_custkey")))
    return relations.same_members(t.customer, changed, ["c_nationkey"], "c_custkey")


# --- sorts ----------------------------------------------------------------------------------------


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders""")
def multi_key_sort(t):
    priority = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(priority, F.desc("o_totalprice"), "o_orderkey")).cast("bigint").alias("place"))


@query("""
WITH d AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, p_name = 'red ring' AS exact, starts_with(p_name, 'red') AS head, contains(p_name, 'red') AS inside, instr(p_name, 'red') AS place, levenshtein(p_name, 'red ring') AS edits FROM d)
SELECT p_name, n FROM s ORDER BY exact DESC, head DESC, inside DESC, CASE WHEN place = 0 THEN 1000 ELSE place END, edits, n DESC, p_name LIMIT 30""")
def relevance_sort(t):
    names = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    name, at = F.col("p_name"), F.instr("p_name", "red")
    order = [F.desc(name == "red ring"), F.desc(name.startswith("red")), F.desc(name.contains("red")), F.when(at == 0, 1000).otherwise(at), F.levenshtein(name, F.lit("red ring")), F.desc("n"), name]
    return names.orderBy(*order).limit(30)


WORDS = ["赵", "钱", "孙", "李", "周"]


@query(f"""
WITH p AS (SELECT p_brand, p_partkey, {sql_pick(WORDS, "p_partkey")} AS word, {sql_pick(["4", "2", "3", "1", "5"], "p_partkey")} AS sound FROM part)
SELECT p_brand, p_partkey, word, row_number() OVER (PARTITION BY p_brand ORDER BY sound, p_partkey) AS place FROM p""")
def locale_sort(t):
    word = pick(WORDS, F.col("p_partkey"))
    rows = t.part.select("p_brand", "p_partkey", word.alias("word"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.collate("word", "zh"), "p_partkey")).cast("bigint"))


@query("""
WITH s AS (SELECT lang, doc_id, 100 * (source LIKE '%a%')::INT + 20 * (length(text) > 0)::INT + 10 * (source LIKE '%e%')::INT + 5 * len(regexp_extract_all(text, '\\bthe\\b')) + least(length(text), 5000) / 100 AS score FROM documents)
SELECT lang, doc_id, CAST(floor(score) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY floor(score) DESC, doc_id DESC) AS k FROM s) WHERE k <= 5""")
def content_quality_sort(t):
    parts = [100 * F.contains("source", F.lit("a")).cast("int"), 20 * (F.length("text") > 0).cast("int"), 10 * F.contains("source", F.lit("e")).cast("int"), 5 * F.regexp_count("text", F.lit(r"\bthe\b")), F.least(F.length("text"), F.lit(5000)) / 100]
    scored = t.documents.select("lang", "doc_id", F.floor(reduce(lambda a, b: a + b, parts)).cast("bigint").alias("score"))
    return relations.best_per_key(scored, ["lang"], [F.desc("score"), F.desc("doc_id")], 5)


@query("""
SELECT l_orderkey, arg_max(l_linenumber * 1000000 + l_partkey, {'a': l_returnflag = 'N', 'b': l_quantity, 'c': l_discount, 'd': -(l_linenumber * 1000000 + l_partkey)}) AS best FROM lineitem GROUP BY 1""")
def best_attempt(t):
    k = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    return t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct((F.col("l_returnflag") == "N").alias("ok"), F.col("l_quantity").alias("rows"), F.col("l_discount").alias("confidence"), (-k).alias("k"))).alias("x")).select("l_orderkey", (-F.col("x.k")).alias("best"))


# --- predicates -----------------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents")
def slim_rows(t):
    return C.without_columns(t.documents, ["text", "source", "absent"])


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size >= 10")
def optional_filters(t):
    given = {"p_brand": "Brand#2", "p_type": "", "p_name": None}
    return t.part.where(C.given_equal(given) & C.in_given("p_type", []) & (F.col("p_size") >= 10)).select("p_partkey")


@query("""
SELECT 'part' AS source, p_name AS name FROM part WHERE p_size > 10 UNION ALL SELECT 'nation', n_name FROM nation""")
def visible_sources(t):
    sources = [("part", t.part, "p_name", ["p_size"], "p_size > 10"), ("nation", t.nation, "n_name", [], "true"), ("region", t.region, "r_name", ["reviewed"], "reviewed = 1"), ("customer", t.customer, "c_name", [], None)]
    return relations.visible_union(sources)


EVIDENCE = [("insurer_official", ""), ("jrcpcx", ""), ("open_web_reference", "insurer_official"), ("customer_policy_photo", "customer_policy_photo_reviewed"), ("", "insurer_official"), ("customer_policy_photo", "customer_policy_photo_pending"), ("", "")]


@query(f"""
SELECT p_partkey, {sql_pick(["insurer_official", "regulatory", "external", "customer", "insurer_official", "other", "other"], "p_partkey")} AS authority, p_partkey % 7 IN (0, 1, 3, 4) AS formal,
  CASE WHEN p_partkey % 7 = 2 THEN 'pending_review' WHEN p_partkey % 7 IN (0, 1, 3, 4) THEN 'verified' ELSE '' END AS status FROM part""")
def evidence_authority(t):
    kind, level = (pick([x[i] for x in EVIDENCE], F.col("p_partkey")) for i in (0, 1))
    authority = C.evidence_authority(kind, level, F.lit(""))
    return t.part.select("p_partkey", authority.alias("authority"), authority.isin(*C.FORMAL_EVIDENCE).alias("formal"), C.verification_status(authority, F.lit("")).alias("status"))


CERTAINTY = ["0.9", "", "low", "uncertain", "0.3", "high", " 0.6 ", "不确定"]


@query(f"SELECT p_partkey, p_partkey % 8 IN (0, 1, 5, 6) AS certain FROM part")
def confidence_filter(t):
    return t.part.select("p_partkey", C.is_certain(pick(CERTAINTY, F.col("p_partkey")), C.rate(60)).alias("certain"))


ROUTED = [("平安福重大疾病保险", "轻度疾病 多次给付", "critical_illness", "pro", "multi_pay"), ("住院医疗保险", "免赔额 报销", "medical", "flash", ""), ("稳赢年金保险(分红型)", "保单红利", "annuity", "pro", "participating"), ("万能账户", "万能型 保单账户价值 结算利率", "universal_life", "pro", "account_value"), ("出行计划", "交通意外 意外身故", "accident", "flash", "traffic_accident_extra"), ("某计划", "可选责任", "other", "pro", "optional_responsibility")]


@query(f"""
SELECT p_partkey, {sql_pick([r[2] for r in ROUTED], "p_partkey")} AS category, {sql_pick([r[3] for r in ROUTED], "p_partkey")} AS tier, {sql_pick([r[4] for r in ROUTED], "p_partkey")} AS tags FROM part""")
def category_routing(t):
    name, text = (pick([r[i] for r in ROUTED], F.col("p_partkey")) for i in (0, 1))
    routed = C.route_category(name, text)
    return t.part.select("p_partkey", routed["category"].alias("category"), routed["tier"].alias("tier"), F.array_join(routed["tags"], ",").alias("tags"))


# --- nested columns -------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal, l_partkey FROM lineitem""")
def flattened_plans(t):
    plans = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("plans"))
    return plans.select("l_orderkey", F.posexplode("plans").alias("ordinal", "p")).select("l_orderkey", F.col("ordinal").cast("bigint").alias("ordinal"), "p.l_partkey")


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS active, bool_or(l_quantity > 45) AS large, bool_and(l_discount <= 0.08) AS modest, min(l_linenumber) FILTER (l_returnflag <> 'R') AS first_active FROM lineitem GROUP BY 1""")
def array_predicates(t):
    plans = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity", "l_discount"))).alias("plans"))
    active = F.filter("plans", lambda p: p["l_returnflag"] != "R")
    return plans.select("l_orderkey", F.size(active).cast("bigint").alias("active"), F.exists("plans", lambda p: p["l_quantity"] > 45).alias("large"), F.forall("plans", lambda p: p["l_discount"] <= 0.08).alias("modest"), F.get(active, F.lit(0))["l_linenumber"].alias("first_active"))


@query("""
WITH u AS (SELECT o_custkey AS k, 1 AS src, o_orderkey AS ord, o_orderstatus || CAST(o_orderkey % 9 AS VARCHAR) AS item FROM orders UNION ALL SELECT o_custkey, 2, l_linenumber + l_partkey * 10, l_returnflag || CAST(l_partkey % 9 AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT *, row_number() OVER (PARTITION BY k, item ORDER BY src, ord) AS n FROM u), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, ord, item) AS place FROM f WHERE n = 1)
SELECT k AS o_custkey, item, place FROM g WHERE place <= 20""")
def pending_items(t):
    first = t.orders.select(F.col("o_custkey"), F.lit(1).alias("src"), F.col("o_orderkey").alias("ord"), F.concat("o_orderstatus", (F.col("o_orderkey") % 9).cast("string")).alias("item"))
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    second = lines.select("o_custkey", F.lit(2).alias("src"), (F.col("l_linenumber") + F.col("l_partkey") * 10).alias("ord"), F.concat("l_returnflag", (F.col("l_partkey") % 9).cast("string")).alias("item"))
    return relations.first_items([first, second], "o_custkey", "item", ["src", "ord", "item"], 20)


@query("SELECT p_partkey, p_brand || '、' || p_type AS joined, CAST(CASE WHEN p_brand = p_type THEN 1 ELSE 2 END AS INT) AS n FROM part")
def joined_uniques(t):
    parts = C.unique_parts(F.col("p_brand"), F.concat(F.lit(" "), F.col("p_type"), F.lit("，"), F.col("p_brand")), F.lit(None).cast("string"))
    return t.part.select("p_partkey", F.array_join(parts, "、").alias("joined"), F.size(parts).alias("n"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, 'stale' AS status, user_id % 2 = 0 AS flagged FROM events""")
def json_merge(t):
    merged = C.json_merge(F.col("props"), {"status": F.lit("stale"), "flagged": F.col("user_id") % 2 == 0})
    return t.events.select("event_id", F.get_json_object(merged, "$.k").cast("int").alias("k"), F.get_json_object(merged, "$.status").alias("status"), (F.get_json_object(merged, "$.flagged") == "true").alias("flagged"))


@query("""
SELECT l_orderkey, count(*) AS plans, count(*) FILTER (l_returnflag = 'A') AS filled, string_agg(CASE WHEN l_returnflag = 'A' THEN 'P' || l_partkey ELSE CAST(l_suppkey AS VARCHAR) END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1""")
def nested_backfill(t):
    plan = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "A", F.col("l_suppkey").cast("string")).otherwise(" ").alias("product_id"))
    plans = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(plan)).alias("plans"))
    done = C.backfilled(F.col("plans"), "product_id", lambda p: F.concat(F.lit("P"), p["l_partkey"].cast("string")))
    was_blank = F.filter("plans", lambda p: F.trim(p["product_id"]) == "")
    return plans.select("l_orderkey", F.size("plans").cast("bigint").alias("plans"), F.size(was_blank).cast("bigint").alias("filled"), F.array_join(F.transform(done, lambda p: p["product_id"]), ",").alias("ids"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS shown FROM customer")
def alias_fields(t):
    return t.customer.select("c_custkey", C.first_filled(F.lit(None).cast("string"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("shown"))


@query("""
SELECT c_nationkey, sha256(string_agg(c_custkey || ':' || c_mktsegment, '|' ORDER BY c_custkey)) AS state FROM customer GROUP BY 1""")
def state_hashes(t):
    return rollup.state_hash(t.customer, ["c_nationkey"], "c_custkey", F.concat_ws(":", "c_custkey", "c_mktsegment"))


# --- matrices -------------------------------------------------------------------------------------

MATRIX = [("general", "一般意外|意外身故"), ("medical", "意外医疗|报销"), ("traffic", "交通意外")]
MATRIX_TEXTS = ["意外身故保险金", "交通意外医疗报销", "公式：意外医疗", "其他"]


@query(f"""
WITH m AS (SELECT o_custkey, [1, 3, 2, 0][CAST(l_partkey % 4 + 1 AS INT)] AS d, l_partkey % 4 AS k, l_quantity AS amount, l_returnflag = 'R' AS inactive FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (SELECT o_custkey, 'general' AS row_key, amount, inactive, false AS formula FROM m WHERE k = 0 UNION ALL SELECT o_custkey, 'medical', amount, inactive, false FROM m WHERE k = 1 UNION ALL SELECT o_custkey, 'traffic', amount, inactive, false FROM m WHERE k = 1 UNION ALL SELECT o_custkey, 'medical', 0, inactive, true FROM m WHERE k = 2),
g AS (SELECT o_custkey, row_key, sum(amount) FILTER (NOT inactive AND NOT formula) AS s, bool_or(formula AND NOT inactive) AS f, bool_or(inactive) AS i FROM x GROUP BY 1, 2), d AS (SELECT DISTINCT o_custkey, r AS row_key FROM m, (SELECT unnest(['general', 'medical', 'traffic']) AS r))
SELECT d.o_custkey, d.row_key, CASE WHEN s > 0 THEN 'covered' WHEN f THEN 'formula' WHEN i THEN 'inactive' ELSE 'missing' END AS status, round(coalesce(s, 0), 2) AS amount FROM d LEFT JOIN g USING (o_custkey, row_key)""")
def protection_matrix(t):
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select("o_custkey", pick(MATRIX_TEXTS, F.col("l_partkey")).alias("text"), F.col("l_quantity").alias("amount"), (F.col("l_returnflag") == "R").alias("inactive"))
    return rollup.protection_matrix(rows, ["o_custkey"], MATRIX, F.col("text").contains("公式"))
