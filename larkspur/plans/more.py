"""Further carrier queries: state, matching, scoring and text measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import documents, relations, rollup, series
from larkspur.plans.carriers import query
from larkspur.sources import io


@query("""
SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '000000012') OR contains('customer#000000012 and more', lower(c_name))""")
def bidirectional_like(t):
    name = F.col("c_name")
    return t.customer.where(F.contains(name, F.lit("000000012")) | F.contains(F.lit("customer#000000012 and more"), F.lower(name))).select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderdate + INTERVAL 3 YEAR < TIMESTAMP '2000-01-01' THEN 'expired' ELSE 'active' END AS state FROM orders""")
def active_state(t):
    ended = F.col("o_orderdate") + F.expr("INTERVAL 3 YEAR") < F.lit("2000-01-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").when(ended, "expired").otherwise("active").alias("state"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)""")
def owner_rows(t):
    shared = t.lineitem.where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("shared", F.lit(True))
    return t.orders.join(shared, "o_orderkey", "left").where("o_custkey = 7 OR shared").select("o_orderkey", "o_custkey")


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, datediff('day', lag(l_shipdate) OVER w, l_shipdate) AS gap, l_discount FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, median(gap) AS median_gap, round(avg(CASE WHEN gap IS NULL THEN NULL WHEN gap >= 0 THEN 1.0 ELSE 0.0 END), 6) AS ordered, round(avg(1 - l_discount), 6) AS confidence FROM g GROUP BY 1""")
def table_scoring(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    gap = F.datediff("l_shipdate", F.lag("l_shipdate").over(w))
    rows = t.lineitem.select("l_orderkey", gap.alias("gap"), "l_discount")
    return rows.groupBy("l_orderkey").agg(F.median("gap").alias("median_gap"), F.round(F.avg(F.when(F.col("gap") >= 0, 1.0).when(F.col("gap") < 0, 0.0)), 6).alias("ordered"), F.round(F.avg(1 - F.col("l_discount")), 6).alias("confidence"))


@query("""
WITH n AS (SELECT user_id, event_id, CAST(floor(value + 0.5) AS INT) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS offset_ FROM events)
SELECT user_id, CAST(offset_ AS BIGINT) AS shift, count(*) AS pages FROM n GROUP BY 1, 2 HAVING count(*) >= 3""")
def sequential_numbers(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    shifted = t.events.select("user_id", (F.floor(F.col("value") + 0.5).cast("int") - k).cast("bigint").alias("shift"))
    return shifted.groupBy("user_id", "shift").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")


@query("""
WITH a AS (SELECT o_custkey, max(o_orderdate) AS made FROM orders GROUP BY 1), b AS (SELECT o_custkey, max(l_shipdate) AS changed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT a.o_custkey, made, changed, coalesce(changed <= made, true) AS fresh FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey""")
def reuse_if_fresh(t):
    made = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("made"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("changed"))
    changed = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.max("changed").alias("changed"))
    return made.join(changed, "o_custkey", "left").withColumn("fresh", F.coalesce(F.col("changed") <= F.col("made"), F.lit(True)))


@query("""
WITH k AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 500)) AS keeper FROM customer)
SELECT o_orderkey, keeper AS o_custkey FROM orders JOIN k ON o_custkey = c_custkey""")
def member_repoint(t):
    groups = ["c_nationkey", "c_mktsegment", "band"]
    people = t.customer.withColumn("band", F.floor(F.col("c_acctbal") / 500))
    keepers = people.groupBy(*groups).agg(F.min("c_custkey").alias("keeper"))
    link = people.join(keepers, groups).select(F.col("c_custkey").alias("o_custkey"), "keeper")
    return t.orders.select("o_orderkey", "o_custkey").join(link, "o_custkey").select("o_orderkey", F.col("keeper").alias("o_custkey"))


@query("""
SELECT p_brand, p_type, count(*) AS n, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS codes, min(p_partkey) FILTER (p_retailprice = m) AS best
FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS m FROM part) GROUP BY 1, 2""")
def candidate_groups(t):
    codes = F.array_join(F.sort_array(F.collect_set(F.col("p_size").cast("string"))), ",")
    best = F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k")))
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), codes.alias("codes"), (-best["k"]).alias("best"))


@query("""
SELECT p_partkey, substr(sha256(p_brand || chr(31) || p_name), 1, 16) AS product_id FROM part""")
def stable_keys(t):
    return t.part.select("p_partkey", C.content_key(F.col("p_brand"), F.col("p_name"), digits=16).alias("product_id"))


@query("""
SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, ends_with(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.example.org') OR lower(regexp_extract(url, '://([^/?#:]*)', 1)) = 'example.org' AS official FROM pages""")
def official_hosts(t):
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    return t.pages.select("page_id", host.alias("host"), (F.endswith(host, F.lit(".example.org")) | (host == "example.org")).alias("official"))


@query("""
SELECT doc_id, round(length(regexp_replace(text, '[A-Za-z0-9\\s.,;:!?-]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS odd_share FROM documents""")
def text_quality_ratio(t):
    odd = F.length(F.regexp_replace("text", r"[A-Za-z0-9\s.,;:!?-]", ""))
    return t.documents.select("doc_id", F.round(odd / F.greatest(F.length("text"), F.lit(1)), 6).alias("odd_share"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:\\.[0-9]+)?')) AS tokens FROM documents""")
def token_estimates(t):
    return t.documents.select("doc_id", C.token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query("""
SELECT p_partkey, 'Dear ' || p_name || ' of ' || p_brand || ', {{unknown}}' AS message FROM part""")
def template_fill(t):
    message = C.fill_template(F.lit("Dear {{name}} of {{brand}}, {{unknown}}"), {"name": F.col("p_name"), "brand": F.col("p_brand")})
    return t.part.select("p_partkey", message.alias("message"))


@query("""
WITH old AS (SELECT p_partkey, p_name, p_size AS version FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey, upper(p_name) AS p_name, 25 AS version FROM part WHERE p_partkey % 2 = 0),
u AS (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) SELECT p_partkey, p_name, version FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY version DESC, n DESC) AS k FROM u) WHERE k = 1""")
def upsert_newest(t):
    old = t.part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", F.col("p_size").alias("version"))
    new = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(25).alias("version"))
    return relations.upsert(old, new, ["p_partkey"], "version")


@query("""
SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0""")
def insert_or_ignore(t):
    old, new = t.part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name"), t.part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"))
    return relations.insert_missing(old, new, ["p_partkey"])


@query("""
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(nullif(b.p_name, ''), a.p_name) AS p_name, coalesce(b.p_size, a.p_size) AS p_size FROM (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0) a
FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE 'new' END AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 2 = 0) b ON a.p_partkey = b.p_partkey""")
def fieldwise_merge(t):
    old = t.part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_size")
    new = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") > 25, "").otherwise("new").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return relations.merge_fields(old, new, "p_partkey")


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL BY NAME SELECT r_regionkey AS n_regionkey, r_name FROM region")
def union_by_name(t):
    return t.nation.unionByName(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), allowMissingColumns=True)


@query("""
SELECT c.c_custkey, CASE WHEN length(n_name) <= 8 THEN n_name ELSE c_name END AS shown, CASE WHEN length(n_name) <= 8 THEN 'parent' ELSE 'child' END AS kind FROM customer c JOIN nation ON n_nationkey = c_nationkey""")
def parent_substitution(t):
    fits = F.length("n_name") <= 8
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select("c_custkey", F.when(fits, F.col("n_name")).otherwise(F.col("c_name")).alias("shown"), F.when(fits, "parent").otherwise("child").alias("kind"))


@query("""
WITH s AS (SELECT user_id, ts, event_id, value, CASE WHEN value - lag(value) OVER w <= 15 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS line FROM s)
SELECT user_id, CAST(line AS BIGINT) AS line, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS cells FROM r GROUP BY 1, 2""")
def reading_order(t):
    lines = series.lines(t.events, ["user_id"], "value", "event_id", 15.0)
    cells = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), " ")
    return lines.groupBy("user_id", "line").agg(cells.alias("cells"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) OVER w AS least, round(avg(l_extendedprice) OVER w, 4) AS mean FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def sliding_measures(t):
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").rowsBetween(-2, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.min("l_quantity").over(w).alias("least"), F.round(F.avg("l_extendedprice").over(w), 4).alias("mean"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+\\.$') OR length(line) < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY 1, 2""")
def section_split(t):
    return documents.sections(t.documents, "doc_id", "text", r"^[A-Z][a-z]+\.$", 30).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
r AS (SELECT doc_id, pos, string_split(line, '|') AS cells FROM l WHERE contains(line, '|') AND NOT regexp_matches(line, '^[ |:-]*$'))
SELECT doc_id, CAST(pos - 1 AS INT) AS line_no, CAST(col - 1 AS INT) AS column_no, trim(cell) AS cell FROM (SELECT doc_id, pos, unnest(cells) AS cell, generate_subscripts(cells, 1) AS col FROM r)""")
def markdown_cells(t):
    return documents.pipe_cells(t.documents, "doc_id", "text")


@query("""
WITH s AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'OTHER']) AS segment), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT n_nationkey, segment, coalesce(n, 0) AS members FROM nation, s LEFT JOIN c ON c_nationkey = n_nationkey AND c_mktsegment = segment""")
def missing_member_completion(t):
    wanted = F.explode(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER")]))
    grid = t.nation.select("n_nationkey", wanted.alias("segment"))
    counted = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, ["n_nationkey", "segment"], "left").select("n_nationkey", "segment", F.coalesce("n", F.lit(0)).alias("members"))


@query("""
SELECT o_orderkey, issue FROM (SELECT o_orderkey, unnest([CASE WHEN o_totalprice > 450000 THEN 'large' END, CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'old' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END]) AS issue FROM orders) WHERE issue IS NOT NULL""")
def report_rule_issues(t):
    rules = [(F.col("o_totalprice") > 450000, "large"), (F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz"), "old"), (F.col("o_orderstatus") == "P", "pending")]
    return t.orders.select("o_orderkey", F.explode(F.array_compact(F.array(*[F.when(p, name) for p, name in rules]))).alias("issue"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_retailprice < 905 THEN 'cheap' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END) AS issues,
  CASE WHEN p_size < 5 THEN 'repair' WHEN p_retailprice < 905 THEN 'review' WHEN p_type = 'PROMO' THEN 'relabel' ELSE 'keep' END AS action FROM part""")
def repair_classification(t):
    rules = [(F.col("p_size") < 5, "small", "repair"), (F.col("p_retailprice") < 905, "cheap", "review"), (F.col("p_type") == "PROMO", "promo", "relabel")]
    issues = F.array_join(F.array_compact(F.array(*[F.when(p, name) for p, name, _ in rules])), ",")
    action = F.coalesce(*[F.when(p, what) for p, _, what in rules], F.lit("keep"))
    return t.part.select("p_partkey", issues.alias("issues"), action.alias("action"))


@query("""
SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CAST(floor(o_totalprice / 50000) AS BIGINT) AS basis, count(*) AS merged, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS sources, round(max(o_totalprice), 2) AS amount FROM orders GROUP BY 1, 2, 3""")
def equivalent_entry_merge(t):
    sources = F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "")
    keys = ["o_custkey", F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 50000).alias("basis")]
    return t.orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("merged"), sources.alias("sources"), F.round(F.max("o_totalprice"), 2).alias("amount"))


@query("""
WITH RECURSIVE d AS (SELECT coalesce(lang, '') AS lang, doc_id, n_chars, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) AS k FROM documents),
r AS (SELECT lang, doc_id, n_chars, k, n_chars AS used, true AS ok FROM d WHERE k = 1 UNION ALL SELECT d.lang, d.doc_id, d.n_chars, d.k, CASE WHEN used + d.n_chars <= 100000 THEN used + d.n_chars ELSE used END, used + d.n_chars <= 100000 FROM r JOIN d ON d.lang = r.lang AND d.k = r.k + 1)
SELECT lang, doc_id, n_chars FROM r WHERE ok""")
def budget_packing(t):
    hits = t.documents.select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", "n_chars")
    return documents.pack(hits, "lang", [F.col("doc_id")], "doc_id", "n_chars", 100_000)


@query("""
SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS keys, 0 AS problems FROM customer UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT, 0 FROM orders UNION ALL SELECT 'part', count(*), sum(p_partkey)::BIGINT, 0 FROM part""")
def bundle_restored(t):
    import uuid

    from larkspur.sources import bundle, shared

    tables = {"customer": t.customer, "orders": t.orders, "part": t.part}
    spark = t.part.sparkSession
    folder = f"{shared.shared_dir(spark)}/larkspur-{uuid.uuid4().hex}/bundle"
    bundle.write_bundle(tables, folder)
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"}
    found = bundle.problems(spark, folder).agg(F.count(F.lit(1)).cast("int").alias("problems"))
    each = [bundle.restored(spark, folder, n).agg(F.count(F.lit(1)).alias("n"), F.sum(keys[n]).alias("keys")).select(F.lit(n).alias("name"), "n", "keys") for n in tables]
    return each[0].unionByName(each[1]).unionByName(each[2]).join(F.broadcast(found))  # one row


@query("""
WITH p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER () AS total FROM part), w AS (SELECT *, (total + 24) // 25 AS pages FROM p)
SELECT p_partkey, p_name, pages AS page, pages, (pages - 1) * 25 + 1 AS first, total AS last, total FROM w WHERE k > (pages - 1) * 25""")
def last_page(t):
    # a page beyond the last one is the last one
    return relations.page_window(t.part.select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 1_000_000_000, 25).drop("p_retailprice")


@query("""
WITH e AS (SELECT l_orderkey, year(l_shipdate) AS year, CASE WHEN l_linenumber % 3 <> 1 THEN l_linenumber + 30 END AS age, l_extendedprice AS amount, CASE WHEN l_tax > 0.02 THEN l_linestatus || l_returnflag END AS liability, l_returnflag = 'R' AS estimated, l_linenumber, l_partkey, l_suppkey FROM lineitem),
f AS (SELECT l_orderkey, year, liability, min((l_linenumber, l_partkey, l_suppkey)) AS k FROM e WHERE liability IS NOT NULL GROUP BY ALL), l AS (SELECT l_orderkey, year, string_agg(liability, '、' ORDER BY k) AS liabilities FROM f GROUP BY ALL),
y AS (SELECT l_orderkey, year, sum(amount) AS amount, arg_min(age, (l_linenumber, l_partkey, l_suppkey)) FILTER (age IS NOT NULL) AS age, bool_or(estimated) AS estimated FROM e GROUP BY ALL)
SELECT l_orderkey, year::INT AS year, round(amount, 2) AS amount, round(sum(amount) OVER (PARTITION BY l_orderkey ORDER BY year), 2) AS cumulative, age::INT AS age, coalesce(liabilities, '') AS liabilities, estimated FROM y LEFT JOIN l USING (l_orderkey, year)""")
def annual_payouts(t):
    entries = t.lineitem.select(
        "l_orderkey", F.year("l_shipdate").alias("year"), F.when(F.col("l_linenumber") % 3 != 1, F.col("l_linenumber") + 30).cast("int").alias("age"), F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_tax") > 0.02, F.concat("l_linestatus", "l_returnflag")).alias("liability"), (F.col("l_returnflag") == "R").alias("estimated"), "l_linenumber", "l_partkey", "l_suppkey",
    )
    years = rollup.annual_payouts(entries, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    return years.withColumns({"amount": F.round("amount", 2), "cumulative": F.round("cumulative", 2)})


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderstatus IN ('F', 'P')""")
def facts_or_absent(t):
    payload = F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 2 == 0, "{}")).otherwise(F.to_json(F.struct(F.array("o_orderstatus", F.lit("x")).alias("factKeys"))))
    keys = F.from_json(payload, "factKeys array<string>")["factKeys"]
    return t.orders.where(keys.isNull() | F.arrays_overlap(keys, F.array(F.lit("F"), F.lit("P")))).select("o_orderkey")


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_type, 'STEEL|TIN') AND NOT regexp_matches(p_type, 'POLISHED') THEN 'metal' END, CASE WHEN regexp_matches(p_type, '^SMALL|^MEDIUM') THEN 'light' END, CASE WHEN regexp_matches(p_type, 'PLATED') AND NOT regexp_matches(p_type, 'BRASS$') THEN 'plated' END) AS labels FROM part""")
def topics_with_exclusions(t):
    rules = [("STEEL|TIN", "POLISHED", "metal"), ("^SMALL|^MEDIUM", None, "light"), ("PLATED", "BRASS$", "plated")]
    return t.part.select("p_partkey", F.array_join(C.topics(F.col("p_type"), rules), ",").alias("labels"))
