"""Carrier queries on state: claims, versions, memories, publishing, payments, selection in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import documents, state
from larkspur.plans.carriers import query

NOW = "2024-01-20 00:00:00"


@query(f"""
WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'dispatched' END AS status, ts AS updated_at, ts + INTERVAL 1 HOUR AS lease_until, CAST(user_id % 3 AS INT) AS attempts FROM events),
c AS (SELECT * FROM j WHERE status IN ('pending', 'failed') OR (status = 'processing' AND lease_until <= TIMESTAMP '{NOW}') ORDER BY updated_at, id LIMIT 500)
SELECT id, CASE WHEN id % 3 = 0 THEN 'dispatched' WHEN id % 3 = 1 THEN 'failed' ELSE 'processing' END AS status, attempts + 1 AS attempts, CASE WHEN id % 3 = 2 THEN 'w1:' || id || ':{NOW}' ELSE '' END AS token, CASE WHEN id % 3 = 1 THEN 'late' ELSE '' END AS last_error FROM c""")
def outbox_claim(t):
    kind = F.col("event_type")
    jobs = t.events.select(F.col("event_id").alias("id"), F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "error", "failed").otherwise("dispatched").alias("status"), F.col("ts").alias("updated_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("lease_until"), (F.col("user_id") % 3).cast("int").alias("attempts"))
    claimed = state.claim_jobs(jobs, F.lit(NOW).cast("timestamp_ntz"), "w1", "60 SECONDS", 1000)
    # every third comes back without an error, every third with one, the last with a token that is not its own
    results = claimed.select("id", F.when(F.col("id") % 3 == 2, "w2:x").otherwise(F.col("token")).alias("token"), F.when(F.col("id") % 3 == 1, "late").alias("error"))
    return state.finish_jobs(claimed, results).select("id", "status", "attempts", "token", "last_error")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, CAST(floor(value / 20) AS BIGINT) AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, expected = 0 AS accepted, CAST(expected = 0 AS BIGINT) AS version FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.event_id, s.k, s.expected = r.version, r.version + CAST(s.expected = r.version AS BIGINT) FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, event_id, accepted, version FROM r""")
def versioned_saves(t):
    saves = t.events.select("user_id", "event_id", "ts", F.floor(F.col("value") / 20).cast("bigint").alias("expected"))
    return state.versioned_saves(saves, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "accepted", "version")


@query("""
WITH e AS (SELECT user_id, event_type AS topic, CAST(floor(value / 40) AS INT) AS value, max(value) AS confidence, count(*) AS evidence, max(ts) AS moment, arg_max(event_id, ts) AS id FROM events GROUP BY 1, 2, 3),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, topic) AS n, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, id DESC, topic, value) AS k FROM e)
SELECT user_id, topic, value, confidence, evidence, CASE WHEN k > 6 THEN 'archived' WHEN n > 1 THEN 'conflicted' ELSE 'active' END AS status FROM n""")
def memory_upsert(t):
    said = t.events.select("user_id", F.col("event_type").alias("topic"), F.floor(F.col("value") / 40).cast("int").alias("value"), F.col("value").alias("confidence"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return state.fold_memories(said, "user_id", "topic", 6)


@query("""
WITH RECURSIVE n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY user_id) AS n, event_type, value FROM events),
s AS (SELECT *, CASE WHEN event_type = 'error' AND version > 1 THEN 1 + CAST(floor(value) AS BIGINT) % (version - 1) END AS src FROM n),
r AS (SELECT user_id, version, coalesce(src, version) AS at, src IS NULL AS done FROM s UNION ALL SELECT r.user_id, r.version, coalesce(s.src, s.version), s.src IS NULL FROM r JOIN s ON s.user_id = r.user_id AND s.version = r.at WHERE NOT r.done)
SELECT s.user_id, CAST(s.version AS INT) AS version, 'c' || r.at AS content, CASE WHEN s.version = s.n THEN 'published' ELSE 'archived' END AS status FROM s JOIN r ON r.user_id = s.user_id AND r.version = s.version AND r.done""")
def published_versions(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.withColumn("n", n)
    back = (F.col("event_type") == "error") & (F.col("n") > 1)
    log = rows.select("user_id", "n", F.when(back, "rollback").otherwise("publish").alias("action"), F.when(~back, F.concat(F.lit("c"), F.col("n").cast("string"))).alias("content"), (1 + F.floor("value") % F.greatest(F.col("n") - 1, F.lit(1))).cast("int").alias("target"))
    return state.publish_log(log, "user_id", "n")


@query("""
WITH p AS (SELECT l_orderkey AS order_id, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS id, l_shipdate AS moment, CASE WHEN l_returnflag = 'R' THEN o_totalprice + 1 ELSE o_totalprice END AS amount, o_custkey AS user_id, o_orderstatus <> 'P' AS payable, l_returnflag <> 'R' AND o_orderstatus <> 'P' AS ok FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT *, row_number() OVER (PARTITION BY order_id, ok ORDER BY moment, id) AS k FROM p), o AS (SELECT *, CASE WHEN ok AND k = 1 THEN 'applied' WHEN ok THEN 'repeated' WHEN NOT payable THEN 'not_payable' ELSE 'amount_mismatch' END AS outcome FROM f)
SELECT order_id, id, outcome, count(*) AS n FROM o GROUP BY 1, 2, 3""")
def idempotent_payments(t):
    id_ = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10 + F.col("l_linenumber")
    due = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") != "P").alias("payable"))
    paid = t.lineitem.select(F.col("l_orderkey").alias("order_id"), id_.alias("id"), F.col("l_shipdate").alias("at"), "l_returnflag").join(due.select("order_id", "amount"), "order_id")
    payments = paid.select("order_id", "id", "at", F.when(F.col("l_returnflag") == "R", F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"))
    return state.paid_orders(payments, due, 30).groupBy("order_id", "id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE h AS (SELECT l_orderkey, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS id, l_suppkey % 4 AS page, l_returnflag AS topic, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) AS k FROM lineitem),
r AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS id, CAST([] AS BIGINT[]) AS pages, CAST([] AS VARCHAR[]) AS topics, false AS ok FROM h
  UNION ALL SELECT l_orderkey, k, id, CASE WHEN ok THEN list_append(pages, page) ELSE pages END, CASE WHEN ok THEN list_append(topics, topic) ELSE topics END, ok FROM (SELECT h.*, r.pages, r.topics, len(r.pages) < 6 AND NOT list_contains(r.pages, h.page) AND len(list_filter(r.topics, lambda x: x = h.topic)) < CASE h.topic WHEN 'A' THEN 2 ELSE 1 END AS ok FROM r JOIN h ON h.l_orderkey = r.l_orderkey AND h.k = r.k + 1))
SELECT l_orderkey, id FROM r WHERE ok""")
def greedy_caps(t):
    hits = t.lineitem.select("l_orderkey", (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"), "l_quantity", (F.col("l_suppkey") % 4).alias("page"), F.col("l_returnflag").alias("topic"))
    return documents.greedy_caps(hits, "l_orderkey", [F.desc("l_quantity"), F.col("id")], "page", "topic", {"A": 2, "N": 1}, 1, 6).select("l_orderkey", "id")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, value AS mean, 1 AS n, 1 AS line FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.event_id, s.k, CASE WHEN abs(s.value - mean) > 5 THEN s.value ELSE (mean * n + s.value) / (n + 1) END, CASE WHEN abs(s.value - mean) > 5 THEN 1 ELSE n + 1 END, CASE WHEN abs(s.value - mean) > 5 THEN line + 1 ELSE line END FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, event_id, line FROM r""")
def centred_lines(t):
    boxes = t.events.select("user_id", "event_id", "value")
    return documents.centred_lines(boxes, "user_id", "value", ["event_id"], 5.0).select("user_id", "event_id", "line")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS issue FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 300000 OR o_orderkey % 50 = 1 THEN 'large' ELSE 'small' END AS issue FROM orders WHERE o_orderkey % 3 <> 0),
c AS (SELECT DISTINCT o_custkey FROM ((SELECT * FROM o EXCEPT SELECT * FROM f) UNION ALL (SELECT * FROM f EXCEPT SELECT * FROM o)))
SELECT o_custkey, o_orderkey, issue, CASE WHEN o_custkey IN (SELECT o_custkey FROM c) THEN 'archived' ELSE 'open' END AS status FROM o UNION ALL SELECT f.o_custkey, o_orderkey, issue, 'open' FROM f JOIN c ON c.o_custkey = f.o_custkey""")
def rule_issue_sync(t):
    large = F.col("o_totalprice") > 300000
    rows = t.orders.where("o_orderkey % 3 <> 0")
    form = lambda c: rows.select("o_custkey", "o_orderkey", F.when(c, "large").otherwise("small").alias("issue"))
    return state.sync_issues(form(large), form(large | (F.col("o_orderkey") % 50 == 1)), "o_custkey", ["o_orderkey", "issue"])


@query("""
WITH p AS (SELECT c_custkey AS member_id, c_nationkey AS family_id, 'n' || c_custkey % 4 AS name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 3 AS VARCHAR) END AS identity, CAST(c_custkey % 6 AS INT) AS score FROM customer),
d AS (SELECT family_id, name, count(DISTINCT identity) AS kinds, max(identity) AS one FROM p GROUP BY 1, 2), g AS (SELECT p.*, CASE WHEN identity IS NULL AND kinds = 1 THEN one WHEN identity IS NULL AND kinds = 0 THEN '' WHEN identity IS NULL THEN '#' || member_id ELSE identity END AS grp FROM p JOIN d USING (family_id, name)),
k AS (SELECT *, first_value(member_id) OVER (PARTITION BY family_id, name, grp ORDER BY score DESC, (identity IS NOT NULL) DESC, member_id) AS keeper FROM g)
SELECT o_orderkey, keeper AS o_custkey, keeper <> member_id AS moved FROM orders JOIN k ON o_custkey = member_id""")
def member_merge(t):
    k = F.col("c_custkey")
    people = t.customer.select(k.alias("member_id"), F.col("c_nationkey").alias("family_id"), F.concat(F.lit(" n"), (k % 4).cast("string")).alias("name"), F.when(k % 5 != 0, (k % 3).cast("string")).alias("identity"), (k % 6).cast("int").alias("score"))
    keepers = state.keepers(people)
    return t.orders.join(keepers, F.col("o_custkey") == F.col("member_id")).select("o_orderkey", F.col("keeper").alias("o_custkey"), (F.col("keeper") != F.col("member_id")).alias("moved"))


@query("""
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS id, l_linenumber AS page, CAST(l_quantity AS INT) AS tokens, l_partkey % 3 = 0 AS tbl, l_partkey % 2 = 0 AS held FROM lineitem),
p AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice / 10000 AS INT) AS tokens FROM orders)
SELECT c.doc_id, c.id, CASE WHEN held AND NOT tbl AND p.tokens <= 30 THEN 'parent' ELSE 'child' END AS shown, CASE WHEN held AND NOT tbl AND p.tokens <= 30 THEN p.tokens ELSE c.tokens END AS tokens FROM c JOIN p ON c.doc_id = p.doc_id""")
def parent_evidence(t):
    id_ = F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    children = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), id_.alias("id"), F.when(F.col("l_partkey") % 2 == 0, "part").otherwise("other").alias("content"), F.lit(2).alias("first_page"), F.lit(2).alias("last_page"), F.col("l_quantity").cast("int").alias("tokens"), (F.col("l_partkey") % 3 == 0).alias("is_table"))
    parents = t.orders.select(F.col("o_orderkey").alias("parent_id"), F.lit("whole part text").alias("content"), F.lit(1).alias("first_page"), F.lit(3).alias("last_page"), F.rint(F.col("o_totalprice") / 10000).cast("int").alias("tokens"))  # halves to even, as casts in SQL do
    return documents.with_parents(children, parents, 30).select(F.col("parent_id").alias("doc_id"), "id", "shown", "tokens")
