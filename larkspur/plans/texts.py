"""Carrier queries on retrieval, clauses, facts, products and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import clauses, documents, phrases, retrieval
from larkspur.plans.carriers import query
from larkspur.plans.policies import pick, sql_pick

# --- retrieval ------------------------------------------------------------------------------------

PHRASE = "the"
SQL_TF = "CAST((length({c}) - length(replace({c}, '{p}', ''))) / {n} AS INT)"


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS c, lower(source || ' ' || lang) AS p FROM documents), q AS (SELECT unnest(['the', 'ation', 'web']) AS phrase),
m AS (SELECT doc_id, phrase, greatest(length(c) - 2, 0) AS lc, greatest(length(p) - 2, 0) AS lp, CAST((length(c) - length(replace(c, phrase, ''))) / length(phrase) AS INT) AS tc, CAST((length(p) - length(replace(p, phrase, ''))) / length(phrase) AS INT) AS tp FROM d, q),
n AS (SELECT count(*) AS n, avg(greatest(length(c) - 2, 0)) AS mc, avg(greatest(length(p) - 2, 0)) AS mp FROM d), f AS (SELECT phrase, count(*) AS df FROM m WHERE tc > 0 OR tp > 0 GROUP BY 1)
SELECT doc_id, m.phrase, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * (tc + 0.35::DOUBLE * tp) * 2.2 / ((tc + 0.35::DOUBLE * tp) + 1.2 * (0.25 + 0.75 * (lc + lp) / (mc + mp))), 6) AS score FROM m JOIN f ON m.phrase = f.phrase, n WHERE tc > 0 OR tp > 0""")
def phrase_search(t):
    chunks = t.documents.select("doc_id", F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("prefix"))
    return retrieval.phrase_bm25(chunks, "doc_id", ["the", "ation", "web"]).withColumn("score", F.round("score", 6))


@query("""
SELECT doc_id, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE contains(lower(text), 'ou') OR contains(lower(source), 'ou') ORDER BY place LIMIT 50""")
def short_query(t):
    chunks = t.documents.select("doc_id", F.col("text").alias("content"), F.col("source").alias("prefix"), "n_chars")
    return retrieval.search_chunks(chunks, "doc_id", "ou", "n_chars", 500).withColumn("place", F.col("place").cast("bigint"))


QUESTIONS = ["exact_field", "clause_explanation", "product_advantage", "general"]


@query(f"""
SELECT conv_id, turn, {sql_pick(["true", "true", "true", "false"], "turn")} = 'true' AS use_facts, {sql_pick(["2", "2", "6", "4"], "turn")}::INT AS materials, {sql_pick(["fact,clause,formula", "clause,definition,process,fact", "claim,fact,clause,process", ""], "turn")} AS kinds FROM conversations""")
def retrieval_plans(t):
    return t.conversations.select("conv_id", "turn", retrieval.retrieval_plan(pick(QUESTIONS, F.col("turn"))).alias("p")).select("conv_id", "turn", "p.*")


@query("""
WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey * 10 + l_linenumber % 7 + 1) AS needs, max(l_quantity) AS q FROM lineitem GROUP BY 1), r AS (SELECT id, CAST(q AS DOUBLE) AS score, needs FROM c WHERE q > 45)
SELECT id, score FROM r UNION ALL SELECT id, 0.0 FROM c WHERE id IN (SELECT needs FROM r) AND id NOT IN (SELECT id FROM r)""")
def required_context(t):
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    chunks = t.lineitem.groupBy(k).agg(F.array(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber") % 7 + 1)).alias("needs"), F.max("l_quantity").alias("q"))
    ranked = chunks.where("q > 45").select("id", F.col("q").alias("score"))
    return retrieval.with_required(ranked, chunks.select("id", "needs"), "id", "needs")


#: What the SQL of the index searches starts with: the same scores from a scan of all texts.
SCORED = """WITH d AS (SELECT doc_id, lower(text) AS c, lower(source || ' ' || lang) AS p FROM documents), q AS (SELECT unnest([{0}]) AS phrase),
m AS (SELECT doc_id, phrase, greatest(length(c) - 2, 0) AS lc, greatest(length(p) - 2, 0) AS lp, CAST((length(c) - length(replace(c, phrase, ''))) / length(phrase) AS INT) AS tc, CAST((length(p) - length(replace(p, phrase, ''))) / length(phrase) AS INT) AS tp FROM d, q),
n AS (SELECT count(*) AS n, avg(greatest(length(c) - 2, 0)) AS mc, avg(greatest(length(p) - 2, 0)) AS mp FROM d), f AS (SELECT phrase, count(*) AS df FROM m WHERE tc > 0 OR tp > 0 GROUP BY 1),
s AS (SELECT doc_id, m.phrase, greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * (tc + 0.35::DOUBLE * tp) * 2.2 / ((tc + 0.35::DOUBLE * tp) + 1.2 * (0.25 + 0.75 * (lc + lp) / (mc + mp))) AS score FROM m JOIN f ON m.phrase = f.phrase, n WHERE tc > 0 OR tp > 0)"""


def indexed(t):
    return phrases.build_index(t.documents.select("doc_id", F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("prefix")), "doc_id")


@query(SCORED.format("'ation', 'web', ' th', 'nda', 'erer', 'es of the'") + """
SELECT doc_id, phrase, round(score, 6) AS score FROM s""")
def indexed_phrases(t):
    return phrases.search(indexed(t), ["ation", "web", " th", "nda", "erer", "es of the"]).withColumn("score", F.round("score", 6))


@query(SCORED.format("'ation'") + """
SELECT doc_id, source, round(score, 6) AS score, quality FROM s JOIN documents USING (doc_id) JOIN labels USING (doc_id)""")
def search_join(t):
    # the score of the indexed search, joined to its document and to what is known of it
    scored = phrases.search(indexed(t), ["ation"]).select("doc_id", F.round("score", 6).alias("score"))
    return scored.join(t.documents.select("doc_id", "source"), "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")


ASPECTS = {"waiting": ["wait", "anda"], "limits": ["zzzz", "xqxq"], "renewal": ["renew", "ren "], "scope": ["the"]}
ASKED_IN_ROUNDS = [(1, "ation", ["waiting", "scope"]), (2, "erer", ["limits", "renewal"]), (3, "nothing at all", ["waiting"]), (4, "web", []), (5, "es of the", ["renewal", "waiting", "limits"])]
ROUNDS = SCORED.format("'ation', 'erer', 'nothing at all', 'web', 'es of the', 'wait', 'anda', 'zzzz', 'xqxq', 'renew', 'ren ', 'the'") + """,
u AS (SELECT * FROM (VALUES (1, 'ation', ['waiting', 'scope']), (2, 'erer', ['limits', 'renewal']), (3, 'nothing at all', ['waiting']), (4, 'web', CAST([] AS VARCHAR[])), (5, 'es of the', ['renewal', 'waiting', 'limits'])) v(question, phrase, aspects)),
a AS (SELECT * FROM (VALUES ('waiting', 'wait'), ('waiting', 'anda'), ('limits', 'zzzz'), ('limits', 'xqxq'), ('renewal', 'renew'), ('renewal', 'ren '), ('scope', 'the')) v(aspect, phrase)),
h AS (SELECT aspect, doc_id, max(score) AS score FROM s JOIN a ON s.phrase = a.phrase GROUP BY 1, 2), r1 AS (SELECT question, doc_id, score FROM u JOIN s ON s.phrase = u.phrase QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) <= 3),
w AS (SELECT question, unnest(aspects) AS aspect FROM u), o1 AS (SELECT * FROM w WHERE (question, aspect) NOT IN (SELECT (question, aspect) FROM r1 JOIN h USING (doc_id))),
r2 AS (SELECT question, doc_id, max(score) AS score FROM o1 JOIN h USING (aspect) WHERE (question, doc_id) NOT IN (SELECT (question, doc_id) FROM r1) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY question ORDER BY max(score) DESC, doc_id) <= 3),
e AS (SELECT question, 1 AS round, doc_id, score FROM r1 UNION ALL SELECT question, 2, doc_id, score FROM r2), o2 AS (SELECT * FROM w WHERE (question, aspect) NOT IN (SELECT (question, aspect) FROM e JOIN h USING (doc_id)))"""


def rounds(t):
    asked = t.documents.sparkSession.createDataFrame(ASKED_IN_ROUNDS, "question int, phrase string, aspects array<string>")
    return phrases.evidence_rounds(indexed(t), asked, ASPECTS, 3)


@query(ROUNDS + """
SELECT question, CAST(round AS INT) AS round, doc_id, round(score, 6) AS score FROM e""")
def evidence_rounds(t):
    return rounds(t)[0].withColumn("score", F.round("score", 6))


@query(ROUNDS + """
SELECT u.question, coalesce(string_agg(aspect, ',' ORDER BY aspect), '') AS missing, CASE WHEN count(aspect) = 0 THEN 'complete' ELSE 'partial' END AS status FROM u LEFT JOIN o2 ON o2.question = u.question GROUP BY 1""")
def evidence_status(t):
    return rounds(t)[1].select("question", F.array_join("missing", ",").alias("missing"), "status")


@query("""
WITH a AS (SELECT doc_id, n_chars / 2.0 AS score FROM documents WHERE contains(text, 'ation')), b AS (SELECT doc_id, n_chars / 4.0 AS score FROM documents WHERE contains(text, 'the'))
SELECT doc_id, CAST(1 AS INT) AS round, CAST(score AS DOUBLE) AS score FROM a UNION ALL SELECT doc_id, 2, score FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def merged_searches(t):
    found = lambda word, share: t.documents.where(F.contains("text", F.lit(word))).select("doc_id", (F.col("n_chars") / share).alias("score"))
    return retrieval.merged_evidence([found("ation", 2), found("the", 4)], "doc_id").select("doc_id", "round", "score")


@query("""
SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INT) + n AS value FROM events, (SELECT unnest([0, 1]) AS n)""")
def lateral_rows(t):
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.to_json(F.struct(F.array(k, k + 1).alias("values")))
    return t.events.select("user_id", "event_id", F.explode(F.from_json(payload, "values array<int>")["values"]).alias("value"))


# --- clauses and facts ----------------------------------------------------------------------------

SECTIONED = "前言（1）基本责任 说明（二）年金 每年给付\n2、身故保险金 给付。三、可选责任 如下（4）关爱金 按约定"


@query("""
SELECT p_partkey, s.n AS section, s.name, s.scope FROM part, (VALUES (1, '基本责任', 'basic'), (2, '年金', 'basic'), (3, '身故保险金', 'basic'), (4, '可选责任', 'optional'), (5, '关爱金', 'optional')) s(n, name, scope)""")
def benefit_sections(t):
    docs = t.part.select("p_partkey", F.concat(F.lit(SECTIONED), F.col("p_name")).alias("text"))
    return clauses.benefit_sections(docs, "p_partkey", "text").select("p_partkey", "section", "name", "scope")


CHUNK_TEXTS = ["等待期为90天", "但书除外", "释义：本合同", "理赔材料", "其他内容", "上述情形", "免赔额1万元"]


@query(f"""
WITH c AS (SELECT l_orderkey AS parent_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS chunk_id, CAST(l_partkey % 7 AS INT) AS k FROM lineitem)
SELECT chunk_id, ['fact', 'clause', 'definition', 'process', 'clause', 'clause', 'fact'][k + 1] AS kind, ['waiting_period', '', '', '', '', '', 'annual_deductible'][k + 1] AS fact_keys, coalesce(CASE WHEN lead(k) OVER w IN (1, 5) THEN CAST(lead(chunk_id) OVER w AS VARCHAR) END, '') AS required FROM c WINDOW w AS (PARTITION BY parent_id ORDER BY seq)""")
def chunk_semantics(t):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    chunks = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), seq.alias("seq"), pick(CHUNK_TEXTS, F.col("l_partkey")).alias("content")).withColumn("chunk_id", F.col("parent_id") * 100 + F.col("seq"))
    done = clauses.annotate_chunks(chunks, F.lit(True))
    return done.select("chunk_id", "kind", F.array_join("fact_keys", ",").alias("fact_keys"), F.array_join(F.transform("required", lambda x: x.cast("string")), ",").alias("required"))


FACT_TEXTS = ["等待期为90天，免赔额：2万元", "给付比例80%，年度限额100万元", "计划一 50元 免赔额\n计划二 70元 免赔额", "投保年龄：60周岁；保证续保期间为6年", "没有"]


@query("""
WITH c AS (SELECT p_partkey AS chunk_id, p_size AS product_id, CAST(p_partkey % 3 AS INT) AS page, p_partkey % 4 = 0 AS tbl, CAST(p_partkey % 5 AS INT) AS k FROM part),
v(k, field, plan, value, unit) AS (VALUES (0, 'waiting_period', '', 90, 'DAY'), (0, 'annual_deductible', '', 20000, 'CNY'), (1, 'reimbursement_ratio', '', 80, 'PERCENT'), (1, 'benefit_limit', '', 1000000, 'CNY'), (2, 'annual_deductible', '计划一', 50, 'CNY'), (2, 'annual_deductible', '计划二', 70, 'CNY'), (3, 'entry_age', '', 60, 'AGE'), (3, 'renewal_period', '', 6, 'YEAR')),
f AS (SELECT c.*, field, plan, value, unit FROM c JOIN v USING (k))
SELECT product_id, page, field, plan, CAST(value AS DOUBLE) AS value, unit, chunk_id FROM f WHERE tbl OR NOT EXISTS (SELECT 1 FROM f g WHERE g.tbl AND g.product_id = f.product_id AND g.page = f.page AND g.field = f.field)""")
def extracted_facts(t):
    k = F.col("p_partkey")
    chunks = t.part.select(k.alias("chunk_id"), F.col("p_size").alias("product_id"), (k % 3).cast("int").alias("page"), F.when(k % 4 == 0, "table").otherwise("child").alias("kind"), pick(FACT_TEXTS, k).alias("content"))
    return clauses.extract_facts(chunks)


@query("""
WITH p AS (SELECT c_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS page, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS company, c_custkey FROM customer),
f AS (SELECT *, coalesce(last_value(company IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING), '') AS firm FROM p),
e AS (SELECT doc_id, firm, page, c_custkey, unnest(CASE WHEN c_custkey % 9 = 0 THEN ['P' || c_custkey % 5, 'Q'] ELSE ['P' || c_custkey % 5] END) AS product FROM f),
g AS (SELECT doc_id, firm AS company, product, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page) AS n, coalesce(string_agg(DISTINCT CASE WHEN c_custkey % 6 = 0 THEN 'C' || c_custkey % 7 END, ',' ORDER BY CASE WHEN c_custkey % 6 = 0 THEN 'C' || c_custkey % 7 END), '') AS codes, bool_or(c_custkey % 9 = 0) AS many, bool_or(c_custkey % 2 = 0) AS introduces FROM e GROUP BY 1, 2, 3)
SELECT doc_id, company, product, first_page, last_page, codes, CASE WHEN many THEN 'comparison' ELSE 'primary' END AS relation, CAST(round(least(0.98, 0.45 + CASE WHEN company <> '' THEN 0.15 ELSE 0 END + CASE WHEN codes <> '' THEN 0.2 ELSE 0 END + CASE WHEN introduces THEN 0.1 ELSE 0 END + CASE WHEN n > 1 THEN 0.05 ELSE 0 END), 2) AS DOUBLE) AS confidence FROM g""")
def product_boundaries(t):
    from pyspark.sql import Window

    k = F.col("c_custkey")
    page = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("int")
    name = F.concat(F.lit("P"), (k % 5).cast("string"))
    pages = t.customer.select(
        F.col("c_nationkey").alias("doc_id"), page.alias("page"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("company"), F.when(k % 9 == 0, F.array(name, F.lit("Q"))).otherwise(F.array(name)).alias("products"),
        F.when(k % 6 == 0, F.array(F.concat(F.lit("C"), (k % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("codes"), F.lit(False).alias("compares"), (k % 2 == 0).alias("introduces"),
    )
    return clauses.product_boundaries(pages)


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'v1' ELSE '' END AS ver, CASE WHEN o_orderkey % 5 = 0 THEN 'L' ELSE '' END AS label, CAST(o_orderkey % 11 = 0 AS INT) AS reviews FROM orders),
c AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS chunk_id, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'P' || l_linenumber % 2 END AS product_id, CASE WHEN l_partkey % 7 <> 0 THEN 'v1' ELSE 'v2' END AS ver, l_linenumber AS lo, l_linenumber + 1 AS hi FROM lineitem),
k AS (SELECT o_orderkey AS doc_id, 'P' || n AS product_id, n * 3 AS lo, n * 3 + 2 AS hi FROM orders, (SELECT unnest([0, 1]) AS n)),
m AS (SELECT c.doc_id, c.chunk_id, c.product_id, c.ver, count(k.product_id) AS fits, max(k.product_id) AS p FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.hi >= k.lo AND c.lo <= k.hi WHERE c.product_id <> '' GROUP BY ALL),
g AS (SELECT m.doc_id, count(*) AS publishable, count(*) FILTER (NOT coalesce(fits = 1 AND p = product_id, false)) AS amb, count(*) FILTER (d.ver <> '' AND m.ver <> d.ver) AS unv FROM m JOIN d ON m.doc_id = d.doc_id GROUP BY 1), i AS (SELECT doc_id, count(*) AS isolated FROM c WHERE product_id = '' GROUP BY 1),
r AS (SELECT d.doc_id, coalesce(publishable, 0) AS publishable, coalesce(isolated, 0) AS isolated, concat_ws(',', CASE WHEN coalesce(publishable, 0) = 0 THEN 'product_binding_missing' END, CASE WHEN amb > 0 THEN 'product_boundary_ambiguous' END, CASE WHEN label <> '' AND ver = '' THEN 'product_version_resolution_missing' END, CASE WHEN unv > 0 THEN 'product_version_binding_missing' END, CASE WHEN reviews > 0 THEN 'page_correction_unconfirmed' END) AS blocking FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN i ON d.doc_id = i.doc_id)
SELECT doc_id, CASE WHEN blocking = '' THEN 'pass' ELSE 'blocked' END AS decision, blocking, publishable, isolated FROM r""")
def publish_readiness(t):
    k = F.col("o_orderkey")
    docs = t.orders.select(k.alias("doc_id"), F.when(k % 3 == 0, "v1").otherwise("").alias("version_id"), F.when(k % 5 == 0, "L").otherwise("").alias("version_label"), (k % 11 == 0).cast("int").alias("open_reviews"))
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("chunk_id"), F.when(F.col("l_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("P"), (F.col("l_linenumber") % 2).cast("string"))).alias("product_id"),
        F.when(F.col("l_partkey") % 7 != 0, "v1").otherwise("v2").alias("version_id"), F.col("l_linenumber").alias("first_page"), (F.col("l_linenumber") + 1).alias("last_page"),
    )
    links = t.orders.select(k.alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select("doc_id", F.concat(F.lit("P"), F.col("n").cast("string")).alias("product_id"), (F.col("n") * 3).alias("first_page"), (F.col("n") * 3 + 2).alias("last_page"))
    return clauses.publish_readiness(docs, chunks, links)


BENEFITS = ["身故保险金按已交保险费的120%给付；若被保险人身故，我们给付3万元", "年金按基本保险金额10%给付。其他", "无"]


@query("""
WITH v(k, sentence, liability, basis, value, unit, condition) AS (VALUES (0, 0, '身故保险金', 'total_paid_premium', 120, '%', ''), (0, 1, '条款', 'fixed', 3, '万元', '若被保险人身故'), (1, 0, '年金', 'basic_amount', 10, '%', ''))
SELECT p_partkey, CAST(sentence AS INT) AS sentence, liability, basis, CAST(value AS DOUBLE) AS value, unit, condition FROM part JOIN v ON k = p_partkey % 3""")
def clause_indicators(t):
    rows = t.part.select("p_partkey", F.lit("条款").alias("name"), pick(BENEFITS, F.col("p_partkey")).alias("content"))
    return clauses.indicators_from_clauses(rows, "p_partkey", "name", "content")


@query("""
WITH i AS (SELECT l_partkey AS product, l_orderkey * 10 + l_linenumber AS seq, 'T' || CAST(l_suppkey % 6 AS VARCHAR) AS title FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT p_partkey AS product, n AS ordinal, CASE WHEN n % 2 = 0 THEN 'X' ELSE '' END || 'T' || CAST(n % 4 AS VARCHAR) AS title, 'text' || n AS text FROM part, (SELECT unnest([0, 1, 2, 3, 4]) AS n)),
d AS (SELECT DISTINCT product, seq, title FROM i), m AS (SELECT d.product, d.seq, d.title AS t, r.ordinal, r.title, r.text, row_number() OVER (PARTITION BY d.product, d.seq, d.title ORDER BY r.ordinal) AS k FROM d LEFT JOIN r ON d.product = r.product AND ends_with(r.title, d.title)),
c AS (SELECT product, coalesce(title, t) AS title, coalesce(arg_min(text, coalesce(ordinal, 1 << 30)), '') AS text, count(*) AS indicators FROM m WHERE k = 1 GROUP BY 1, 2), o AS (SELECT product, title, arg_min(text, ordinal) AS text FROM r GROUP BY 1, 2)
SELECT product, title, text, indicators FROM c UNION ALL SELECT product, title, text, 0 FROM o WHERE (product, title) NOT IN (SELECT (product, title) FROM c)""")
def responsibility_cards(t):
    i = t.lineitem.select(F.col("l_partkey").alias("product"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.concat(F.lit("T"), (F.col("l_suppkey") % 6).cast("string")).alias("title"), (F.col("l_returnflag") != "R").alias("shown"))
    i = i.where("shown").distinct().withColumn("seq", F.concat_ws(":", F.col("n").cast("string"), "title")).drop("n")
    n = F.explode(F.array(*[F.lit(x) for x in range(5)]))
    r = t.part.select(F.col("p_partkey").alias("product"), n.alias("ordinal")).select("product", "ordinal", F.concat(F.when(F.col("ordinal") % 2 == 0, "X").otherwise(""), F.lit("T"), (F.col("ordinal") % 4).cast("string")).alias("title"), F.concat(F.lit("text"), F.col("ordinal").cast("string")).alias("text"))
    return clauses.cards(i, r)


@query("""
WITH r AS (SELECT p_partkey AS product, 'O' || n AS option, CASE WHEN (p_partkey + n) % 3 = 0 THEN NULL ELSE (p_partkey + n) % 3 = 1 END AS chosen, n = 1 AS quantified FROM part, (SELECT unnest([0, 1, 2]) AS n)), f AS (SELECT l_partkey AS product, 'O' || (l_linenumber % 5) AS option, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS value FROM lineitem GROUP BY 1, 2)
SELECT coalesce(r.product, f.product) AS product, coalesce(r.option, f.option) AS option, CASE WHEN chosen THEN 'selected' WHEN chosen IS NULL THEN 'unknown' ELSE 'not_selected' END AS state, CASE WHEN f.product IS NOT NULL THEN value IS NOT NULL ELSE coalesce(quantified, false) END AS quantified FROM r FULL JOIN f ON r.product = f.product AND r.option = f.option WHERE f.product IS NOT NULL OR chosen""")
def rebuilt_options(t):
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    r = t.part.select(F.col("p_partkey").alias("product"), n.alias("n"))
    k = (F.col("product") + F.col("n")) % 3
    r = r.select("product", F.concat(F.lit("O"), F.col("n").cast("string")).alias("option"), F.when(k == 0, F.lit(None)).otherwise(k == 1).alias("chosen"), (F.col("n") == 1).alias("quantified"))
    f = t.lineitem.select(F.col("l_partkey").alias("product"), F.concat(F.lit("O"), (F.col("l_linenumber") % 5).cast("string")).alias("option"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("value"))
    return clauses.rebuilt_options(r, f)


@query("""
WITH r AS (SELECT p_size AS plan, p_partkey AS "row", p_name AS title, p_partkey % 13 = 0 AS failed FROM part), s AS (SELECT DISTINCT p_size AS plan, p_name AS title, min(p_partkey) OVER (PARTITION BY p_size, p_name) AS source FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT r."row", s.source, row_number() OVER (PARTITION BY r."row" ORDER BY len(list_intersect(list_distinct(string_split(lower(r.title), ' ')), list_distinct(string_split(lower(s.title), ' ')))) DESC, s.source) AS k FROM r JOIN s ON r.plan = s.plan AND NOT failed WHERE list_has_any(string_split(lower(r.title), ' '), string_split(lower(s.title), ' ')))
SELECT plan, r."row", CASE WHEN failed THEN 'note' ELSE title END AS title, coalesce(CAST(m.source AS VARCHAR), '') AS source FROM r LEFT JOIN m ON r."row" = m."row" AND k = 1""")
def merged_analyses(t):
    rows = t.part.select(F.col("p_size").alias("plan"), F.col("p_partkey").alias("row"), F.col("p_name").alias("title"), (F.col("p_partkey") % 13 == 0).alias("failed"))
    sources = t.part.where("p_partkey % 3 = 0").groupBy(F.col("p_size").alias("plan"), F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("source"))
    return clauses.merged_analyses(rows, sources)


@query("""
WITH i AS (SELECT p_partkey, p_type AS lane, CASE WHEN p_size > 5 THEN p_size END AS value, CASE WHEN p_retailprice > 950 THEN 'x' ELSE ' ' END AS source FROM part WHERE p_partkey % 4 <> 0)
SELECT lane, issue, count(*) AS n FROM (SELECT lane, 'missing_value' AS issue FROM i WHERE value IS NULL UNION ALL SELECT lane, 'missing_source' FROM i WHERE trim(source) = '' UNION ALL SELECT p_type, 'new_candidate' FROM part WHERE p_partkey % 4 = 0) GROUP BY 1, 2""")
def quality_lanes(t):
    i = t.part.where("p_partkey % 4 <> 0").select("p_partkey", F.col("p_type").alias("lane"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("value"), F.when(F.col("p_retailprice") > 950, "x").otherwise(" ").alias("source"))
    return clauses.governance(i, t.part.select("p_partkey", F.col("p_type").alias("lane")), ["p_partkey"])


# --- layouts --------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_orderkey AS policy_id, ['name', 'amount', 'date'][CAST(l_partkey % 3 + 1 AS INT)] AS field, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS engine, CASE l_partkey % 3 WHEN 0 THEN repeat('n', CAST(l_quantity AS INT) % 9) ELSE '¥' || CAST(l_quantity AS INT) END AS value, l_discount AS score FROM lineitem),
w AS (SELECT *, CASE field WHEN 'name' THEN length(value) WHEN 'amount' THEN CAST(substr(value, 2) AS DOUBLE) ELSE score END AS w FROM c WHERE value <> '')
SELECT policy_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, field ORDER BY w DESC, score DESC, engine) AS k FROM w) WHERE k = 1""")
def best_candidates(t):
    q = F.col("l_quantity").cast("int")
    value = F.when(F.col("l_partkey") % 3 == 0, F.repeat(F.lit("n"), q % 9)).otherwise(F.concat(F.lit("¥"), q.cast("string")))
    rows = t.lineitem.select(F.col("l_orderkey").alias("policy_id"), pick(["name", "amount", "date"], F.col("l_partkey")).alias("field"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("engine"), value.alias("value"), F.col("l_discount").alias("score"))
    return clauses.best_candidates(rows, {"name": "longest", "amount": "largest"})


@query("""
WITH a AS (SELECT p_partkey, p_name AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.v IS NULL THEN 'lost' WHEN a.v IS NULL THEN 'added' ELSE 'changed' END AS issue FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.v IS DISTINCT FROM b.v""")
def replay_audit(t):
    stored = t.part.where("p_partkey % 5 <> 0").select("p_partkey", F.col("p_name").alias("value"))
    again = t.part.where("p_partkey % 7 <> 0").select("p_partkey", F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.col("p_name")).alias("value"))
    return clauses.replay(stored, again, ["p_partkey"])


@query("""
SELECT c_custkey, 'insured' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'amount', CAST(c_nationkey AS VARCHAR) || '万' FROM customer WHERE c_custkey % 2 = 0""")
def field_values(t):
    text = F.concat(F.lit("投保人：甲 被保险人姓名: "), F.col("c_name"), F.lit("，备注\n被保险人：乙\n"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("基本保险金额："), F.col("c_nationkey").cast("string"), F.lit("万 元"))).otherwise("无"))
    lines = t.customer.select("c_custkey", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return clauses.field_values(lines, "c_custkey", "line", {"insured": ["被保险人", "被保险人姓名"], "amount": ["保险金额", "基本保险金额"]})


@query("""
WITH b AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS box_id, l_partkey % 4 = 0 AS is_label, CASE WHEN l_partkey % 8 = 0 THEN 'amount' ELSE 'name' END AS field, 'v' || l_suppkey AS text, l_quantity AS x, CAST(l_linenumber * 5 AS DOUBLE) AS y FROM lineitem),
m AS (SELECT l.page, l.field, v.text, v.box_id, v.x - l.x AS dx, v.y - l.y AS dy FROM b v JOIN b l ON v.page = l.page AND l.is_label AND NOT v.is_label),
r AS (SELECT *, abs(dy) <= 5 AND dx > 0 AND dx <= 20 AS rgt FROM m), s AS (SELECT * FROM r WHERE rgt OR (abs(dx) <= 5 AND dy > 0 AND dy <= 20))
SELECT page, field, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY page, field ORDER BY (NOT rgt)::INT, CASE WHEN rgt THEN dx ELSE dy END, box_id) AS k FROM s) WHERE k = 1""")
def layout_fields(t):
    k = F.col("l_partkey")
    text = F.when(k % 8 == 0, "保险金额：").when(k % 4 == 0, "姓 名").otherwise(F.concat(F.lit("v"), F.col("l_suppkey").cast("string")))
    boxes = t.lineitem.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1_000_000 + k * 100 + F.col("l_suppkey") % 100).alias("box_id"), text.alias("text"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 5).cast("double").alias("y"))
    return clauses.beside_labels(boxes, "page", {"保险金额": "amount", "姓名": "name"}, 20.0)


@query("""
SELECT o_orderkey AS page, CAST(y AS INT) AS policy_year, CAST(o_totalprice + y AS DOUBLE) AS value FROM orders, (SELECT unnest([1, 2, 3, 11, 12, 13]) AS y)""")
def cash_value_tables(t):
    cell = lambda row, x, number, kind=None, grp=None: F.struct(F.lit(row).alias("row"), F.lit(float(x)).alias("x"), number.cast("double").alias("number"), F.lit(kind).alias("kind"), F.lit(grp).alias("grp"))
    none = F.lit(None)
    headers = [cell(0, x, none, kind, grp) for x, kind, grp in ((10, "year", 0), (60, "value", 0), (110, "year", 1), (160, "value", 1))]
    price = F.col("o_totalprice")
    body = [c for r in (1, 2, 3) for c in (cell(r, 12, F.lit(r)), cell(r, 57, price + r), cell(r, 113, F.lit(10 + r)), cell(r, 158, price + 10 + r), cell(r, 170, F.lit(-1.0)))]
    # a year given twice: the later row does not count
    again = [cell(4, 10, F.lit(1)), cell(4, 60, F.lit(-5.0))]
    cells = t.orders.select(F.col("o_orderkey").alias("page"), F.inline(F.array(*headers, *body, *again)))
    return clauses.column_groups(cells)


@query("""
SELECT page_id, CAST(n AS INT) AS row_no, CAST(m AS INT) AS col_no, CASE WHEN n = 0 AND m < 2 THEN 'head' WHEN n = 0 THEN 'p' || page_id WHEN m = 0 THEN 'side' WHEN n = 1 THEN 'a' || m ELSE 'b&' || m END AS cell FROM pages, (SELECT unnest([0, 1, 2]) AS n), (SELECT unnest([0, 1, 2]) AS m)""")
def html_table_grid(t):
    table = F.concat(F.lit("<p>x</p><table class='t'><tr><th colspan=\"2\">head</th><td> <b>p"), F.col("page_id").cast("string"), F.lit("</b></td></tr><tr><td rowspan='2'>side</td><td>a1</td><td>a2</td></tr>\n<tr><td>b&amp;1</td><td>b&amp;2</td></tr></table>"))
    return documents.table_grid(t.pages.select("page_id", table.alias("html")), "page_id", "html").where("table_no = 0").select("page_id", "row_no", "col_no", "cell")


@query("""
SELECT page_id, 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || '/The' AS url FROM pages WHERE contains(html, '<a href="/The">')""")
def absolute_links(t):
    links = documents.absolute_links(t.pages.withColumn("url", F.regexp_replace("url", "^https", "http")), "page_id", "html", "url")
    return links.where(F.col("label") == "The").select("page_id", "url").distinct()


@query("SELECT page_id, sha256(encode(html)) AS hash, octet_length(encode(html)) AS size FROM pages WHERE page_id % 2 = 0")
def blobs(t):
    stored = documents.blob_store(t.pages, "page_id", F.encode("html", "UTF-8"))
    wanted = t.pages.where("page_id % 2 = 0").select("page_id")
    return stored.join(wanted, "page_id", "left_semi").select("page_id", "hash", F.col("size").cast("bigint"))


@query("""
WITH t AS (SELECT name, n, bits FROM (SELECT 'part' AS name, count(*) AS n, 0 AS bits FROM part UNION ALL SELECT 'nation', count(*), 0 FROM nation)) SELECT name, n FROM t""")
def manifest_counts(t):
    from larkspur.sources import io

    return io.manifest({n: getattr(t, n) for n in ("part", "nation")}).select(F.col("name"), F.col("n"))
