"""Decisions by rule: confidence, quality gates, versions, reconciling plans, corrections, evaluation, headings, topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import all_labels
from larkspur.operators.relations import best_per_key, valid_at

#: Least confidence of a critical fact and of any evidence.
LEAST_CRITICAL, LEAST_EVIDENCE = 0.85, 0.7


def evidence_decision(rows: DataFrame, keys: list[str], critical: Column, native: Column) -> DataFrame:
    """keys, minimum, weighted, critical_minimum, missing, decision of evidence (content, confidence): blocked, review_required or pass.

    The mean is weighted by the characters of a piece; pieces without content do not count, those without confidence are
    missing, which asks for review unless the text is native.
    """
    filled = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumns({"_critical": critical, "_native": native})
    c, w = F.col("confidence"), F.length("content")
    least_critical = F.min(F.when(F.col("_critical"), c))
    out = filled.groupBy(*keys).agg(
        F.min(c).alias("minimum"), (F.sum(c * w) / F.sum(F.when(c.isNotNull(), w))).alias("weighted"), least_critical.alias("critical_minimum"), F.count_if(c.isNull()).alias("missing"), F.min("_native").alias("_native")
    )
    review = (F.col("minimum") < LEAST_EVIDENCE) | ((F.col("missing") > 0) & ~F.col("_native"))
    decision = F.when(F.col("critical_minimum") < LEAST_CRITICAL, "blocked").when(review, "review_required").otherwise("pass")
    return out.withColumn("decision", decision).drop("_native")


def chunk_gate(chunks: DataFrame) -> DataFrame:
    """chunk_id, checks (joined), decision of chunks: blocked, review_required or pass.

    chunks: doc_id, chunk_id, kind (parent, table, child), content, first_page, last_page, tokens, confidence, hash. Of
    equal content in a document the first chunk stays.
    """
    content, child = F.trim(F.coalesce("content", F.lit(""))), F.col("kind") != "parent"
    first = F.min(F.when(child, F.col("chunk_id"))).over(Window.partitionBy("doc_id", "hash"))
    marked = chunks.withColumn("_first", first)
    blocked = F.array_compact(F.array(
        F.when(content == "", "empty_content"),
        F.when((F.coalesce("first_page", F.lit(0)) == 0) | (F.coalesce("last_page", F.lit(0)) == 0), "missing_page_reference"),
        F.when((F.col("kind") == "table") & ~content.rlike(r"\p{L}"), "isolated_table_values"),
        F.when(child & (F.col("hash") != "") & (F.col("chunk_id") != F.col("_first")), "duplicate_content"),
    ))
    warned = F.array_compact(F.array(F.when(child & (F.col("tokens") < 4), "very_short_content"), F.when(F.col("confidence") < 0.7, "low_ocr_confidence")))
    decision = F.when(F.size("_b") > 0, "blocked").when(F.size("_w") > 0, "review_required").otherwise("pass")
    return marked.withColumns({"_b": blocked, "_w": warned}).select("chunk_id", F.array_join(F.concat("_b", "_w"), ",").alias("checks"), decision.alias("decision"))


def resolve_versions(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """ask_id, version_id, status (exact, ambiguous, none) of products at a day, with an equal label where one is asked.

    asked: ask_id, product, label, day; versions: version_id, product, label, first, last (null: open).
    """
    v = versions.select("product", "version_id", F.col("label").alias("_l"), "first", "last")
    met = asked.join(v, "product", "left")
    fits = F.col("version_id").isNotNull() & ((F.coalesce("label", F.lit("")) == "") | (F.col("label") == F.col("_l"))) & (F.col("day").isNull() | valid_at(F.col("first"), F.col("last"), F.col("day")))
    counted = met.groupBy("ask_id").agg(F.count_if(fits).alias("n"), F.min(F.when(fits, F.col("version_id"))).alias("v"))
    return counted.select("ask_id", F.when(F.col("n") == 1, F.col("v")).alias("version_id"), F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("status"))


def reconcile_plan(local: DataFrame, remote: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
    """action, key, record, target: what makes a remote table equal the local one.

    local: key, company, columns; remote: key, record, target, columns; known: company, target. Remote rows without a local
    one and repeats of a key are deleted, others updated if a column differs; local rows that are missing are created in
    the target where most rows of their company are, else in the known one, else they have none.
    """
    hashed = lambda df: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    a = local.select("key", "company", hashed(local).alias("_a"))
    ranked = remote.select("key", "record", "target", hashed(remote).alias("_b"), F.row_number().over(Window.partitionBy("key").orderBy("record")).alias("_k"))
    met = ranked.join(a, "key", "left")
    action = F.when(F.col("_a").isNull(), "delete").when(F.col("_k") > 1, "delete_repeat").when(F.col("_a") != F.col("_b"), "update").otherwise("keep")
    done = met.withColumn("action", action)
    votes = done.where("company IS NOT NULL AND _k = 1").groupBy("company", "target").agg(F.count(F.lit(1)).alias("n"))
    voted = best_per_key(votes, ["company"], [F.desc("n"), F.col("target")]).select("company", F.col("target").alias("_voted"))
    missing = a.join(remote.select("key"), "key", "left_anti").join(voted, "company", "left").join(known.select("company", F.col("target").alias("_known")), "company", "left")
    target = F.coalesce("_voted", "_known")
    created = missing.select(F.when(target.isNull(), "no_target").otherwise("create").alias("action"), "key", F.lit(None).cast(remote.schema["record"].dataType).alias("record"), target.alias("target"))
    return done.where("action <> 'keep'").select("action", "key", "record", "target").unionByName(created)


def corrected_parts(parts: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, amount, excluded: parts after the latest correction of their keys: replaced, left out, or as they were.

    parts: keys, amount; corrections: keys, action (replace_amount, exclude_amount, mark_unquantifiable), value, at, id.
    """
    known = corrections.where(F.col("action").isin("replace_amount", "exclude_amount", "mark_unquantifiable"))
    last = best_per_key(known, keys, [F.desc("at"), F.desc("id")]).select(*keys, "action", F.greatest(F.regexp_replace("value", ",", "").try_cast("double"), F.lit(0.0)).alias("_v"))
    sums = parts.groupBy(*keys).agg(F.sum("amount").alias("_sum"))
    both = sums.join(last, keys, "full_outer")
    replaced = (F.col("action") == "replace_amount") & (F.col("_v") > 0)
    amount = F.when(F.col("action").isNull(), F.col("_sum")).when(replaced, F.col("_v")).otherwise(0.0)
    return both.select(*keys, amount.alias("amount"), (F.col("action").isNotNull() & ~F.coalesce(replaced, F.lit(False))).alias("excluded"))


def evaluate_cases(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, required, hits, forbidden, wrong_version, evidence, cited, passed of retrieval cases.

    cases: case_id, required, forbidden (arrays of chunk ids), version; evidence: case_id, chunk_id, version, cited.
    """
    e = evidence.groupBy("case_id").agg(F.collect_set("chunk_id").alias("_ids"), F.count(F.lit(1)).alias("evidence"), F.count_if("cited").alias("cited"))
    wrong = evidence.join(cases.select("case_id", F.col("version").alias("_v")), "case_id").groupBy("case_id").agg(F.count_if((F.col("_v") != "") & ~F.col("version").eqNullSafe(F.col("_v"))).alias("wrong_version"))
    joined = cases.join(e, "case_id", "left").join(wrong, "case_id", "left").fillna(0, ["evidence", "cited", "wrong_version"])
    ids = F.coalesce("_ids", F.array().cast(cases.schema["required"].dataType))
    required = F.array_distinct("required")
    measured = joined.select("case_id", F.size(required).alias("required"), F.size(F.array_intersect(required, ids)).alias("hits"), F.size(F.array_intersect("forbidden", ids)).alias("forbidden"), "wrong_version", "evidence", "cited")
    return measured.withColumn("passed", (F.col("hits") == F.col("required")) & (F.col("forbidden") == 0) & (F.col("wrong_version") == 0) & (F.col("cited") == F.col("evidence")))


def table_scores(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, valid, confidence of tables read from scans (policy_year, value, age, confidence by row): three rows at least."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = rows.withColumns({"_y": F.lag("policy_year").over(w), "_a": F.lag("age").over(w)})
    near = (F.col("value") == F.floor("value")) & F.col("value").between(1, 150) & (F.abs(F.col("value") - F.col("policy_year")) <= 1)
    out = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("policy_year") >= F.col("_y")).alias("up"), F.count_if(near).alias("near"), F.count_if(F.col("age") < F.col("_a")).alias("down"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.8)).alias("read")
    )
    ordered = F.col("up") >= 0.5 * (F.col("n") - 1)
    score = lambda c, yes, no: F.when(c, yes).otherwise(no)
    reason = score(ordered, 0.5, 0.0) + score(F.col("down") == 0, 0.3, 0.0) + score(F.col("n") >= 5, 0.2, 0.1)
    confidence = F.when(F.col("n") < 3, 0.0).otherwise(F.floor((F.col("read") * 0.4 + score(ordered, 1.0, 0.3) * 0.3 + reason * 0.3) * 100 + 0.5) / 100)
    valid = (F.col("n") >= 3) & ordered & ~((F.col("n") >= 5) & (F.col("near") >= 0.5 * F.col("n"))) & (confidence >= 0.7)
    return out.select(key, valid.alias("valid"), confidence.alias("confidence"))


#: Topics of material by the words that tell them, and what tells the audience of a product.
TOPICS = [
    ("product_overview", "产品(?:定位|介绍|信息|概览)|产品名称|险种代码"),
    ("target_audience", "适(?:用|合)(?:人群|客户|对象)|目标客户|客户画像|哪些人|谁适合"),
    ("product_advantage", "产品(?:特色|优势|亮点|卖点)|核心优势|差异化|健告宽松|高龄可投|次标可保"),
    ("underwriting", "投保(?:年龄|规则|条件|范围)|健康告知|健告|职业类别|等待期|续保|保证续保|最高续保年龄"),
    ("coverage", "保险责任|保障责任|保障范围|保险金|医疗费用|给付|报销|外购药械|康护费用"),
    ("exclusions", "责任免除|除外责任|不承担|不予给付|免责"),
    ("plan_pricing", "保障计划|计划[一二三1-3]|保险金额|保额|免赔额|费率|保费|价格"),
    ("health_services", "健康管理|健康服务|问诊|护工|绿通|就医服务|服务项目|服务次数|咨询服务"),
    ("claims", "理赔|赔付流程|申请材料|保险金申请|索赔"),
]
AUDIENCE = "(?:产品|本产品).{0,8}适用人群|目标客户|客户画像|适合(?:人群|客户|对象)|谁适合"


def chunk_topics(text: Column, is_table: Column) -> Column:
    """Topics of a text; the audience of a health service is none of the product's, unless the text says so."""
    topics = all_labels(text, [(p, t) for t, p in TOPICS])
    service = F.array_contains(topics, "health_services")
    return F.when(service & (is_table | ~text.rlike(AUDIENCE)), F.array_remove(topics, "target_audience")).otherwise(topics)


#: Patterns of headings by level.
HEADINGS = [(1, r"^第[一二三四五六七八九十百零〇0-9]+条(?:\s+|$)"), (2, r"^[一二三四五六七八九十百]+[、.．](?!.*[。；;]$)"), (3, r"^[（(][一二三四五六七八九十百零〇0-9]+[）)](?!.*[。；;]$)")]


def heading_paths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, line, level (0: no heading), path: lines with the headings that they stand under, outermost first.

    The last heading of each level is carried on, and what a higher one ends is left out, so no stack is needed: a
    heading holds if none of its level or above comes after it.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw")).select(key, "at", F.trim("raw").alias("line"))
    level = reduce(lambda a, x: a.when(F.col("line").rlike(x[1]), x[0]), HEADINGS[1:], F.when(F.col("line").rlike(HEADINGS[0][1]), HEADINGS[0][0])).otherwise(0)
    told = lines.withColumn("level", level)
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("at", "line")), True).over(w) for k, _ in HEADINGS}
    carried = told.withColumns({f"_h{k}": c for k, c in last.items()})
    at = lambda k: F.coalesce(F.col(f"_h{k}")["at"], F.lit(-1))
    holds = [F.when((at(k) >= 0) & reduce(lambda a, j: a & (at(k) > at(j)), range(1, k), F.lit(True)), F.col(f"_h{k}")["line"]) for k, _ in HEADINGS]
    return carried.select(key, "at", "line", "level", F.array_join(F.array_compact(F.array(*holds)), " / ").alias("path"))


def data_loss(current: DataFrame, incoming: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """lost, sample: how many keys an incoming table lacks, and the first n of them."""
    lost = current.select(F.concat_ws("|", *keys).alias("k")).distinct().join(incoming.select(F.concat_ws("|", *keys).alias("k")).distinct(), "k", "left_anti")
    first = lost.orderBy("k").limit(n).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("sample"))  # n rows
    return lost.agg(F.count(F.lit(1)).alias("lost")).join(first)
