"""Clauses, facts, products and cards told by texts: rule sets over Column expressions, joined and grouped by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import all_labels, first_label
from larkspur.operators.relations import best_per_key
from larkspur.sources.shared import written

#: Marks that begin a numbered section, and words that name its scope.
SECTION_MARK = r"[（(]\s*(?:\d+|[一二三四五六七八九十]+)\s*[）)]|(?:^|\n)\s*\d+(?:、|\.(?=\s+(?!\d)))|(?:^|[\n\r:：。；;])\s*[一二三四五六七八九十]+[、.]"
KNOWN_TITLES = "养老年金|年金|生存保险金|生存金|祝寿金|祝贺金|满期生存保险金|满期保险金|满期金|教育金|关爱金|婚嫁金|身故保险金|全残保险金"


def benefit_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, name, content, scope of the numbered sections of a text; a scope holds until the next one is named."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SECTION_MARK)
    rows = docs.select(key, F.posexplode(parts).alias("section", "content")).where("section > 0").withColumn("content", F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")))
    tight = F.regexp_replace("content", r"\s+", "")
    named = F.when(tight.rlike("^基本责任"), "basic").when(tight.rlike("^(?:可选责任|可选择责任)"), "optional")
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    known, word = F.regexp_extract("content", f"^({KNOWN_TITLES})", 1), F.regexp_extract("content", r"^(.+?)\s", 1)
    name = F.when(known != "", known).when(word != "", word).otherwise(F.substring("content", 1, 10))
    return rows.select(key, "section", name.alias("name"), "content", F.coalesce(F.last(named, True).over(w), F.lit("basic")).alias("scope"))


# --- chunks ---------------------------------------------------------------------------------------

#: Fields that a chunk can state, words that tell kinds of evidence, and what asks for the chunk before.
FACT_WORDS = [("等待期", "waiting_period"), ("免赔额", "annual_deductible"), ("(?:赔付|给付|报销)比例|%", "reimbursement_ratio"), ("限额|最高", "benefit_limit"), ("投保年龄|最高可投保至", "entry_age"), ("续保", "renewal_period")]
EVIDENCE_WORDS = [("释义|定义", "definition"), ("理赔|保险金申请|申请材料|服务流程|报案", "process"), (r"计算公式|给付金额\s*=|赔付金额\s*=|×|\*", "formula")]
NEEDS_BEFORE = "^(?:前款|上述|除外|但|其中|注[:：])"


def annotate_chunks(chunks: DataFrame, contractual: Column) -> DataFrame:
    """Adds kind, fact_keys and required (ids of chunks that are needed to read this one) to chunks.

    chunks: chunk_id, parent_id, seq, content. A chunk needs the next one of its parent where that only goes on with it.
    """
    facts = all_labels(F.col("content"), FACT_WORDS)
    kind = F.coalesce(first_label(F.col("content"), EVIDENCE_WORDS), F.when(F.size(facts) > 0, "fact"), F.when(contractual, "clause"), F.lit("other"))
    w = Window.partitionBy("parent_id").orderBy("seq")
    needs = F.when(F.trim(F.lead("content").over(w)).rlike(NEEDS_BEFORE), F.array(F.lead("chunk_id").over(w)))
    return chunks.withColumns({"kind": kind, "fact_keys": facts, "required": F.coalesce(needs, F.array().cast("array<bigint>"))})


#: The words and units by which each field's value is told.
FACT_RULES = {
    "waiting_period": (r"等待期(?:为|是|：|:)?", "日|天|个月|月|年"),
    "annual_deductible": (r"(?:年度)?免赔额(?:为|是|：|:)?", "万元|元"),
    "reimbursement_ratio": (r"(?:赔付|给付|报销)比例(?:为|是|：|:)?|按", "%"),
    "benefit_limit": (r"(?:年度|累计|给付|责任)?限额(?:为|是|：|:)?|最高(?:给付|报销)?", "万元|元"),
    "entry_age": (r"(?:最高|最低)?投保年龄(?:为|是|：|:)?|最高可投保至", "周岁|岁"),
    "renewal_period": (r"保证续保(?:期间)?(?:为|是|：|:)?|续保期间(?:为|是|：|:)?", "年"),
}
UNIT_NAMES = {"万元": "CNY", "元": "CNY", "%": "PERCENT", "日": "DAY", "天": "DAY", "个月": "MONTH", "月": "MONTH", "年": "YEAR", "周岁": "AGE", "岁": "AGE"}
BY_PLAN = ("annual_deductible", "reimbursement_ratio", "benefit_limit")


def extract_facts(chunks: DataFrame) -> DataFrame:
    """product_id, page, field, plan, value, unit, chunk_id of the values that chunks state.

    chunks: chunk_id, product_id, page, kind (table, child), content. Where a chunk gives a value for each plan, those
    count instead of the first value. A field that a table states on a page is not read from other chunks of the page.
    """
    one = "array<struct<plan:string,number:string,unit:string>>"

    def stated(field: str, words: str, units: str) -> Column:
        pattern = rf"(?:{words})[^\d]{{0,20}}(\d+(?:\.\d+)?)\s*({units})"
        first = F.struct(F.lit("").alias("plan"), F.regexp_extract("content", pattern, 1).alias("number"), F.regexp_extract("content", pattern, 2).alias("unit"))
        values = F.filter(F.array(first), lambda x: x["number"] != "")
        if field in BY_PLAN:
            each = rf"(计划(?:[一二三四五六七八九十]|[A-Z]|\d+))[^\d]{{0,16}}(\d+(?:\.\d+)?)\s*({units})"
            lines = F.filter(F.split("content", "\n"), lambda x: x.rlike(words))
            text = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.col("content"))
            whole = F.regexp_extract_all(text, F.lit(each), 0)
            plans = F.transform(whole, lambda x: F.struct(F.regexp_extract(x, each, 1).alias("plan"), F.regexp_extract(x, each, 2).alias("number"), F.regexp_extract(x, each, 3).alias("unit")))
            values = F.when(F.col("content").rlike(words) & (F.size(plans) > 0), plans).otherwise(values)
        return F.transform(values.cast(one), lambda x: F.struct(F.lit(field).alias("field"), x["plan"].alias("plan"), x["number"].alias("number"), x["unit"].alias("unit")))

    found = F.concat(*[stated(field, *rule) for field, rule in FACT_RULES.items()])
    rows = chunks.select("chunk_id", "product_id", "page", "kind", F.explode(found).alias("f")).select("chunk_id", "product_id", "page", "kind", "f.*")
    tables = rows.where("kind = 'table'").select("product_id", "page", "field").distinct()
    kept = rows.where("kind = 'table'").unionByName(rows.where("kind <> 'table'").join(tables, ["product_id", "page", "field"], "left_anti"))
    names = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])
    value = F.col("number").cast("double") * F.when(F.col("unit") == "万元", 10_000).otherwise(1)
    return kept.select("product_id", "page", "field", "plan", value.alias("value"), F.try_element_at(names, F.col("unit")).alias("unit"), "chunk_id").distinct()


# --- products -------------------------------------------------------------------------------------


def product_boundaries(pages: DataFrame) -> DataFrame:
    """doc_id, company, product, first_page, last_page, codes, relation, confidence of the products that pages name.

    pages: doc_id, page, company (null where a page names none), products and codes (arrays), compares, introduces. A page
    without a company belongs to the one named last. Each sign adds to the confidence, 0.98 at most.
    """
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    carried = pages.withColumn("company", F.coalesce(F.last(F.nullif(F.trim("company"), F.lit("")), True).over(w), F.lit("")))
    each = carried.withColumn("many", (F.size("products") > 1) | F.col("compares")).withColumn("product", F.explode("products"))
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes"))))
    found = each.groupBy("doc_id", "company", "product").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count_distinct("page").alias("n"), codes.alias("codes"), F.max("many").alias("many"), F.max("introduces").alias("introduces"))
    sign = lambda c, worth: F.when(c, worth).otherwise(0.0)
    confidence = F.least(F.lit(0.98), 0.45 + sign(F.col("company") != "", 0.15) + sign(F.size("codes") > 0, 0.2) + sign(F.col("introduces"), 0.1) + sign(F.col("n") > 1, 0.05))
    return found.select("doc_id", "company", "product", "first_page", "last_page", F.array_join("codes", ",").alias("codes"), F.when(F.col("many"), "comparison").otherwise("primary").alias("relation"), F.round(confidence, 2).alias("confidence"))


def publish_readiness(documents: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, decision, blocking (joined reasons), publishable, isolated of each document.

    documents: doc_id, version_id, version_label, open_reviews; chunks (those ready for search): doc_id, chunk_id,
    product_id, version_id, first_page, last_page; links: doc_id, product_id, first_page, last_page. A chunk must lie in
    the pages of one link, that of its own product.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    # Rows of numbers compress well, so shuffled parts look small and would be merged into tasks of millions of rows.
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = chunks.where(~blank(F.col("product_id"))).repartition(parts, "doc_id")
    l = links.where(~blank(F.col("product_id"))).select(F.col("doc_id").alias("_d"), F.col("product_id").alias("_p"), F.col("first_page").alias("_lo"), F.coalesce("last_page", "first_page").alias("_hi"))  # noqa: E741
    met = bound.join(l, (bound["doc_id"] == l["_d"]) & (bound["last_page"] >= l["_lo"]) & (bound["first_page"] <= l["_hi"]), "left")
    per = met.groupBy("doc_id", "chunk_id", "product_id", "version_id").agg(F.count("_p").alias("fits"), F.count_if(F.col("_p") == F.col("product_id")).alias("own"))  # numbers only: hashed, not sorted
    clear = (F.col("fits") == 1) & (F.col("own") == 1)
    v = documents.select("doc_id", F.col("version_id").alias("_v"))
    checked = per.join(v, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("publishable"), F.sum((~clear).cast("long")).alias("ambiguous"), F.sum((~blank(F.col("_v")) & ~F.coalesce(F.col("version_id") == F.col("_v"), F.lit(False))).cast("long")).alias("unversioned")
    )
    isolated = chunks.where(blank(F.col("product_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("isolated"))
    joined = documents.join(checked, "doc_id", "left").join(isolated, "doc_id", "left").fillna(0, ["publishable", "ambiguous", "unversioned", "isolated"])
    reasons = F.array_compact(F.array(
        F.when(F.col("publishable") == 0, "product_binding_missing"),
        F.when(F.col("ambiguous") > 0, "product_boundary_ambiguous"),
        F.when(~blank(F.col("version_label")) & blank(F.col("version_id")), "product_version_resolution_missing"),
        F.when(F.col("unversioned") > 0, "product_version_binding_missing"),
        F.when(F.col("open_reviews") > 0, "page_correction_unconfirmed"),
    ))
    return joined.select("doc_id", F.when(F.size(reasons) > 0, "blocked").otherwise("pass").alias("decision"), F.array_join(reasons, ",").alias("blocking"), "publishable", "isolated")


# --- indicators and cards -------------------------------------------------------------------------

#: What a sentence of benefit is worked out from, in this order.
SENTENCE_RULES = [
    ("total_paid_premium", r"(?:已交|所交|实际交纳)[^。；]{0,12}?保(?:险)?费[^。；]{0,8}?(\d+(?:\.\d+)?)\s*(%|倍)"),
    ("basic_amount", r"(?:基本保险金额|基本保额|保险金额)[^。；]{0,8}?(\d+(?:\.\d+)?)\s*(%|倍)"),
    ("fixed", r"给付[^。；]{0,8}?(\d+(?:\.\d+)?)\s*(万元|元)"),
]
CONDITION = r"((?:若|于|在|自)[^，。；]{2,40}?)(?:，|,|我们|本公司)"


def indicators_from_clauses(rows: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """key, sentence, liability, basis, value, unit, condition: an indicator of each sentence that gives a benefit."""
    sentences = rows.select(key, name, F.posexplode(F.split(content, "[。；;]")).alias("sentence", "s")).where(F.trim("s") != "")
    out = None
    for basis, pattern in SENTENCE_RULES:
        number = F.regexp_extract("s", pattern, 1)
        made = F.struct(F.lit(basis).alias("basis"), number.try_cast("double").alias("value"), F.regexp_extract("s", pattern, 2).alias("unit"))
        out = (F if out is None else out).when(number != "", made)
    told = sentences.withColumn("i", out).where("i IS NOT NULL")
    liability = F.regexp_extract("s", f"({KNOWN_TITLES})", 1)
    return told.select(key, "sentence", F.when(liability != "", liability).otherwise(F.col(name)).alias("liability"), "i.basis", "i.value", "i.unit", F.regexp_extract("s", CONDITION, 1).alias("condition"))


def cards(indicators: DataFrame, responsibilities: DataFrame) -> DataFrame:
    """product, card, title, indicators, text: one card for each responsibility of a product.

    indicators: product, seq, title, shown (false for display only); responsibilities: product, ordinal, title, text. An
    indicator goes to the first responsibility whose title is its own or ends with it, else to a card of its own title;
    responsibilities that no indicator goes to become cards too.
    """
    i = indicators.where("shown").select("product", "seq", F.col("title").alias("_t"))
    r = responsibilities.select("product", "ordinal", "title", "text")
    # responsibilities grow with the products, whatever the size of their files: both sides are dealt by product
    ri = r.select("product", "title", F.struct("ordinal", "title", "text").alias("_r"))
    met = i.join(ri.hint("merge"), (i["product"] == ri["product"]) & F.endswith(ri["title"], i["_t"]), "left").select(i["product"], "seq", "_t", "_r")
    first = met.groupBy("product", "seq", "_t").agg(F.min("_r").alias("_r"))
    both = first.select("product", "seq", "_r.ordinal", F.coalesce("_r.title", "_t").alias("title"), F.when(F.col("_r").isNull(), "").otherwise(F.col("_r.text")).alias("text"))
    carded = both.groupBy("product", "title").agg(F.min(F.struct(F.coalesce("ordinal", F.lit(1 << 30)).alias("o"), "text"))["text"].alias("text"), F.count(F.lit(1)).alias("indicators"))
    rest = best_per_key(r, ["product", "title"], [F.col("ordinal")]).join(carded.select("product", "title").hint("merge"), ["product", "title"], "left_anti")
    return carded.unionByName(rest.select("product", "title", "text", F.lit(0).cast("bigint").alias("indicators")))


def rebuilt_options(records: DataFrame, found: DataFrame) -> DataFrame:
    """product, option, state, quantified: optional responsibilities of products after their texts were read again.

    records: product, option, chosen, quantified (as they were); found: product, option, value (as read now). What is
    found again keeps its choice and is quantified if it has a value; what was chosen stays although it was not found;
    new options are unknown.
    """
    now = found.groupBy("product", "option").agg(F.max("value").alias("value"), F.lit(True).alias("_now"))
    both = now.join(records, ["product", "option"], "full_outer")
    kept = both.where(F.col("_now") | F.col("chosen"))
    state = F.when(F.col("chosen"), "selected").when(F.col("chosen").isNull(), "unknown").otherwise("not_selected")
    return kept.select("product", "option", state.alias("state"), F.when(F.col("_now"), F.col("value").isNotNull()).otherwise(F.coalesce("quantified", F.lit(False))).alias("quantified"))


def merged_analyses(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """plan, row, title, source: rows of several analyses, each with the source whose title shares most words with it.

    rows: plan, row, title, failed; sources: plan, source, title. Rows of failed analyses carry no source.
    """
    words = lambda c: F.array_sort(F.array_distinct(F.split(F.lower(c), r"\s+")))
    # rows and sources of one set of words are alike: sets meet on words, and of a set's sources the first stands for all
    s = sources.groupBy("plan", words(F.col("title")).alias("_s")).agg(F.min("source").alias("source")).select("plan", "source", "_s")
    kept = rows.withColumn("_w", F.when(~F.col("failed"), words(F.col("title"))))
    w = kept.where("_w IS NOT NULL").select("plan", "_w").distinct()
    met = w.select("plan", "_w", F.explode("_w").alias("word")).join(s.select("plan", "source", "_s", F.explode("_s").alias("word")).hint("merge"), ["plan", "word"])
    met = met.groupBy("plan", "_w", "source", "_s").agg(F.count(F.lit(1)).alias("_n"))
    best = written(met.groupBy("plan", "_w").agg(F.min(F.struct(-F.col("_n"), "source"))["source"].alias("source")), "best")  # so that its size is known
    return kept.join(best, ["plan", "_w"], "left").select("plan", "row", F.when(F.col("failed"), F.lit("note")).otherwise(F.col("title")).alias("title"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))


def governance(indicators: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """lane, issue, n: indicators that lack a value or a source, and found candidates that no indicator has, by lane."""
    issues = F.array_compact(F.array(F.when(F.col("value").isNull(), "missing_value"), F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "missing_source")))
    known = indicators.select("lane", F.explode(issues).alias("issue"))
    new = found.join(indicators.select(*key), key, "left_anti").select("lane", F.lit("new_candidate").alias("issue"))
    return known.unionByName(new).groupBy("lane", "issue").agg(F.count(F.lit(1)).alias("n"))


def best_candidates(candidates: DataFrame, rules: dict[str, str]) -> DataFrame:
    """policy_id, field, value: of what several readers found, by the field's rule.

    candidates: policy_id, field, engine, value, score. Rules: longest, largest (number), best (score, the default).
    """
    size = F.length(F.trim("value")).cast("double")
    worth = F.col("score")
    for field, rule in rules.items():
        own = size if rule == "longest" else F.regexp_replace("value", r"[^\d.]", "").try_cast("double") if rule == "largest" else F.col("score")
        worth = F.when(F.col("field") == field, own).otherwise(worth)
    filled = candidates.where(F.trim("value") != "").withColumn("_w", F.coalesce(worth, F.lit(0.0)))
    return best_per_key(filled, ["policy_id", "field"], [F.desc("_w"), F.desc("score"), F.col("engine")]).select("policy_id", "field", F.trim("value").alias("value"))


def replay(stored: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """key, issue: fields that reading the stored text again loses, changes or adds."""
    a, b = stored.select(*key, F.col("value").alias("_a")), again.select(*key, F.col("value").alias("_b"))
    issue = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(*key, issue.alias("issue")).where("issue IS NOT NULL")


def field_values(lines: DataFrame, key: str, text: str, labels: dict[str, list[str]]) -> DataFrame:
    """key, field, value: what follows a field's label in a line; the first line that has one, the longest label first."""
    out = []
    for field, names in labels.items():
        pattern = "(?:" + "|".join(sorted(names, key=len, reverse=True)) + r")\s*[:：]\s*([^\s，,；;]+)"
        out.append(F.struct(F.lit(field).alias("field"), F.regexp_extract(text, pattern, 1).alias("value")))
    rows = lines.select(key, "line_no", F.inline(F.array(*out))).where("value <> ''")
    return best_per_key(rows, [key, "field"], [F.col("line_no")]).select(key, "field", "value")


def beside_labels(boxes: DataFrame, page: str, labels: dict[str, str], reach: float) -> DataFrame:
    """page, field, value: the box right of a label in its row, else the one below it, within reach.

    boxes: page, box_id, text, x, y. Labels are joined to boxes of their own page by ranges of rows, so a page of any
    size is compared with its few labels only.
    """
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    field = F.try_element_at(names, F.regexp_replace("text", r"[:：\s]", ""))
    l = boxes.where(field.isNotNull()).select(page, field.alias("field"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("box_id").alias("_id"))  # noqa: E741
    others = boxes.where(field.isNull())
    met = others.join(l, page)
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    right = (F.abs(dy) <= reach / 4) & (dx > 0) & (dx <= reach)
    below = (F.abs(dx) <= reach / 4) & (dy > 0) & (dy <= reach)
    ranked = met.where(right | below).withColumns({"_down": (~right).cast("int"), "_far": F.when(right, dx).otherwise(dy)})
    return best_per_key(ranked, [page, "field"], [F.col("_down"), F.col("_far"), F.col("box_id")]).select(page, "field", F.col("text").alias("value"))


def column_groups(cells: DataFrame) -> DataFrame:
    """page, policy_year, value of tables whose columns repeat in groups of year and value.

    cells: page, row, x, number; the first row's cells are headers (kind year or value at x). A cell belongs to the
    nearest header of its row; of cells that share one, the nearest counts. Pairs need both; of a year the first row stays.
    """
    headers = cells.where("row = 0").groupBy("page").agg(F.collect_list(F.struct("x", "kind", "grp")).alias("_h"))  # the headers of one page
    body = cells.where("row > 0").select("page", "row", "x", "number")
    # cells come from arrays, so their number is not seen in the size of the table: never sent to all tasks
    nearest = F.array_min(F.transform("_h", lambda h: F.struct(F.abs(F.col("x") - h["x"]).alias("d"), h["x"].alias("x"), h["kind"].alias("kind"), h["grp"].alias("grp"))))
    own = body.join(headers.hint("merge"), "page").select("page", "row", "x", "number", nearest.alias("_n"))
    once = own.groupBy("page", "row", F.col("_n.x").alias("_x")).agg(F.min(F.struct("_n.d", "x", "number", "_n.kind", "_n.grp")).alias("b")).select("page", "row", "b.*")
    pairs = once.groupBy("page", "row", "grp").agg(F.max(F.when(F.col("kind") == "year", F.col("number"))).alias("policy_year"), F.max(F.when(F.col("kind") == "value", F.col("number"))).alias("value"))
    full = pairs.where("policy_year BETWEEN 1 AND 150 AND value IS NOT NULL")
    first = full.groupBy("page", "policy_year").agg(F.min(F.struct("grp", "row", "value"))["value"].alias("value"))
    return first.select("page", F.col("policy_year").cast("int"), "value")
