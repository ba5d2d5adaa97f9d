from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.functions import names as N
from larkspur.functions import policy as P
from larkspur.operators import documents, matching, relations, retrieval, series, state
from larkspur.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_blank_and_numbers(spark):
    assert one(spark, C.blank_to_null(F.lit("  "))) is None
    assert one(spark, C.number(F.lit("1,234.50"))) == 1234.5
    assert one(spark, C.number(F.lit("abc"))) is None
    assert one(spark, C.half_up(F.lit(1.005), 2)) == 1.0


def test_similarity(spark):
    assert one(spark, C.dice(C.ngrams(F.lit("night"), 2), C.ngrams(F.lit("nacht"), 2))) == 0.25
    assert one(spark, C.jaccard(C.ngrams(F.lit(""), 2), C.ngrams(F.lit(""), 2))) == 0.0
    assert one(spark, C.prefix_ratio(F.lit("abcd"), F.lit("abxyz"))) == 0.4
    assert one(spark, C.composite_similarity(F.lit("care plan"), F.lit("care plan"))) == 1.0
    assert one(spark, C.composite_similarity(F.lit(""), F.lit("x"))) == 0.0


def test_dates(spark):
    assert one(spark, C.add_years(F.lit(date(2020, 2, 29)), F.lit(1))) == date(2021, 2, 28)
    assert one(spark, C.age_at(F.lit(date(1990, 6, 2)), F.lit(date(2000, 6, 1)))) == 9
    assert one(spark, C.age_at(F.lit(date(1990, 6, 2)), F.lit(date(1980, 6, 1)))) is None
    assert one(spark, P.payment_years(F.lit("20 年交"))) == 20
    assert one(spark, P.payment_years(F.lit("一次交清"))) == 1
    assert one(spark, P.payment_years(F.lit(""), None)) is None
    birth, start = F.lit("1980-01-01"), F.lit("2010年1月1日")
    wanted = {"终身": 2085, "至70周岁": 2050, "2031-05-06": 2031, "15年": 2025, "": 0}
    assert {k: one(spark, P.coverage_end_year(F.lit(k), start, birth)) for k in wanted} == wanted
    assert one(spark, P.coverage_end_year(F.lit(None).cast("string"), start, birth)) == 0


def test_ends_of_cover(spark):
    end = lambda text, start, birth="1980-02-29": one(spark, P.coverage_end(F.lit(text), F.lit(start), F.lit(birth)).cast("string"))
    assert end("10年", "2012-02-29") == "2022-02-28 23:59:59.999"  # 1 March less a day
    assert end("2030-02-30", "2012-02-29") is None and end("长期", "2012-01-01") is None
    assert end("至2030年6月1日零时", "2012-01-01") == "2030-06-01 00:00:00"
    assert end("保至41周岁", "2012-01-01") == "2021-03-01 23:59:59.999"


def test_numerals(spark):
    wanted = {"十": 10, "二十五": 25, "一百": 100, "一百二十": 120, "两": 2, "37": 37, "零": 0, "": 0, "甲": 0}
    assert {k: one(spark, P.chinese_integer(F.lit(k))) for k in wanted} == wanted
    assert one(spark, P.chinese_percent(F.lit("百分之九十"))) == 90 and one(spark, P.chinese_percent(F.lit("无"))) is None
    assert one(spark, P.cell_number(F.lit("12:34"))) == 12.34 and one(spark, P.cell_number(F.lit("1,2a"))) is None


def test_calculation_rules_keep_their_order(spark):
    rows = [("现金价值与基本保险金额的较大者", "manual_formula", "cash_value"), ("基本保险金额的 50%", "percent_of_basic_amount", "basic_amount"), ("已交保费", "total_paid_premium", "total_paid_premium"), ("", "unknown", "unknown")]
    df = spark.createDataFrame([(r[0],) for r in rows], "formula string")
    got = {r["formula"]: (r["meta"]["calculation"], r["meta"]["basis"]) for r in P.with_calculation(df).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in rows}
    given = spark.createDataFrame([("basic_amount", "basic_amount"), ("basic_amount", "fixed_amount")], "basis_key string, calculation_key string")
    assert sorted(r["meta"]["source"] for r in P.with_calculation(given).collect()) == ["code_inference", "structured_semantic"]


def test_names(spark):
    assert one(spark, N.canonical(F.lit("Ａｂ　ｃ Ⅳ"))) == "abciv"
    assert one(spark, N.common_substring(F.lit("abcdef"), F.lit("zcdexabc"))) == 3
    assert one(spark, N.common_substring(F.lit(""), F.lit("a"))) == 0
    assert one(spark, N.id_birthday(F.lit("11010119900230123X"))) is None


def test_similar_pairs_are_complete(spark):
    import random

    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    grams = lambda w: {w[i : i + 2] for i in range(max(1, len(w) - 1))}
    wanted = {(a, b) for a in words for b in words if len(grams(a) & grams(b)) >= 0.4 * len(grams(a) | grams(b))}
    assert {(x["left_key"], x["right_key"]) for x in matching.jaccard_pairs(df, df, "w", "w", 0.4).collect()} == wanted
    held = {(a, b) for a in words for b in words if a in b or b in a}
    assert {(x["left_key"], x["right_key"]) for x in matching.containment_pairs(df, df, "w", "w").collect()} == held


def test_ranks_over_ranges(spark):
    df = spark.range(500).selectExpr("id", "id % 2 as k", "id % 7 as v")
    got = {r["id"]: r["n"] for r in retrieval.global_ranks(df, ["k"], [F.desc("v"), F.col("id")], "n", 8).collect()}
    for k in (0, 1):
        ids = sorted((i for i in range(500) if i % 2 == k), key=lambda i: (-(i % 7), i))
        assert [got[i] for i in ids] == list(range(1, 251))


def test_text(spark):
    assert one(spark, C.html_text(F.lit("<p>a&amp;b</p><script>x</script> c"))) == "a&b c"
    assert one(spark, C.redact(F.lit("mail a.b@c.org or 13812345678"))) == "mail [EMAIL] or [MOBILE]"
    assert one(spark, C.fill_template(F.lit("{{a}} {{b}}"), {"a": F.lit(3)})) == "3 {{b}}"
    assert one(spark, C.token_estimate(F.lit("two words 3.5"))) == 3


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, version int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, version int")
    assert sorted(map(tuple, relations.upsert(old, new, ["k"], "version").select("k", "v").collect())) == [(1, "c"), (2, "b"), (3, "e")]
    assert sorted(map(tuple, relations.insert_missing(old, new, ["k"]).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "e")]
    merged = relations.merge_fields(old, spark.createDataFrame([(1, "", 9)], "k int, v string, version int"), "k")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 9), (2, "b", 5)]


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 5, "b"), (1, 6, "a")], "k int, t int, v string")
    assert sorted(tuple(r) for r in series.runs(df, ["k"], ["t"], "v").select("run", "v", "n").collect()) == [(1, "a", 2), (2, "b", 1), (3, "a", 1)]
    assert [tuple(r) for r in series.gaps(df, ["k"], "t").collect()] == [(1, 3, 4)]
    empty = df.limit(0)
    assert series.densify(empty.withColumn("x", F.lit(1.0)), ["k"], "t", "x").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1," two ""q"" \nlines"\n2,\n')
    rows = io.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()
    assert [r["a"] for r in rows] == [1, 2] and rows[1]["b"] is None and "lines" in rows[0]["b"]
    raw = spark.createDataFrame([(1, '{"x": 2}'), (2, "no json"), (3, None)], "k int, payload string")
    assert [tuple(r) for r in io.payload_rows(raw, "x int").collect()] == [(1, 2)]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert io.manifest({"a": a}).first() == io.manifest({"a": a.orderBy(F.desc("k"))}).first()
    wide = io.long_to_wide(spark.createDataFrame([(1, "f", "p"), (1, "g", "q")], "k int, field string, value string"), "k", "field", "value", ["f", "g"])
    assert tuple(wide.first()) == (1, "p", "q")


def test_repeated_lines(spark):
    docs = spark.createDataFrame([(1, "head\nbody\nhead"), (2, "head\nother")], "doc_id int, text string")
    assert [tuple(r) for r in documents.repeated_lines(docs, "doc_id", "text").collect()] == [("head", 2, 3)]


def test_budget_packing_sees_every_row(spark):
    from larkspur.plans import carriers

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("coalesce(lang, '') AS lang", "doc_id", "n_chars").collect()
    wanted, used, seen = set(), {}, set()
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        if r["lang"] not in seen or used[r["lang"]] + r["n_chars"] <= 100_000:
            seen.add(r["lang"])
            used[r["lang"]] = used.get(r["lang"], 0) + r["n_chars"]
            wanted.add((r["lang"], r["doc_id"], r["n_chars"]))
    got = carriers.QUERIES["budget_packing"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_sheets_and_sinks(spark, tmp_path):
    sheet = spark.createDataFrame([(0, ["name", "", "size "]), (1, ["a", "x", "1"]), (2, [" ", "y", None]), (3, ["b", None, "2"])], "n int, cells array<string>")
    rows = io.promote_header(sheet, "n")
    assert rows.columns == ["name", "size"] and sorted(map(tuple, rows.collect())) == [("a", "1"), ("b", "2")]
    keyed = io.keyed_rows(rows, ["name", "size"])
    assert len({r["id"] for r in keyed.collect()}) == 2 and keyed.columns[-1] == "id"
    io.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(map(tuple, io.read_json(spark, str(tmp_path / "lines"), "name string, size string").collect())) == [("a", "1"), ("b", "2")]
    parts = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    io.replace_partitions(parts, str(tmp_path / "parts"), "k")
    io.replace_partitions(spark.createDataFrame([(2, "new")], "k int, v string"), str(tmp_path / "parts"), "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == [(1, "old"), (2, "new")]
    made = io.snapshot({"rows": rows, "parts": parts}, str(tmp_path / "snapshot"))
    assert {r["name"]: r["n"] for r in made.collect()} == {"rows": 2, "parts": 2}


def test_folds_by_key(spark):
    from larkspur.operators import state

    saves = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 1), ("b", 2, 0)], "k string, at int, expected long")
    got = sorted((r["k"], r["at"], r["accepted"], r["version"]) for r in state.versioned_saves(saves, ["k"], ["at"]).collect())
    assert got == [("a", 1, True, 1), ("a", 2, False, 1), ("a", 3, True, 2), ("b", 1, False, 0), ("b", 2, True, 1)]
    boxes = spark.createDataFrame([(1, 0.0, 1), (1, 4.0, 2), (1, 8.0, 3), (2, 100.0, 4)], "page int, y double, id int")
    assert [r["line"] for r in documents.centred_lines(boxes, "page", "y", ["id"], 5.0).orderBy("id").collect()] == [1, 1, 2, 1]


def test_global_ranks_of_keys_larger_than_the_sample(spark):
    # a column that only one use needs must not change how rows are dealt
    df = spark.range(1_200_000, numPartitions=6).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"), "id", F.lit("x" * 20).alias("more"))
    ranked = retrieval.global_ranks(df, ["k"], [F.desc("v"), F.col("id")], "n")
    got = ranked.groupBy("k").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 600_000, 600_000), (1, 1, 600_000, 600_000)]
    assert ranked.select((F.lag("v").over(Window.partitionBy("k").orderBy("n")) < F.col("v")).alias("bad")).where("bad").isEmpty()


def test_chains_of_rollbacks_of_any_length(spark):
    rows = [("a", 1, "publish", "first", None)] + [("a", i, "rollback", None, i - 1) for i in range(2, 301)] + [("b", 1, "publish", "x", None)]
    log = spark.createDataFrame(rows, "k string, at int, action string, content string, target int")
    got = state.publish_log(log, "k", "at").collect()
    assert len(got) == 301 and {r["content"] for r in got if r["k"] == "a"} == {"first"}


def test_calculation_flags_statuses_and_inputs(spark):
    columns = "formula string, liability string, basis_key string, calculation_key string, excluded boolean, marked boolean, metadata_version string, quality_status string, scope string, decided_by string"
    rows = [
        ("基本保险金额×150%", "甲", None, None, None, None, None, None, None, None), ("基本保险金额×150%", "甲", None, None, True, None, None, None, None, None), ("基本保险金额×150%", "甲", None, None, None, False, None, None, None, None),
        ("基本保险金额×150%", "甲", None, None, None, False, "v1", None, None, None), ("基本保险金额×150%", "甲", None, None, None, None, None, "not_quantifiable", None, None), ("基本保险金额×150%", "甲", None, None, None, None, None, None, "rule_parameter", None),
        ("", "乙", "first_premium", "first_premium", None, None, None, None, None, "model_semantic"), ("", "乙", "first_premium", "first_premium", None, False, None, None, None, None), ("已交保险费与基本保额的较大者", "丙", None, None, None, None, None, None, None, None), ("两者取大", "丁", None, None, None, None, None, None, None, None),
    ]
    df = P.with_calculation(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + columns))
    got = {r["id"]: (r["basis"], r["calculation"], r["eligible"], r["source"], r["inputs"]) for r in df.select("id", "meta.*", P.required_inputs(F.col("meta")).alias("inputs")).collect()}
    rule, share = ("rule_parameter", "not_calculable", False, "code_safety_rule", ""), ("basic_amount", "percent_of_basic_amount", True, "code_inference", "policy.amount")
    assert [got[i] for i in range(6)] == [share, rule, rule, share, rule, rule]
    assert got[6] == ("first_premium", "first_premium", True, "model_semantic", "policy.firstPremium") and got[7][2:4] == (False, "structured_semantic")
    assert got[8] == ("total_paid_premium", "manual_formula", False, "code_safety_rule", "policy.firstPremium,policy.paymentPeriodYears")
    assert got[9] == ("unknown", "manual_formula", False, "code_safety_rule", "manualFormulaInputs")


def test_what_is_worked_out_once_reaches_every_row(spark):
    df = spark.createDataFrame([(i, ["a", None, "b"][i % 3], i % 2 or None) for i in range(12)], "id int, t string, n int")
    got = relations.once_each(df, ["t", "n"], {"made": F.concat(F.coalesce("t", F.lit("-")), F.coalesce(F.col("n").cast("string"), F.lit("-")))})
    assert sorted((r["id"], r["made"]) for r in got.collect()) == [(i, ("a", "-", "b")[i % 3] + ("1" if i % 2 else "-")) for i in range(12)]
