"""Carrier queries on scanned pages: tables from text boxes, fields by labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import boxes, labels
from larkspur.plans.carriers import query

# --- tables from boxes ----------------------------------------------------------------------------


def value_boxes(t):
    """A cash-value table for each part as text boxes: one group of columns, two side by side, with ages, or without any places."""
    key = F.col("p_partkey")
    part = t.part.select(key.cast("string").alias("page"), key, (key % 4).alias("kind"), (6 + key % 5).cast("int").alias("n"))
    each = part.withColumn("year", F.explode(F.sequence(F.lit(1), F.col("n"))))
    group = F.when((F.col("kind") == 1) & (F.col("year") > F.ceil(F.col("n") / 2)), 1).otherwise(0)
    y = 100 + 40 * (F.col("year") - group * F.ceil(F.col("n") / 2)) + (F.col("year") * 7 + key) % 9 - 4

    def box(i, text, x, y):
        at = lambda dx, dy: F.array((F.lit(x) + dx).cast("double") if isinstance(x, int) else (x + dx).cast("double"), (F.lit(y) + dy).cast("double") if isinstance(y, int) else (y + dy).cast("double"))
        return F.struct((F.lit(i) if isinstance(i, int) else i).cast("int").alias("i"), text.alias("text"), F.when(F.col("kind") != 3, F.array(at(0, 0), at(40, 0), at(40, 20), at(0, 20))).alias("box"))

    shown = F.when(key % 3 == 0, F.concat(F.lit("第"), F.col("year").cast("string"), F.lit("年末"))).otherwise(F.col("year").cast("string"))
    value = F.format_number(F.col("year") * 1000 + key % 97 + F.lit(0.5), 2)
    cells = [box(10 + 3 * F.col("year"), shown, 100 + 500 * group, y), box(12 + 3 * F.col("year"), value, 350 + 500 * group, y)]
    age = box(11 + 3 * F.col("year"), (29 + F.col("year")).cast("string"), 210, y)
    rows = each.select("page", F.explode(F.when(F.col("kind") == 2, F.array(*cells, age)).otherwise(F.array(*cells))).alias("b"))
    title = lambda i, text, x: box(i, F.lit(text), x, 60)
    heads = (
        F.when(F.col("kind") == 0, F.array(title(0, "保单年度", 100), title(1, "现金价值（元）", 350)))
        .when(F.col("kind") == 1, F.array(title(0, "保单年度末", 100), title(1, "现金价值", 350), title(2, "保单年度末", 600), title(3, "现金价值", 850)))
        .when(F.col("kind") == 2, F.array(title(0, "保险年限", 100), title(1, "被保险年龄", 210), title(2, "现金价值", 350)))
        .otherwise(F.array(title(0, "保单年度 现金价值", 100)))
    )
    return rows.unionByName(part.select("page", F.explode(heads).alias("b"))).select("page", "b.*", F.lit(0.9).alias("confidence"))


@query("""
WITH y AS (SELECT p_partkey, unnest(range(1, 7 + p_partkey % 5)) AS year FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS page, 'ok' AS status, CASE WHEN p_partkey % 4 = 2 THEN 3 ELSE 2 END::INT AS width, 0.96::DOUBLE AS confidence, year::INT AS year, CASE WHEN p_partkey % 4 = 2 THEN 29.0 + year END::DOUBLE AS age, (year * 1000 + p_partkey % 97 + 0.5)::DOUBLE AS value FROM y""")
def value_tables_from_boxes(t):
    return boxes.cash_value_tables(value_boxes(t)).select("page", "status", "width", "confidence", F.inline("rows"))


# --- fields by labels -----------------------------------------------------------------------------

SHOWN = [("被保险人：", 98.0), ("被保验人：", 83.0), ("被保人 ", 75.0), ("被保险入姓名: ", 83.0), ("备注 被保险人姓名：", 88.0), ("投保人：", None), ("被保险人\n", 70.0)]


@query(f"""
WITH s AS (SELECT c_custkey, c_name, c_nationkey, ([{', '.join('NULL' if s is None else str(s) for _, s in SHOWN)}]::DOUBLE[])[CAST(c_custkey % {len(SHOWN)} + 1 AS INT)] AS score FROM customer)
SELECT c_custkey AS page, 'insured' AS field, c_name AS value, score, CASE WHEN score >= 90 THEN 'matcher-high' WHEN score >= 70 THEN 'matcher' ELSE 'review' END AS confidence FROM s WHERE score IS NOT NULL
UNION ALL SELECT c_custkey, 'amount', c_nationkey || '万元', 83.0, 'matcher' FROM s""")
def scanned_fields(t):
    key = F.col("c_custkey")
    shown = F.element_at(F.array(*[F.lit(x) for x, _ in SHOWN]), (key % len(SHOWN) + 1).cast("int"))
    text = F.concat(F.lit("电子保单\n"), shown, "c_name", F.lit("；其他\n基夲保险金额："), F.col("c_nationkey").cast("string"), F.lit("万元  备注"))
    lines = t.customer.select(key.alias("page"), F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    known = t.customer.sparkSession.createDataFrame([("insured", "被保险人"), ("insured", "被保险人姓名"), ("amount", "基本保险金额")], "field string, label string")
    return labels.best_fields(lines, known).select("page", "field", "value", "score", "confidence")
