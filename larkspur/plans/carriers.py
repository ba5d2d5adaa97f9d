"""Queries by name, and the SQL that gives the same rows.

Each query applies an operator of the library to the given tables. `now` is always an argument or a constant
here, never the clock, so results do not drift.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import documents, relations, retrieval, rollup, series
from larkspur.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r2(c) -> F.Column:
    return C.half_up(c, 2)


# --- series ---------------------------------------------------------------------------------------

def term():
    return F.substring("o_orderpriority", 1, 1).cast("int") * 2


SQL_TERM = "CAST(substr(o_orderpriority, 1, 1) AS INT) * 2"


@query(f"""
WITH y AS (SELECT o_orderkey AS policy_id, year(o_orderdate) + unnest(range(0, {SQL_TERM})) AS year, o_totalprice * 0.05 AS amount FROM orders)
SELECT policy_id, CAST(year AS INT) AS year, floor(amount * 100 + 0.5) / 100 AS amount,
  floor(sum(amount) OVER (PARTITION BY policy_id ORDER BY year ROWS UNBOUNDED PRECEDING) * 100 + 0.5) / 100 AS cumulative FROM y""")
def cashflow_expand(t):
    start = F.year("o_orderdate")
    rows = t.orders.select(F.col("o_orderkey").alias("policy_id"), start.alias("start"), term().alias("term"), (F.col("o_totalprice") * 0.05).alias("amount"))
    yearly = series.expand_years(rows, F.col("start"), F.col("start") + F.col("term") - 1)
    return series.running_total(yearly, ["policy_id"], ["year"], "amount").select("policy_id", "year", r2(F.col("amount")).alias("amount"), r2(F.col("cumulative")).alias("cumulative"))


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS amount FROM orders GROUP BY ALL),
s AS (SELECT o_custkey, unnest(range(min(year), max(year) + 1)) AS year FROM y GROUP BY o_custkey)
SELECT s.o_custkey, CAST(s.year AS INT) AS year, round(coalesce(amount, 0), 2) AS amount,
  round(sum(coalesce(amount, 0)) OVER (PARTITION BY s.o_custkey ORDER BY s.year ROWS UNBOUNDED PRECEDING), 2) AS cumulative
FROM s LEFT JOIN y ON s.o_custkey = y.o_custkey AND s.year = y.year""")
def cashflow_densify(t):
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount"))
    return series.densify(rows, ["o_custkey"], "year", "amount").select("o_custkey", "year", F.round("amount", 2).alias("amount"), F.round("cumulative", 2).alias("cumulative"))


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS amount, count(*) AS details FROM orders GROUP BY ALL)
SELECT o_custkey, year, round(amount, 2) AS amount, details, round(sum(amount) OVER (PARTITION BY o_custkey ORDER BY year ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM y""")
def member_annual_summary(t):
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("details"))
    return series.running_total(yearly, ["o_custkey"], ["year"], "amount").select("o_custkey", "year", F.round("amount", 2).alias("amount"), "details", F.round("cumulative", 2).alias("cumulative"))


@query(f"""
WITH p AS (SELECT o_orderkey, year(o_orderdate) + unnest(range(0, {SQL_TERM})) AS year, o_totalprice / ({SQL_TERM}) AS premium FROM orders)
SELECT CAST(year AS INT) AS year, count(*) AS payments, round(sum(premium), 2) AS outflow FROM p GROUP BY year""")
def premium_outflow(t):
    rows = t.orders.select(F.year("o_orderdate").alias("start"), term().alias("term"), (F.col("o_totalprice") / term()).alias("premium"))
    paid = series.expand_years(rows, F.col("start"), F.col("start") + F.col("term") - 1)
    return paid.groupBy("year").agg(F.count(F.lit(1)).alias("payments"), F.round(F.sum("premium"), 2).alias("outflow"))


@query("""
WITH a AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS ordered, coalesce(b.n, 0) AS shipped FROM a FULL JOIN b ON a.year = b.year""")
def timeline_full_outer(t):
    a = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("ordered"))
    b = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("shipped"))
    return series.timeline(a, b, ["year"]).select("year", F.coalesce("ordered", F.lit(0)).alias("ordered"), F.coalesce("shipped", F.lit(0)).alias("shipped"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day FROM events), n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nx FROM d)
SELECT user_id, CAST(day + 1 AS INT) AS gap_start, CAST(nx - 1 AS INT) AS gap_stop FROM n WHERE nx - day > 1""")
def gap_ranges(t):
    days = t.events.select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    return series.gaps(days, ["user_id"], "day")


@query("""
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM r GROUP BY ALL""")
def islands_runs(t):
    return series.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT o_custkey, round(sum(l_extendedprice / pow(1.03, greatest(0, year(l_shipdate) - 1998))), 2) AS present_value
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def present_value(t):
    value = rollup.present_value(F.col("l_extendedprice"), F.year("l_shipdate") - 1998)
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.round(F.sum(value), 2).alias("present_value"))


# --- roll-ups -------------------------------------------------------------------------------------


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS policies, round(sum(coalesce(o_totalprice, 0)), 2) AS premium,
  round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS active_premium, max(o_orderdate) AS latest
FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_name""")
def family_summary(t):
    per = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("premium"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)).alias("active"), F.max("o_orderdate").alias("latest")
    )
    people = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return people.groupBy("n_name").agg(
        F.countDistinct("c_custkey").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("policies"), F.round(F.sum(F.coalesce("premium", F.lit(0.0))), 2).alias("premium"),
        F.round(F.sum(F.coalesce("active", F.lit(0.0))), 2).alias("active_premium"), F.max("latest").alias("latest"),
    )


@query("""
SELECT c_custkey, c_name, count(o_orderkey) AS policies, count(DISTINCT year(o_orderdate)) AS years, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def user_overview(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("policies"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.sum("o_totalprice").alias("total"))
    joined = t.customer.select("c_custkey", "c_name").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("policies", F.lit(0)).alias("policies"), F.coalesce("years", F.lit(0)).alias("years"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def latest_value(t):
    return relations.best_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def best_per_group(t):
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return relations.best_per_key(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("""
WITH p AS (SELECT n_name, c_mktsegment, sum(o_totalprice) AS value FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT n_name, c_mktsegment, round(value, 2) AS value, CASE WHEN max(sqrt(value)) OVER (PARTITION BY n_name) > 0 THEN floor(100 * sqrt(value) / max(sqrt(value)) OVER (PARTITION BY n_name) + 0.5) ELSE 0.0 END AS score FROM p""")
def normalized_scores(t):
    base = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    value = base.groupBy("n_name", "c_mktsegment").agg(F.sum("o_totalprice").alias("value"))
    return value.select("n_name", "c_mktsegment", F.round("value", 2).alias("value"), rollup.root_score("value", ["n_name"]).alias("score"))


@query("""
SELECT c_nationkey, round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'AUTOMOBILE'), 0), 2) AS automobile, round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0), 2) AS building,
  round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'FURNITURE'), 0), 2) AS furniture, round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'HOUSEHOLD'), 0), 2) AS household,
  round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 0), 2) AS machinery FROM customer GROUP BY c_nationkey""")
def radar_scorecard(t):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", names).agg(F.sum("c_acctbal"))
    return wide.select("c_nationkey", *[F.round(F.coalesce(F.col(n), F.lit(0.0)), 2).alias(n.lower()) for n in names])


@query("""
WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS actual, 5000.0::DOUBLE AS target FROM customer GROUP BY 1)
SELECT c_mktsegment, round(actual, 2) AS actual, floor(actual / target * 100 * 100 + 0.5) / 100 AS rate, round(greatest(target - actual, 0), 2) AS gap,
  round(greatest(actual - target, 0), 2) AS surplus, least(floor(actual / target * 100 * 100 + 0.5) / 100, 100.0) AS score FROM s""")
def target_gap(t):
    s = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("actual")).withColumn("target", F.lit(5000.0))
    m = rollup.target_gap(F.col("actual"), F.col("target"))
    return s.select("c_mktsegment", F.round("actual", 2).alias("actual"), m["rate"].alias("rate"), F.round(m["gap"], 2).alias("gap"), F.round(m["surplus"], 2).alias("surplus"), m["score"].alias("score"))


@query("""
WITH w AS (SELECT c_nationkey, c_mktsegment, sum(greatest(c_acctbal, 0)) AS weight FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, round(CASE WHEN sum(weight) OVER (PARTITION BY c_nationkey) > 0 THEN 100000.0 * weight / sum(weight) OVER (PARTITION BY c_nationkey)
  ELSE 100000.0 / count(*) OVER (PARTITION BY c_nationkey) END, 2) AS share FROM w""")
def target_allocation(t):
    w = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("weight"))
    return w.select("c_nationkey", "c_mktsegment", F.round(rollup.allocate(F.lit(100000.0), "weight", ["c_nationkey"]), 2).alias("share"))


@query("""
SELECT c_nationkey, count(*) AS customers, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS active, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1""")
def inventory_conditional_sums(t):
    return t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)), 2).alias("active"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC")
def histogram(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""")
def multi_histogram(t):
    return rollup.histogram(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber")


@query("""
SELECT unnest(string_split(p_name, ' ')) AS word, count(*) AS n FROM part GROUP BY 1""")
def explode_count(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT lang, count(*) AS n, min(quality) AS least, round(avg(quality), 6) AS mean, round(sum(quality * n_chars) / sum(n_chars), 6) AS weighted, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def confidence_aggregate(t):
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("quality").alias("least"), F.round(F.avg("quality"), 6).alias("mean"), F.round(F.sum(F.col("quality") * F.col("n_chars")) / F.sum("n_chars"), 6).alias("weighted"), F.sum(F.col("quality").isNull().cast("long")).alias("missing")
    )


@query("""
SELECT p_brand, p_type, p_size, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY p_partkey) AS ids FROM part GROUP BY ALL HAVING count(*) > 1""")
def dup_having_listagg(t):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), "|")
    return t.part.groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).where("n > 1")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(max(o_orderkey) + 1 AS BIGINT) AS next_id FROM orders")
def global_counts(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), (F.max("o_orderkey") + 1).alias("next_id"))


@query("""
WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT year, round(total, 2) AS total, round(sum(total) OVER (ORDER BY year), 2) AS running, year = (SELECT year FROM y ORDER BY total DESC, year LIMIT 1) AS is_peak FROM y""")
def yearly_peak(t):
    y = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    # One row per calendar year is left, so one window over all of them is small.
    peak = y.agg(F.max(F.struct("total", (-F.col("year")).alias("k"))).alias("p"))
    running = y.withColumn("running", F.sum("total").over(Window.orderBy("year")))
    return running.join(F.broadcast(peak)).select("year", F.round("total", 2).alias("total"), F.round("running", 2).alias("running"), (F.col("year") == -F.col("p.k")).alias("is_peak"))


@query("""
WITH c AS (SELECT s_nationkey, s_suppkey % 7 AS config, count(*) AS n FROM supplier GROUP BY ALL)
SELECT s_nationkey, config, n FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, config) AS k FROM c) WHERE k = 1""")
def mode_vote(t):
    votes = t.supplier.groupBy("s_nationkey", (F.col("s_suppkey") % 7).alias("config")).agg(F.count(F.lit(1)).alias("n"))
    return relations.best_per_key(votes, ["s_nationkey"], [F.desc("n"), F.col("config")])


# --- joins and sets -------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_missing(t):
    large = t.orders.where("o_totalprice > 400000")
    return relations.missing_from(t.customer, large, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')")
def semi_products(t):
    wanted = t.lineitem.where("l_quantity >= 50 AND l_returnflag = 'R'")
    return relations.present_in(t.part, wanted, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name")


@query("""
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A')""")
def not_exists_either(t):
    flags = t.lineitem.groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"))
    joined = t.part.select("p_partkey").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.where((F.coalesce("r", F.lit(0)) == 0) | (F.coalesce("a", F.lit(0)) == 0)).select("p_partkey")


@query("""
SELECT event_id, c_custkey, 'id' AS via FROM events JOIN customer ON user_id = c_custkey
UNION ALL SELECT event_id, c_custkey, 'derived' FROM events JOIN customer ON CAST(floor(value) AS BIGINT) = c_custkey WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def multikey_or_join(t):
    people = t.customer.select("c_custkey")
    direct = t.events.join(people, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_custkey", F.lit("id").alias("via"))
    rest = relations.missing_from(t.events, people, F.col("user_id") == F.col("c_custkey")).withColumn("k", F.floor("value"))
    return direct.unionByName(rest.join(people, F.col("k") == F.col("c_custkey")).select("event_id", "c_custkey", F.lit("derived").alias("via")))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50 AND p_brand = 'Brand#3')")
def array_overlap_invalidation(t):
    derived = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("keys"))
    changed = t.part.where("p_size = 50 AND p_brand = 'Brand#3'").select(F.col("p_partkey").alias("part"))
    return relations.array_overlap(derived, "l_orderkey", "keys", changed, "part")


@query("""
WITH s AS (SELECT s_suppkey, 'part ' || s_suppkey AS k1, s_suppkey % 50 AS k2, s_nationkey AS k3 FROM supplier),
p AS (SELECT p_partkey, p_name AS k1, p_partkey AS k2, p_size AS k3 FROM part),
a AS (SELECT k1, count(DISTINCT p_partkey) AS n, min(p_partkey) AS v FROM p GROUP BY 1), b AS (SELECT k2, count(DISTINCT p_partkey) AS n, min(p_partkey) AS v FROM p WHERE p_partkey % 2 = 0 GROUP BY 1), c AS (SELECT k3, count(DISTINCT p_partkey) AS n, min(p_partkey) AS v FROM p GROUP BY 1)
SELECT s_suppkey, CASE WHEN coalesce(a.n, b.n, c.n) = 1 THEN CASE WHEN a.n IS NOT NULL THEN a.v WHEN b.n IS NOT NULL THEN b.v ELSE c.v END END AS p_partkey,
  CASE WHEN coalesce(a.n, b.n, c.n) IS NULL THEN 'unmatched' WHEN coalesce(a.n, b.n, c.n) > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
  CASE WHEN a.n IS NOT NULL THEN 'name' WHEN b.n IS NOT NULL THEN 'code' WHEN c.n IS NOT NULL THEN 'size' END AS reason
FROM s LEFT JOIN a USING (k1) LEFT JOIN b USING (k2) LEFT JOIN c USING (k3)""")
def cascade_match(t):
    left = t.supplier.select("s_suppkey", F.concat(F.lit("part "), F.col("s_suppkey").cast("string")).alias("k1"), (F.col("s_suppkey") % 50).alias("k2"), F.col("s_nationkey").alias("k3"))
    right = t.part.select("p_partkey", F.col("p_name").alias("k1"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("k2"), F.col("p_size").alias("k3"))
    return relations.cascade_match(left, right, "s_suppkey", "p_partkey", [("name", "k1"), ("code", "k2"), ("size", "k3")])


@query("""
WITH v AS (SELECT o_custkey, o_orderkey AS version, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
SELECT o_custkey, count(*) AS hits, CASE WHEN count(*) = 1 THEN min(version) END AS version FROM v WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01') GROUP BY 1""")
def asof_version(t):
    ends = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    day = F.lit("1998-01-01").cast("timestamp_ntz")
    versions = t.orders.select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("valid_from"), ends.alias("valid_to"))
    hits = versions.where(relations.valid_at(F.col("valid_from"), F.col("valid_to"), day, half_open=True)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("hits"), F.min("version").alias("version"))
    return hits.withColumn("version", F.when(F.col("hits") == 1, F.col("version")))


@query("""
WITH r AS (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, o_orderdate AS d0, o_orderdate + INTERVAL 60 DAY AS d1 FROM orders)
SELECT o_orderkey, lo, hi FROM p JOIN r ON o_orderkey = l_orderkey AND d0 <= hi AND lo <= d1""")
def page_range_overlap(t):
    ranges = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    periods = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("d0"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("d1"))
    found = relations.interval_overlaps(periods, ranges, ["key"], ("d0", "d1"), ("lo", "hi"))
    return found.select(periods["key"].alias("o_orderkey"), "lo", "hi")


RECONCILE = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"


@query("""
WITH a AS (SELECT o_orderkey, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'create' WHEN b.o_orderkey IS NULL THEN 'delete' WHEN a.p = b.p AND a.s = b.s THEN 'keep' ELSE 'update' END AS action
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def reconcile_diff(t):
    columns = ["o_totalprice", "o_orderstatus"]
    old = t.orders.select("o_orderkey", *columns).where("o_orderkey % 10 <> 0")
    new = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    return relations.reconcile(old, new, "o_orderkey", columns)


@query("""
WITH l AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1)
SELECT c_custkey, coalesce(value, c_acctbal) AS c_acctbal FROM customer LEFT JOIN l ON user_id = c_custkey""")
def correction_merge(t):
    changes = t.events.where("event_type = 'purchase'").withColumnRenamed("user_id", "c_custkey")
    return relations.latest_overrides(t.customer, changes, "c_custkey", [F.desc("ts"), F.desc("event_id")], "c_acctbal", "value").select("c_custkey", "c_acctbal")


@query("""
WITH f AS (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN f ON s_nationkey = n_nationkey""")
def first_match_join(t):
    first = relations.best_per_key(t.supplier.where("s_acctbal > 0"), ["s_nationkey"], [F.col("s_suppkey")]).select("s_nationkey", "s_suppkey")
    return t.nation.join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def keep_first(t):
    return relations.best_per_key(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def keep_best(t):
    return relations.best_per_key(t.events, ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def id_union(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("""
WITH u AS (SELECT 'supplier' AS source, s_name AS name FROM supplier UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'nation', n_name FROM nation)
SELECT source, name, count(*) AS n FROM u WHERE trim(name) <> '' GROUP BY ALL""")
def catalog_union_count(t):
    return io.catalog(t).where(F.trim("name") != "").groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT s_name AS name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation), d AS (SELECT name, lower(name) AS low, count(*) AS n FROM u GROUP BY 1),
s AS (SELECT name, n, CASE WHEN low = 'hot' THEN 1000 WHEN contains(low, 'hot') THEN 800 - (length(low) - 3) ELSE 40 * (contains(low, 'ho')::INT + contains(low, 'ot')::INT) + 4 * (contains(low, 'h')::INT + contains(low, 'o')::INT + contains(low, 't')::INT) - abs(length(low) - 3) END AS score FROM d)
SELECT name, n, CAST(score AS INT) AS score FROM s ORDER BY score DESC, n DESC, name LIMIT 20""")
def catalog_search(t):
    names = io.catalog(t).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("name", "n", retrieval.catalog_score(F.col("name"), "hot").cast("int").alias("score")).orderBy(F.desc("score"), F.desc("n"), "name").limit(20)


# --- windows, sorts, limits -----------------------------------------------------------------------


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS m FROM a WHERE k <= 1)
SELECT doc_id, source, lang, n_chars FROM b WHERE m <= 3 ORDER BY n_chars DESC, doc_id LIMIT 6""")
def topn_caps(t):
    return retrieval.capped(t.documents.select("doc_id", "source", "lang", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], [("source", 1), ("lang", 3)], 6)


TERMS = ["the", "hand", "idiot", "of"]


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM documents), h AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'hand', 'idiot', 'of') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) AS k FROM h) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS score FROM r GROUP BY 1""")
def rrf_fusion(t):
    hits = documents.term_counts(t.documents, "doc_id", "text").where(F.col("term").isin(TERMS))
    fused = retrieval.fuse_ranks(hits, "doc_id", "term", [F.desc("tf"), F.col("doc_id")])
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS ws FROM documents),
m AS (SELECT doc_id, len(ws) AS l, len(list_filter(ws, lambda x: x = 'the')) AS t0, len(list_filter(ws, lambda x: x = 'hand')) AS t1, len(list_filter(ws, lambda x: x = 'idiot')) AS t2 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1, sum((t2 > 0)::INT) AS d2 FROM m)
SELECT doc_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / a))
  + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * l / a)), 6) AS score FROM m, s WHERE t0 + t1 + t2 > 0""")
def bm25_search(t):
    return retrieval.bm25(t.documents, "doc_id", "text", ["the", "hand", "idiot"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def paginate(t):
    total = t.part.agg(F.count(F.lit(1)).alias("total"))
    page = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(25).select("p_partkey", "p_name")
    return page.join(F.broadcast(total))


@query("""
WITH k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderkey, o_orderstatus FROM k WHERE (o_orderstatus = 'F' AND k <= 30) OR (o_orderstatus = 'O' AND k <= 70)""")
def stratified_sample(t):
    ranked = relations.best_per_key(t.orders.where("o_orderstatus IN ('F', 'O')"), ["o_orderstatus"], [F.col("o_orderkey")], 70)
    k = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey"))
    return ranked.withColumn("k", k).where("(o_orderstatus = 'F' AND k <= 30) OR o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")


@query("""
SELECT event_id, user_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def prev_next_links(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("following"))


@query("""
SELECT n_nationkey, c_custkey, c_acctbal, pick FROM (SELECT c_nationkey AS n_nationkey, c_custkey, c_acctbal, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3 THEN 'top'
  WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1 THEN 'lowest' END AS pick FROM customer) WHERE pick IS NOT NULL""")
def top_three_and_lowest(t):
    top = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    low = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey"))
    return t.customer.withColumn("pick", F.when(top <= 3, "top").when(low == 1, "lowest")).where("pick IS NOT NULL").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal", "pick")


# --- scalar functions -----------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50""")
def json_extract_filter(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 50")


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN json_valid(props) THEN 1 ELSE 0 END)::BIGINT AS valid FROM events GROUP BY 1")
def json_valid(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_parse_json("props").isNotNull().cast("long")).alias("valid"))


@query("""
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') OR bool_or(l_linestatus = 'X')""")
def json_array_exists(t):
    packed = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_returnflag")).alias("payload"))
    flags = F.from_json("payload", "array<string>")
    return packed.where(F.arrays_overlap(flags, F.array(F.lit("R")))).select("l_orderkey")


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'hot|warm') THEN 'heat' WHEN regexp_matches(p_name, 'gear|bolt') THEN 'metal' WHEN regexp_matches(p_type, 'ECONOMY') THEN 'cheap' ELSE 'other' END AS label FROM part""")
def classify_first(t):
    name, kind = F.col("p_name"), F.col("p_type")
    label = F.coalesce(C.first_label(name, [("hot|warm", "heat"), ("gear|bolt", "metal")]), C.first_label(kind, [("ECONOMY", "cheap")], "other"))
    return t.part.select("p_partkey", label.alias("label"))


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'number' END, CASE WHEN regexp_matches(text, 'License') THEN 'license' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END) AS labels FROM documents""")
def classify_multi(t):
    labels = C.all_labels(F.col("text"), [("[0-9]{3,}", "number"), ("License", "license"), ("@", "mail")])
    return t.documents.select("doc_id", F.array_join(labels, ",").alias("labels"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'manual' WHEN l_returnflag = 'A' THEN 'ratio' WHEN l_linestatus = 'O' THEN 'basic' ELSE 'fixed' END AS basis,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN floor(l_extendedprice * l_discount * 100 + 0.5) / 100 WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 1000.0 END AS amount FROM lineitem""")
def indicator_calc(t):
    basis = F.when(F.col("l_returnflag") == "R", "manual").when(F.col("l_returnflag") == "A", "ratio").when(F.col("l_linestatus") == "O", "basic").otherwise("fixed")
    amount = F.when(basis == "ratio", r2(F.col("l_extendedprice") * F.col("l_discount"))).when(basis == "basic", F.col("l_extendedprice")).when(basis == "fixed", F.lit(1000.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", basis.alias("basis"), amount.alias("amount"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 30 AS INT)) AS due FROM orders")
def age_add_years(t):
    return t.orders.select("o_orderkey", C.add_years(F.to_date("o_orderdate"), F.col("o_orderkey") % 30).cast("timestamp_ntz").alias("due"))


@query("""
SELECT o_orderkey, CAST(2000 - year(o_orderdate) - CASE WHEN 615 >= month(o_orderdate) * 100 + day(o_orderdate) THEN 0 ELSE 1 END AS INT) AS age FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-15'""")
def age_at_date(t):
    day = F.lit("2000-06-15").cast("date")
    return t.orders.where(F.to_date("o_orderdate") <= day).select("o_orderkey", C.age_at(F.to_date("o_orderdate"), day).alias("age"))


@query("""
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\\b[0-9]{17}[0-9Xx]\\b', '[ID]', 'g'), '\\b[0-9]{16,19}\\b', '[CARD]', 'g'),
  '\\b1[3-9][0-9]{9}\\b', '[MOBILE]', 'g'), '\\b0[0-9]{2,3}-[0-9]{7,8}\\b', '[PHONE]', 'g'), '\\b[0-9]{3}-[0-9]{3}-[0-9]{4}\\b', '[PHONE]', 'g') AS text FROM conversations""")
def pii_redact(t):
    return t.conversations.select("conv_id", "turn", C.redact(F.col("text")).alias("text"))


@query("""
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(t):
    return documents.links(t.pages, "page_id", "html")


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages""")
def html_text(t):
    return t.pages.select("page_id", C.html_text(F.col("html")).alias("text"))


@query("""
SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 20 THEN 'short' ELSE 'ok' END AS gate FROM documents""")
def quality_gate(t):
    return documents.quality_gate(t.documents, "doc_id", "text")


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM l WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def repeated_lines(t):
    return documents.repeated_lines(t.documents, "doc_id", "text")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, len(regexp_extract_all(line, '[\x{3400}-\x{9fff}]')) + len(regexp_extract_all(line, '[A-Za-z]+|\d+(?:\.\d+)?')) AS tokens FROM l WHERE trim(line) <> ''),
c AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200 AS INT) AS chunk_no FROM n)
SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY pos) AS content, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY 1, 2""")
def text_chunk(t):
    return documents.chunk(t.documents, "doc_id", "text", most_tokens=200)


@query(r"""
WITH b AS (SELECT page_id, regexp_replace(html || chr(7), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS bare, length(html) + 1 AS n FROM pages), c AS (SELECT *, regexp_replace(bare || ' - ' || page_id || ' -', '\s*(?:[-–—]\s*)?\d{1,4}(?:\s*[-–—])?\s*$', '') AS text, length(bare || ' - ' || page_id || ' -') AS m FROM b)
SELECT page_id, text, CAST(n - length(bare) AS INT) AS removed_controls, length(text) < m AS removed_page_number FROM c""")
def page_clean(t):
    text = F.concat("html", F.lit("\x07 - "), F.col("page_id").cast("string"), F.lit(" -"))
    return documents.clean_pages(t.pages.select("page_id", text.alias("text")), "page_id", "text")


@query("""
WITH b AS (SELECT item_id, text AS passage FROM benchmark), h AS (SELECT item_id, count(doc_id) AS found FROM b LEFT JOIN documents d ON contains(d.text, passage) GROUP BY 1)
SELECT count(*) AS items, sum((found > 0)::INT)::BIGINT AS found_items, sum(found)::BIGINT AS links FROM h""")
def retrieval_metrics(t):
    found = documents.containing(t.documents, "doc_id", "text", t.benchmark, "item_id", "text").groupBy("item_id").agg(F.count(F.lit(1)).alias("found"))
    joined = t.benchmark.select("item_id").join(found, "item_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("items"), F.count("found").alias("found_items"), F.coalesce(F.sum("found"), F.lit(0)).alias("links"))


# --- state ----------------------------------------------------------------------------------------


@query("""
SELECT user_id, CAST(ts AS DATE)::TIMESTAMP AS day, event_type, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY ALL""")
def daily_quota(t):
    counted = t.events.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rejected", F.greatest(F.col("n") - 2, F.lit(0)).cast("bigint"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-02-01'""")
def ttl_latest_valid(t):
    last = relations.best_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.where(F.col("ts") + F.expr("INTERVAL 10 DAY") > F.lit("2024-02-01").cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


@query("""
SELECT user_id, event_type AS state, attempts FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id) AS attempts FROM events) WHERE k = 1""")
def outbox_fold(t):
    folded = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.sum((F.col("event_type") == "click").cast("long")).alias("attempts"))
    return folded.select("user_id", F.col("last.event_type").alias("state"), "attempts")


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1""")
def idempotent_events(t):
    paid = t.events.where("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    return relations.best_per_key(paid, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("""
WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey % 97 = 0) SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'ready' ELSE 'stale' END AS status, CAST(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 2 END AS INT) AS version FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def incremental_invalidation(t):
    changed = t.part.where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("l_partkey"))
    touched = relations.present_in(t.lineitem.select("l_orderkey", "l_partkey"), changed, "l_partkey").select("l_orderkey").distinct()
    marked = t.orders.select("o_orderkey").join(touched, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return marked.select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "ready").otherwise("stale").alias("status"), F.when(F.col("l_orderkey").isNull(), 1).otherwise(2).alias("version"))
