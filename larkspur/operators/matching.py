"""Joins by likeness: complete candidate search over rare grams, tiers, aliases, people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.functions.columns import composite_similarity, jaccard, ngrams
from larkspur.operators.relations import best_per_key, once_each
from larkspur.sources.shared import written


def jaccard_pairs(left: DataFrame, right: DataFrame, key: str, text: str, least: float, n: int = 2, on: list[str] | None = None) -> DataFrame:
    """left_key, right_key, score of all pairs whose grams' Jaccard similarity reaches `least`; `on` must be equal too.

    Two sets of that similarity share a gram among their first size - ceil(least * size) + 1 in any one order. Rare
    grams come first in the order, so only pairs that share a rare one meet, and none is lost.
    """
    on = on or []
    a, b = (df.select(F.col(key).alias("key"), *on, ngrams(F.col(text), n).alias("grams")).where(F.size("grams") > 0) for df in (left, right))
    each = a.select("grams").unionByName(b.select("grams")).select(F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(df: DataFrame) -> DataFrame:
        owned = df.select("key", *on, F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(counts.hint("merge"), "gram")
        rank = F.row_number().over(Window.partitionBy("key", *on).orderBy("df", "gram"))
        return owned.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("key", *on, "size", "gram")

    # grams are many times the rows they come from, which the size of the files does not show: no side is sent to all tasks
    p, q = prefixes(a), prefixes(b).hint("merge")
    met = p.select(F.col("key").alias("left_key"), *on, F.col("size").alias("m"), "gram").join(q.select(F.col("key").alias("right_key"), *on, F.col("size").alias("n"), "gram"), ["gram", *on])
    met = met.where((F.col("m") >= F.col("n") * least) & (F.col("n") >= F.col("m") * least)).select("left_key", "right_key", *on).distinct()
    scored = met.join(a.select(F.col("key").alias("left_key"), *on, F.col("grams").alias("_a")).hint("merge"), ["left_key", *on]).join(b.select(F.col("key").alias("right_key"), *on, F.col("grams").alias("_b")).hint("merge"), ["right_key", *on])
    return scored.withColumn("score", jaccard(F.col("_a"), F.col("_b"))).where(F.col("score") >= least).select("left_key", "right_key", "score")


def best_choice(df: DataFrame, key: str, text: str, choices: list[str], least: float = 0.7) -> DataFrame:
    """key, choice, score: for each text the choice that one of its windows is most like; ties go to the earlier choice.

    The choices are a list in the plan. Each distinct text is scored once.
    """
    # written in between, so that no condition on a score is worked out again on every row
    folded = once_each(df.select(key, text), [text], {"_t": N.scan_text(F.col(text))}).where("_t <> ''")

    def scored(i: int, choice: str) -> Column:
        c = N.scan_text(F.lit(choice))
        best = F.array_max(F.transform(N.windows(F.col("_t"), F.length(c)), lambda w: composite_similarity(w, c)))
        return F.when(N.salient_overlap(F.col("_t"), F.lit(choice)), F.struct(best.alias("score"), F.lit(-i).alias("place"), F.lit(choice).alias("choice")))

    ranked = once_each(folded.select(key, "_t"), ["_t"], {"b": F.array_max(F.array_compact(F.array(*[scored(i, c) for i, c in enumerate(choices)])))})
    return ranked.where(F.col("b.score") >= least).select(key, "b.choice", "b.score")


#: Fixed value: least bigram Dice of names of one company.
LEAST_DICE = 0.55


def catalog_matches(candidates: DataFrame, catalog: DataFrame, n: int = 5) -> DataFrame:
    """candidate_id, product_id, score, reason: the best n products of each candidate.

    Both: id, company, name, codes (array). A shared code scores 1; one company and equal names 0.96; one company and a
    bigram Dice of 0.55 or more 0.55 + 0.35 * Dice. Equi-joins find them: on codes, on bigrams. Rows of one company and
    name are alike, so names are compared once; of a code or a name the first n products stand for all, since more of
    equal score are never among the best.
    """
    tight = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s·•,，。；;：:（）()《》【】\[\]_-]+", ""))
    form = lambda df, k: df.select(F.col("id").alias(k), F.struct(tight(F.col("company")).alias("company"), tight(F.col("name")).alias("name")).alias("key"), F.col("codes").alias("codes"))
    a, b = form(candidates, "candidate_id"), form(catalog, "product_id")
    code = lambda df, k: df.select(k, F.explode("codes").alias("code")).select(k, F.upper("code").alias("code")).distinct()
    first_of = lambda df, of: best_per_key(df, [of], [F.col("product_id")], n)
    by_code = code(a, "candidate_id").join(first_of(code(b, "product_id"), "code").hint("merge"), "code").select("candidate_id", "product_id").distinct().select("candidate_id", "product_id", F.lit(1.0).alias("score"), F.lit("exact_product_code").alias("reason"))
    # the different names of a company; a Dice of d is a Jaccard similarity of d / (2 - d): they meet on rare bigrams
    names = lambda df: written(df.select("key").distinct(), "names").select("key", "key.company", F.col("key.name").alias("text"))
    own, others = names(a), names(b)
    near = jaccard_pairs(own, others, "key", "text", LEAST_DICE / (2 - LEAST_DICE) - 1e-9, on=["company"])
    g, h = ngrams(F.col("left_key.name"), 2), ngrams(F.col("right_key.name"), 2)
    like = near.withColumn("d", 2 * F.size(F.array_intersect(g, h)) / (F.size(g) + F.size(h))).where(F.col("d") >= LEAST_DICE)
    by_gram = like.where("left_key <> right_key").select("left_key", "right_key", F.round(0.55 + F.col("d") * 0.35, 3).alias("score"), F.lit("similar_company_name").alias("reason"))
    equal = own.select("key").join(others.select("key"), "key").select(F.col("key").alias("left_key"), F.col("key").alias("right_key"), F.lit(0.96).alias("score"), F.lit("exact_company_name").alias("reason"))
    products = first_of(b.select("key", "product_id").distinct(), "key").withColumnRenamed("key", "right_key")
    by_name = best_per_key(by_gram.unionByName(equal).join(products.hint("merge"), "right_key"), ["left_key"], [F.desc("score"), F.col("product_id")], n)
    by_name = written(by_name.select("left_key", "product_id", "score", "reason"), "best_names")  # so that its size is known
    named = a.select("candidate_id", F.col("key").alias("left_key")).distinct().join(by_name, "left_key").select("candidate_id", "product_id", "score", "reason")
    best = best_per_key(by_code.unionByName(named), ["candidate_id", "product_id"], [F.desc("score"), F.col("reason")])
    return best_per_key(best, ["candidate_id"], [F.desc("score"), F.col("product_id")], n)


def containment_pairs(left: DataFrame, right: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """left_key, right_key of texts of which one holds the other.

    A text that is held has all its runs of n characters in the other (one of fewer is such a run itself). It is joined on
    the one of them that fewest others have, both ways round, so a beginning that all share brings no pairs.
    """
    side = lambda df, k: df.select(F.col(key).alias(k), F.col(text).alias(f"_{k}")).where(F.length(f"_{k}") > 0)
    a, b = side(left, "left_key"), side(right, "right_key")

    def inside(outer: DataFrame, ok: str, inner: DataFrame, ik: str) -> DataFrame:
        parts = F.array_distinct(F.flatten(F.array(*[ngrams(F.col(f"_{ok}"), k) for k in range(1, n + 1)])))
        runs = outer.select(ok, f"_{ok}", F.explode(parts).alias("run"))
        counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
        own = F.when(F.length(f"_{ik}") >= n, ngrams(F.col(f"_{ik}"), n)).otherwise(F.array(f"_{ik}"))
        each = inner.select(ik, f"_{ik}", F.explode(own).alias("run")).join(counts, "run", "left")
        rarest = each.groupBy(ik, f"_{ik}").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("r")).where("r.df > 0").select(ik, f"_{ik}", F.col("r.run").alias("run"))
        return runs.join(rarest, "run").where(F.contains(F.col(f"_{ok}"), F.col(f"_{ik}"))).select("left_key", "right_key")

    return inside(a, "left_key", b, "right_key").unionByName(inside(b, "right_key", a, "left_key")).distinct()


def alias_pairs(left: DataFrame, right: DataFrame, key: str, company: str, aliases: DataFrame) -> DataFrame:
    """left_key, right_key of companies that share a name: their own or one of their aliases (canonical, alias).

    Aliases lead to one canonical name each way, so both sides are joined on canonical names, never on each other's lists.
    """
    listed = aliases.select(N.company_core(F.col("alias")).alias("name"), F.col("canonical")).unionByName(aliases.select(N.company_core(F.col("canonical")).alias("name"), F.col("canonical"))).distinct()

    def named(df: DataFrame, k: str) -> DataFrame:
        own = df.select(F.col(key).alias(k), N.company_core(F.col(company)).alias("name")).where("name <> ''")
        found = own.join(listed, "name", "left").select(k, F.coalesce("canonical", "name").alias("canonical"))
        return found.groupBy(k).agg(F.array_sort(F.collect_set("canonical")).alias(f"_{k}s"))  # the names of one row

    # the pairs of one name may be many, so left rows are dealt over all tasks; of the names that two rows share the
    # first makes the pair, so none comes twice and no pair is shuffled
    a, b = (written(named(df, k), "named") for df, k in ((left, "left_key"), (right, "right_key")))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = a.repartition(parts, "left_key").select("left_key", "_left_keys", F.explode("_left_keys").alias("canonical"))
    b = b.select("right_key", "_right_keys", F.explode("_right_keys").alias("canonical"))
    alone = (F.size("_left_keys") == 1) | (F.size("_right_keys") == 1)
    met = a.join(b, "canonical").where(F.when(alone, True).otherwise(F.get(F.array_intersect("_left_keys", "_right_keys"), F.lit(0)) == F.col("canonical")))
    return met.select("left_key", "right_key")


def match_people(asked: DataFrame, members: DataFrame) -> DataFrame:
    """person_id, member_id: the member that a named person is; NULL where none fits.

    asked: person_id, family_id, name, birthday, id_tail; members: member_id, family_id, name, birthday, id_tail, score
    (how firmly the relation is known). A member fits whose name is equal and whose birthday and number do not differ.
    Those with the birthday come first, then those with the number, then the better known, then the smaller id.

    Members of one family, name, birthday and number differ in rank only, so each such profile, and each with the one or
    the other left out, has one best member; a person's profile asks for up to four of them. No pairs are made.
    """
    keys, who = ["family_id", "name", "_kb", "_kt"], ["family_id", "name", "_b", "_t"]
    # a key's part is (true, value or null) for what a member has, (false, null) for any
    has = lambda c: F.struct(F.lit(True).alias("own"), c.alias("value"))
    any_of = lambda c: F.struct(F.lit(False).alias("own"), F.when(F.lit(False), c).alias("value"))
    same = lambda k, c: (F.col(f"{k}.own") & F.col(f"{k}.value").isNotNull() & F.col(c).isNotNull()).cast("int")
    b = members.select("member_id", "family_id", F.trim("name").alias("name"), "birthday", "id_tail", "score")
    known = F.col("birthday").isNotNull().cast("int") + F.col("id_tail").isNotNull().cast("int")
    order = F.struct(F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("score"), (-known).alias("known"), "member_id")
    each = b.withColumn("_kb", F.explode(F.array(has(F.col("birthday")), any_of(F.col("birthday"))))).withColumn("_kt", F.explode(F.array(has(F.col("id_tail")), any_of(F.col("id_tail")))))
    best = each.groupBy(*keys).agg(F.min(order).alias("r"))
    a = asked.select("person_id", "family_id", F.trim("name").alias("name"), F.col("birthday").alias("_b"), F.col("id_tail").alias("_t"))
    profiles = a.where("name <> ''").select(*who).distinct()
    asks = lambda c: F.when(c.isNull(), F.array(any_of(c))).otherwise(F.array(has(c), has(F.when(F.lit(False), c))))
    met = profiles.withColumn("_kb", F.explode(asks(F.col("_b")))).withColumn("_kt", F.explode(asks(F.col("_t")))).join(best.hint("merge"), keys)
    first = met.groupBy(*who).agg(F.min(F.struct(-same("_kb", "_b"), -same("_kt", "_t"), "r"))["r"]["member_id"].alias("member_id"))
    first = written(first, "best_members").select(*[F.col(c).alias(f"_of{c}") for c in who], "member_id")  # so that its size is known
    return a.join(first, reduce(lambda x, y: x & y, [a[c].eqNullSafe(first[f"_of{c}"]) for c in who]), "left").select("person_id", "member_id")


def first_by_containment(left: DataFrame, right: DataFrame, key: str, text: str, order: list[Column]) -> DataFrame:
    """Of each left key, the first right row in order whose text is equal, holds it or is held by it."""
    pairs = containment_pairs(left, right, key, text)
    return best_per_key(pairs.join(right, pairs["right_key"] == right[key]), ["left_key"], order).select("left_key", "right_key")


