"""Text retrieval: postings, BM25, rank fusion, selection with caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.relations import best_per_key
from larkspur.sources.shared import written

K1, B, RRF_OFFSET = 1.2, 0.75, 60


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score of the documents that hold a term. One scan counts the terms; what is shuffled is one row of totals per task."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # Every word between two spaces of its own: plain replacement then counts words. The lambda names that text once.
    spaced = F.trim(F.regexp_replace(low, "[^a-z0-9]+", "  "))

    def times(c: Column, part: str) -> Column:
        return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")

    def measures(c: Column) -> Column:
        padded = F.concat(F.lit(" "), c, F.lit(" "))
        length = F.when(c == "", 0).otherwise(times(c, "  ") + 1).alias("length")
        return F.struct(length, *[times(padded, f" {t.lower()} ").alias(f"tf{i}") for i, t in enumerate(terms)])

    measured = docs.select(key, F.transform(F.array(spaced), measures)[0].alias("x")).select(key, "x.*")
    stats = measured.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    joined = measured.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.select(key, score.alias("score"))


def global_ranks(hits: DataFrame, keys: list[str], order: list[Column], name: str, parts: int = 64) -> DataFrame:
    """Adds the rank from 1 within each key, without bringing a key's rows into one task.

    Rows are dealt by range of the order, ranked within a range, and raised by the rows of the ranges before, of which
    only counts are compared. The ranges come from a sample, so the dealt rows are written once: planned twice, they could be
    dealt in two ways.
    """
    dealt = hits.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    near = written(dealt.withColumn("_near", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))), "ranges")
    counts = near.groupBy(*keys, "_part").agg(F.max("_near").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return near.join(before.drop("_n"), [*keys, "_part"]).withColumn(name, F.col("_near") + F.col("_before")).drop("_part", "_near", "_before")


def fuse_ranks(hits: DataFrame, key: str, term: str, order: list[Column]) -> DataFrame:
    """key, score: sum over terms of 1 / (60 + rank), ranks from 1."""
    ranked = global_ranks(hits, [term], order, "_rank")
    return ranked.groupBy(key).agg(F.sum(1 / (F.lit(RRF_OFFSET) + F.col("_rank"))).alias("score"))


def capped(df: DataFrame, order: list[Column], caps: list[tuple[str, int]], limit: int) -> DataFrame:
    """Best rows with at most so many per value of each capped column, applied one after another, then a limit."""
    for column, most in caps:
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy(column).orderBy(*order))).where(F.col("_k") <= most).drop("_k")
    return df.orderBy(*order).limit(limit)


def catalog_score(name: Column, query: str) -> Column:
    """1000 for equality, 800 less the extra length for containment, 760 less for two letters exchanged, else overlap of bigrams and characters."""
    low = F.lower(name)
    q = query.lower()
    pairs = [q[i : i + 2] for i in range(len(q) - 1)]
    shared = sum((F.contains(low, F.lit(p)).cast("int") for p in dict.fromkeys(pairs)), F.lit(0))
    chars = sum((F.contains(low, F.lit(c)).cast("int") for c in dict.fromkeys(q)), F.lit(0))
    fuzzy = 40 * shared + 4 * chars - F.least(F.lit(30), F.abs(F.length(low) - len(q)))
    swapped = [q[:i] + q[i + 1] + q[i] + q[i + 2 :] for i in range(len(q) - 1)] if len(q) >= 4 else []
    near = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in swapped], F.lit(False))
    return (
        F.when(low == q, 1000)
        .when(F.contains(low, F.lit(q)), 800 - (F.length(low) - len(q)))
        .when(near, 760 - F.least(F.lit(30), F.length(low) - len(q)))
        .otherwise(fuzzy)
    )


#: Weights of a text and of the words that stand before it.
FIELD_WEIGHTS = {"content": 1.0, "prefix": 0.35}


def phrase_bm25(chunks: DataFrame, key: str, phrases: list[str], weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """key, phrase, score of the rows whose fields hold a phrase of three characters or more, as runs of three letters in a row.

    The length of a field is its number of such runs. All phrases are counted in one scan, and one row of totals is kept.
    """
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in weights}
    times = lambda c, p: ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)).cast("int")
    asked = [p.lower() for p in phrases if len(p) >= 3]
    lengths = {f: F.greatest(F.length(c) - 2, F.lit(0)) for f, c in low.items()}
    measured = chunks.select(key, *[n.alias(f"len_{f}") for f, n in lengths.items()], F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), *[times(c, p).alias(f"tf_{f}") for f, c in low.items()]) for p in asked])).alias("m")).select(key, *[f"len_{f}" for f in weights], "m.*")
    held = reduce(lambda a, b: a | b, [F.col(f"tf_{f}") > 0 for f in weights])
    total = chunks.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"mean_{f}") for f, n in lengths.items()]).first().asDict()
    return phrase_scores(measured.where(held), key, weights, total)


def phrase_scores(hits: DataFrame, key: str, weights: dict[str, float], total: dict) -> DataFrame:
    """key, phrase, score of hits (key, phrase, len_ and tf_ of each field), with n and the mean_ lengths of all rows in total."""
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    joined = hits.join(df, "phrase")
    # fields share one length and one frequency, by their weights
    tf = reduce(lambda a, b: a + b, [w * F.col(f"tf_{f}") for f, w in weights.items()])
    length = reduce(lambda a, b: a + b, [F.col(f"len_{f}") for f in weights])
    mean = sum(total[f"mean_{f}"] or 0.0 for f in weights)
    idf = F.greatest(F.log((F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
    return joined.select(key, "phrase", score.alias("score"))


def search_chunks(chunks: DataFrame, key: str, query: str, updated: str, limit: int) -> DataFrame:
    """key, score, place: the best chunks for a query; one of fewer than three characters finds what holds it, newest first."""
    limit = max(1, min(50, limit))
    if len(query) < 3:
        holds = reduce(lambda a, b: a | b, [F.contains(F.lower(f), F.lit(query.lower())) for f in FIELD_WEIGHTS])
        found, order = chunks.where(holds).select(key, F.lit(0.0).alias("score"), updated), [F.desc(updated), F.col(key)]
    else:
        found, order = phrase_bm25(chunks, key, [query]).select(key, "score"), [F.desc("score"), F.col(key)]
    best = found.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(key, "score", "place")  # at most 50 rows


#: What each kind of question is answered from.
PLANS = {
    "exact_field": (True, 2, "fact,clause,formula"),
    "clause_explanation": (True, 2, "clause,definition,process,fact"),
    "product_advantage": (True, 6, "claim,fact,clause,process"),
}
OTHER_PLAN = (False, 4, "")


def retrieval_plan(kind: Column) -> Column:
    """use_facts, materials and kinds (joined) for a kind of question."""
    form = lambda p: F.struct(F.lit(p[0]).alias("use_facts"), F.lit(p[1]).alias("materials"), F.lit(p[2]).alias("kinds"))
    out = reduce(lambda a, k: (F if a is None else a).when(kind == k, form(PLANS[k])), PLANS, None)
    return out.otherwise(form(OTHER_PLAN))


def with_required(ranked: DataFrame, chunks: DataFrame, key: str, required: str) -> DataFrame:
    """key, score: ranked chunks and, with score 0, those they need as context and that are not ranked themselves."""
    wanted = ranked.join(chunks, key).select(F.explode(required).alias(key)).distinct().join(ranked.select(key), key, "left_anti")
    return ranked.select(key, "score").unionByName(wanted.join(chunks.select(key), key, "left_semi").withColumn("score", F.lit(0.0)))


def merged_evidence(rounds: list[DataFrame], key: str) -> DataFrame:
    """key, round, score: evidence of several searches, each once, from the first that found it."""
    both = reduce(lambda a, b: a.unionByName(b), [r.select(key, "score").withColumn("round", F.lit(i)) for i, r in enumerate(rounds, 1)])
    return best_per_key(both, [key], [F.col("round"), F.desc("score")])
