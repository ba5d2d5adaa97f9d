"""State as tables: claims with leases, versioned saves, memories, publishing, payments. Each is a fold over events, made of windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.relations import best_per_key
from larkspur.sources.shared import written


def claim_jobs(jobs: DataFrame, now: Column, worker: str, lease: str, limit: int) -> DataFrame:
    """Jobs that a worker claims: pending, failed, or in work with a lease that ran out; the oldest `limit` of them.

    jobs: id, status, updated_at, lease_until, attempts. The claimed rows come back with their token, lease and attempt.
    """
    open_ = F.col("status").isin("pending", "failed") | ((F.col("status") == "processing") & (F.col("lease_until") <= now))
    some = jobs.where(open_).orderBy("updated_at", "id").limit(max(1, min(500, limit)))
    token = F.concat_ws(":", F.lit(worker), F.col("id").cast("string"), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    return some.withColumns({"status": F.lit("processing"), "token": token, "lease_until": now + F.expr(f"INTERVAL {lease}"), "attempts": F.col("attempts") + 1, "updated_at": now})


def finish_jobs(claimed: DataFrame, results: DataFrame) -> DataFrame:
    """Claimed jobs after their results (id, token, error): done or failed where the token is theirs, else as they were."""
    r = results.select("id", F.col("token").alias("_t"), F.col("error").alias("_e"))
    joined = claimed.join(r, "id", "left")
    own = F.coalesce(F.col("_t") == F.col("token"), F.lit(False))
    status = F.when(own & F.col("_e").isNull(), "dispatched").when(own, "failed").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "last_error": F.when(own, F.coalesce(F.substring("_e", 1, 500), F.lit(""))).otherwise(""), "token": F.when(own, "").otherwise(F.col("token"))}).drop("_t", "_e")


def versioned_saves(saves: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds accepted and version to saves that each expect a version: accepted if the key is at it by then.

    The n-th accepted save of a key makes version n, so a save is accepted if it expects one more than the greatest number
    accepted before: the longest chain 0, 1, 2, ... in order. One ordered pass by key, streamed, finds it.
    """
    import pyarrow as pa

    def fold(batches):
        last, version, begun = None, 0, False
        for b in batches:
            accepted, versions = [], []
            for k, e in zip(zip(*[b.column(c).to_pylist() for c in key]), b.column("expected").to_pylist()):
                if not begun or k != last:
                    last, version, begun = k, 0, True
                ok = e == version
                version += ok
                accepted.append(ok)
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(accepted), pa.array(versions, pa.int64())], [*b.schema.names, "accepted", "version"])

    rows = saves.repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInArrow(fold, rows.withColumns({"accepted": F.lit(True), "version": F.lit(0).cast("long")}).schema)


def fold_memories(statements: DataFrame, owner: str, key: str, most: int) -> DataFrame:
    """owner, key, value, confidence, evidence, status of what statements (owner, key, value, confidence, at, id) add up to.

    A value stated again is reinforced: the greatest confidence and all evidence; other values of the key make all of
    them conflicted. Of an owner the `most` newest stay, the others are archived.
    """
    each = statements.groupBy(owner, key, "value").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence"), F.max(F.struct("at", "id")).alias("_last"))
    values = F.count(F.lit(1)).over(Window.partitionBy(owner, key))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("_last"), key, "value"))
    status = F.when(F.col("_k") > most, "archived").when(F.col("_n") > 1, "conflicted").otherwise("active")
    return each.withColumns({"_n": values, "_k": place}).withColumn("status", status).select(owner, key, "value", "confidence", "evidence", "status")


def publish_log(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, version, content, status after events (publish: content; rollback: to a version) in order.

    Each event makes the next version, also a rollback, which copies its source's content; the last one is published,
    the others archived. A rollback to a rollback leads on to the version that holds content, however many
    there are between.
    """
    numbered = events.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    rows = numbered.select(key, "version", "content", F.when(F.col("action") == "rollback", F.col("target")).alias("source"))
    last = F.max("version").over(Window.partitionBy(key))
    # sources are earlier versions, so following them ends; each round jumps twice as far, until none leads on
    jumps = written(rows.select(key, "version", F.coalesce("source", "version").alias("root")), "jumps")
    while True:
        step = jumps.select(key, F.col("version").alias("root"), F.col("root").alias("_next"))
        after = jumps.join(step.hint("merge"), [key, "root"], "left").select(key, "version", F.coalesce("_next", "root").alias("root"), (F.coalesce("_next", "root") != F.col("root")).alias("_on"))
        after = written(after, "jumps")
        jumps = after.drop("_on")
        if after.where("_on").isEmpty():
            break
    content = rows.select(key, F.col("version").alias("root"), F.col("content").alias("_c"))
    full = rows.join(jumps.hint("merge"), [key, "version"]).join(content.hint("merge"), [key, "root"], "left")  # numbers take little room in files, so their size would mislead
    return full.withColumn("_last", last).select(key, "version", F.coalesce("_c", "content").alias("content"), F.when(F.col("version") == F.col("_last"), "published").otherwise("archived").alias("status"))


def paid_orders(payments: DataFrame, orders: DataFrame, days: int) -> DataFrame:
    """order_id, outcome, days: what the payments of an order come to.

    payments: order_id, amount, at, id; orders: order_id, user_id, amount, payable. The first payment of the right amount
    for a payable order counts, later ones are repeats, others are refused; a user's paid orders extend the time one
    after another, so days is what the user has after it.
    """
    met = payments.join(orders.withColumnRenamed("amount", "_due"), "order_id", "left")
    right = F.coalesce(F.col("payable") & (F.abs(F.col("amount") - F.col("_due")) < 0.005), F.lit(False))
    judged = met.withColumn("_right", right)
    first = best_per_key(judged.where("_right"), ["order_id"], [F.col("at"), F.col("id")]).select("order_id", F.col("id").alias("_first"))
    outcome = F.when(F.col("id") == F.col("_first"), "applied").when(F.col("_right"), "repeated").when(~F.coalesce("payable", F.lit(False)), "not_payable").otherwise("amount_mismatch")
    done = judged.join(first, "order_id", "left").withColumn("outcome", outcome)
    so_far = F.sum(F.when(F.col("outcome") == "applied", days).otherwise(0)).over(Window.partitionBy("user_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return done.withColumn("days", so_far).select("order_id", "id", "outcome", "days")


def sync_issues(current: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, columns, status: open issues of a key stay while the set found is the same; else they are archived and the new set is open."""
    both = current.select(key, *columns, F.lit(1).alias("_s")).unionByName(found.select(key, *columns, F.lit(2).alias("_s"))).distinct()
    each = both.groupBy(key, *columns).agg(F.sum("_s").alias("_s"))
    changed = each.groupBy(key).agg((F.min("_s") < 3).alias("_changed")).where("_changed")
    old = current.join(changed, key, "left").withColumn("status", F.when(F.col("_changed"), "archived").otherwise("open")).drop("_changed")
    new = found.join(changed, key, "left_semi").withColumn("status", F.lit("open"))
    return old.select(key, *columns, "status").unionByName(new.select(key, *columns, "status"))


def keepers(members: DataFrame) -> DataFrame:
    """member_id, keeper: the member of a family that stands for all of one person.

    members: member_id, family_id, name, identity (null if unknown), score. Members of one name and identity are one person;
    those without one belong to the only identity of their name, or to each other where there is none; else they stay. The
    best known stays, then one with an identity, then the smaller id.
    """
    named = members.withColumn("_name", F.regexp_replace("name", r"\s+", ""))
    kinds = named.groupBy("family_id", "_name").agg(F.count_distinct("identity").alias("_n"), F.max("identity").alias("_one"))
    alone = F.concat(F.lit("#"), F.col("member_id").cast("string"))
    group = F.coalesce("identity", F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_n") == 0, F.lit("")).otherwise(alone))
    grouped = named.join(kinds, ["family_id", "_name"]).withColumn("_group", group)
    keys = ["family_id", "_name", "_group"]
    best = best_per_key(grouped, keys, [F.desc("score"), F.desc(F.col("identity").isNotNull()), F.col("member_id")]).select(*keys, F.col("member_id").alias("keeper"))
    return grouped.join(best, keys).select("member_id", "keeper")
