"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and ordered along Hilbert curves, one for each projection.
Each ordering is range-partitioned into windows of about `WINDOW_ROWS` vectors; where one key is shared by more, they
are dealt over parts of the window, which a query visits all, and crowds of queries are dealt likewise. A query is compared with the
windows around its own key in every ordering; the results of the windows merge and are ranked anew. What its own
windows give sets a bound, so the windows around add only rows that can enter the result.

How many windows to each side are read (the radius) is fitted on a bounded sample of queries that are searched
exhaustively, in blocks: it is the least radius that reaches `recall` on them. Data without structure need many
windows, clustered data few. Every row is indexed.

Largest inner product is turned into nearness on a sphere by one more coordinate, so long vectors need no case
of their own. Equal vectors are indexed once, with their smallest ids, so a crowd of copies costs one place.

Edge cases: vectors that are null or empty, zero, of another length than most, or that hold null or non-finite
components take no part, neither as query nor as candidate; ties go to the smaller vec_id; fewer candidates
than `k` give fewer rows; rows that share a vec_id count once, by the best score; a query is never paired with its own vec_id;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.scratch import written

CURVES = 3
AXES = 6
AXIS_BITS = 8
WINDOW_ROWS = 1024
SAMPLE_QUERIES = 256
#: Queries that one task compares with a window at a time.
QUERY_ROWS = 8192


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows) with `bits` bits per axis."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the axes, highest bit first
        for i in range(axes):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Keys of vectors in several shifted Hilbert orderings."""

    def __init__(self, size: int, longest: float, seed: int = 7):
        self.longest = longest
        self.axes = min(AXES, size + 1)
        r = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(r.standard_normal((size + 1, size + 1)))[0][:, : self.axes] for _ in range(CURVES)]
        self.shifts = [r.random(self.axes) * 0.5 for _ in range(CURVES)]
        self.spread = 3.0 / np.sqrt(size + 1)

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One row of keys per vector."""
        norm = np.linalg.norm(x, axis=1)
        if query:
            lifted = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
        else:
            lifted = np.hstack([x, np.sqrt(np.maximum(self.longest**2 - norm**2, 0))[:, None]]) / self.longest
        out = []
        for turn, shift in zip(self.turns, self.shifts):
            unit = (np.clip(lifted @ turn / self.spread, -1, 1) + 1) / 2
            cells = np.minimum(((unit + shift) / 1.5 * (1 << AXIS_BITS)).astype(np.int64), (1 << AXIS_BITS) - 1)
            out.append(hilbert(cells, AXIS_BITS))
        return np.stack(out, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * x[:, i]
    return total


def _best(query_ids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: list, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    """The k best (query, candidate) pairs of every query, each candidate once by its best score, none below its `least` score.

    ids: sorted candidate ids of each vector.
    """
    rows = []
    width = np.array([len(i) for i in ids])
    flat, start = np.concatenate(ids), np.cumsum(width) - width
    longest = np.sqrt((x * x).sum(axis=1).max())
    for lo in range(0, len(q), 256):
        part, own = q[lo : lo + 256], query_ids[lo : lo + 256]
        rough = part @ x.T
        # what rounding may hide: products this near to the last one kept are worked out exactly, so ties are ordered by id
        slack = 8 * x.shape[1] * np.finfo(float).eps * longest * np.sqrt((part * part).sum(axis=1))
        keep = k + 8
        while True:
            keep = min(keep, x.shape[0])
            edge = np.partition(rough, x.shape[0] - keep, axis=1)[:, x.shape[0] - keep]
            who, at = np.nonzero(rough >= (edge - slack)[:, None])
            score = _exact(part[who], x[at])
            each = width[at]
            who, score, at = np.repeat(who, each), np.repeat(score, each), np.repeat(start[at], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            vec = flat[at]
            other = vec != own[who]
            who, score, vec = who[other], score[other], vec[other]
            order = np.lexsort((-score, vec, who))
            who, score, vec = who[order], score[order], vec[order]
            once = np.ones(len(who), bool)
            once[1:] = (who[1:] != who[:-1]) | (vec[1:] != vec[:-1])
            who, score, vec = who[once], score[once], vec[once]
            # vectors of the same ids are fewer candidates: look further
            if keep == x.shape[0] or np.bincount(who, minlength=len(part)).min() >= k + 7:
                break
            keep *= 2
        if least is not None:
            enough = score >= least[lo + who]
            who, score, vec = who[enough], score[enough], vec[enough]
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        first = np.searchsorted(who, who)
        some = np.arange(len(who)) - first < k
        rows.append(pd.DataFrame({"query_id": own[who[some]], "vec_id": vec[some], "score": score[some]}))
    return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: for every query the k nearest candidates found."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors).distinct(), usable(queries).distinct()
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"))
    shape = sizes.orderBy(F.desc("n"), "size").first()
    out = "query_id long, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.where(F.size("v") == shape["size"]), asked.where(F.size("v") == shape["size"])
    # Equal vectors: one place, with the k + 1 smallest ids (a query may be among them).
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    places = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = places.count()
    shape = (shape["size"], shape["longest"])

    def keys_of(query: bool, sent=None, whole: bool = True):
        """curve, key, window of vectors, and what else they hold; without cuts all are in one window."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            curves = Curves(*shape)  # the same in every task, from its seed
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                keys = curves.keys(x, query)
                for c in range(keys.shape[1]):
                    place = np.searchsorted(sent.value[c], keys[:, c]) if sent is not None else np.zeros(b.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * b.num_rows, pa.int32()), pa.array(keys[:, c]), pa.array(place.astype(np.int32)), *(b.columns if whole else [])], ["curve", "key", "window", *(b.schema.names if whole else [])])

        return run

    windows = max(1, -(-n // WINDOW_ROWS))
    sent = None
    if windows > 1:
        wanted = [i / windows for i in range(1, windows)]
        keys = places.select("v").mapInArrow(keys_of(False, whole=False), "curve int, key long, window int")
        got = keys.groupBy("curve").agg(F.percentile_approx("key", wanted, 10 * windows).alias("cuts")).collect()  # one row per curve
        sent = spark.sparkContext.broadcast({r["curve"]: np.array(r["cuts"], np.int64) for r in got})  # a number for each window
    keyed = places.mapInArrow(keys_of(False, sent), "curve int, key long, window int, v array<double>, ids array<long>")
    keyed_queries = asked.select("v", "vec_id").mapInArrow(keys_of(True, sent), "curve int, key long, window int, v array<double>, vec_id long")
    total = asked.count()

    # The radius: search a sample of queries everywhere and see how far apart the windows of the pairs are.
    radius = 0
    if windows > 1:
        share = int(min(1.0, SAMPLE_QUERIES / max(total, 1)) * (1 << 20)) + 1
        sample = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).toArrow()  # about SAMPLE_QUERIES rows
        if sample.num_rows:
            q_ids = sample["vec_id"].to_numpy()
            q = sample["v"].combine_chunks().flatten().to_numpy().reshape(len(q_ids), -1)
            probe = spark.sparkContext.broadcast((q_ids, q))

            def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                        found = _best(*probe.value, x, [np.array(i.as_py()) for i in b.column("ids")], k)
                        yield pa.RecordBatch.from_pandas(found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

            every = places.select("v", "ids").mapInArrow(everywhere, out)
            true = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "vec_id")
            true = written(true, "sample_neighbours")
            there = keyed.select("curve", "window", F.explode("ids").alias("vec_id")).join(F.broadcast(true), "vec_id")  # SAMPLE_QUERIES * k rows
            here = keyed_queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("curve", F.col("window").alias("own"), F.col("vec_id").alias("query_id"))
            apart = there.join(here, ["curve", "query_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("window") - F.col("own"))).alias("apart"))
            counts = {r["apart"]: r["n"] for r in apart.groupBy("apart").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per distance
            held = 0
            for radius in sorted(counts):
                held += counts[radius]
                if held >= recall * sum(counts.values()):
                    break

    # Queries that visit a window on average, dealt over salts; each salt holds the window's vectors.
    salts = max(1, -(-total * min(2 * radius + 1, windows) // (windows * QUERY_ROWS)))
    # Windows that hold far more vectors than others, and those that far more queries visit.
    placed = keyed_queries
    by_window = [df.groupBy("curve", "window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 1.5 * WINDOW_ROWS) for df in (keyed, placed)]
    held, visits = ({(r["curve"], r["window"]): r["n"] for r in df.collect()} for df in by_window)  # crowded windows only
    visited: dict = {}
    for (c, w), n in visits.items():
        for near in range(max(0, w - radius), min(windows - 1, w + radius) + 1):
            visited[c, near] = visited.get((c, near), 0) + n
    crowded = [(c, w, int(held.get((c, w), 0) / WINDOW_ROWS + 0.5) or 1, salts - (-visited.get((c, w), 0) // QUERY_ROWS)) for c, w in {**held, **visited}]
    shares = F.broadcast(spark.createDataFrame(crowded, "curve int, window int, parts int, salts int"))

    def dealt(df: DataFrame) -> DataFrame:
        if not crowded:
            return df.withColumn("parts", F.lit(1)).withColumn("salts", F.lit(salts))
        return df.join(shares, ["curve", "window"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("salts", F.coalesce("salts", F.lit(salts)))

    right = dealt(keyed).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    on = ["curve", "window", "part", "salt"]

    def compare(left: DataFrame) -> DataFrame:
        def merge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return _best(a["vec_id"].to_numpy(), np.stack(a["v"]), np.stack(b["v"]), [np.asarray(i) for i in b["ids"]], k, a["least"].to_numpy())

        left = dealt(left).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*on, "vec_id", "v", "least")
        return left.groupBy(*on).cogroup(right.select(*on, "v", "ids").groupBy(*on)).applyInPandas(merge, out)

    # First a query's own windows; the k-th score found there is a bound that the other windows' rows must reach.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = compare(placed.withColumn("least", F.lit(float("-inf")))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    if radius:
        found = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "own_windows")
        bound = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound"))
        near = F.sequence(F.greatest(F.lit(0), F.col("window") - radius), F.least(F.lit(windows - 1), F.col("window") + radius))
        others = placed.withColumn("near", F.explode(near)).where("near != window").withColumn("window", F.col("near")).drop("near")
        others = others.join(bound, others["vec_id"] == bound["query_id"], "left").withColumn("least", F.coalesce("bound", F.lit(float("-inf"))))
        more = compare(others)
        found = found.drop("rank").unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
