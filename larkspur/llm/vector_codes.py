"""Vector code compression: a product quantiser whose nearest entries are looked up through memoised grid cells.

Vectors are cut into consecutive parts; each part has a codebook of up to `entries` integer points, fitted by Lloyd rounds
over all vectors. A part is coded by its nearest entry (squared Euclidean distance, ties to the lower index).

To find it, the part's coarse cell of a grid is hashed. A cell's box has a least and a greatest distance to every entry; an
entry whose least distance is beyond the smallest greatest distance is dominated: it is nearest nowhere in the box. The
entries that are left are remembered for the cell, and only they are evaluated exactly. A ball around the box, which
needs one matrix product for all cells, rules out most entries before the distances to the box are worked out. The cell's side
is a power of two, chosen from the codebook so that the cell's diagonal is about a third of the mean distance between an
entry and its nearest neighbour. A task remembers up to MEMO_CELLS cells of a part; beyond that, cells are worked out each
time they are met. Results never depend on the grid.

The rounds are map-only passes over a compact integer table; what is shuffled is one row of sums per entry and task, and
what reaches the driver is the codebooks.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do those of another length
than most (at equal counts the shorter wins), which have no parts in common, and those with a component of 32768 or more
in size, whose squared distances would leave 64 bits; a length that is no multiple of the number of parts gives the first parts one component more; with fewer
vectors than entries the codebooks are shorter; equal vectors take an entry each at the start, and the lower index wins;
rows that share a vec_id are vectors of their own, ordered by their components at the start; a null vec_id comes last; an entry
that no vector uses stays; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.scratch import small_batches, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components are below this in size, so sums of squares stay within 64 bits.
LARGEST = 1 << 25
#: Cells that a task remembers for each part.
MEMO_CELLS = 1 << 16
#: Distances that are worked out together.
CHUNK = 1 << 16


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: the vectors that take part, as integers floor(scale * x), written to the shared folder."""
    x = F.col("embedding").cast("array<double>")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).where("x IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST)))
    rows = written(rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v")), "integers")
    most = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("v") == (most["size"] if most else 0))


def cuts(size: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Ranges of the parts; the first ones are one longer where the size is no multiple."""
    base, more = divmod(size, parts)
    stops = np.cumsum([base + (i < more) for i in range(parts)]).tolist()
    return list(zip([0, *stops[:-1]], stops))


class Grid:
    """Nearest entries of a part's codebook, through remembered cells."""

    def __init__(self, book: np.ndarray, memo_cells: int = MEMO_CELLS):
        self.book, self.size = book, book.shape[1]
        self.floats = book.astype(float)
        self.squares = (self.floats**2).sum(axis=1)
        self.side = self._side()
        # what rounding may hide in a distance worked out by a matrix product
        self.slack = 1e-6 * (1 + float(np.abs(self.floats).max(initial=0)) * np.sqrt(max(self.size, 1)))
        self.most = memo_cells
        self.memo: dict[bytes, np.ndarray] = {}

    def _side(self) -> int:
        apart = self.squares[:, None] + self.squares[None, :] - 2 * (self.floats @ self.floats.T)
        np.fill_diagonal(apart, np.inf)
        near = np.sqrt(np.maximum(apart.min(axis=1, initial=np.inf), 0))
        near = near[np.isfinite(near)]
        wanted = float(near.mean()) / 3 / np.sqrt(max(self.size, 1)) if len(near) else 1.0
        return 1 << max(0, int(np.log2(max(wanted, 1.0))))

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries, in order, that no other dominates, for each cell."""
        low = cells * self.side
        high = low + (self.side - 1)
        middle, radius = (low + high) / 2, (self.side - 1) / 2 * np.sqrt(self.size)
        square = (middle**2).sum(axis=1)[:, None] + self.squares[None, :] - 2 * (middle @ self.floats.T)
        far = np.sqrt(np.maximum(square, 0))
        slack = self.slack + 1e-6 * (1 + np.abs(middle).max(axis=1, initial=0))
        who, at = np.nonzero(far <= (far.min(axis=1) + 2 * radius + slack)[:, None])
        out: list[np.ndarray] = []
        bounds = np.searchsorted(who, np.arange(len(cells) + 1))
        c = self.book[at]
        least, most = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for i in range(self.size):
            lo, hi = low[who, i], high[who, i]
            least += np.maximum(np.maximum(lo - c[:, i], c[:, i] - hi), 0) ** 2
            most += np.maximum(np.abs(c[:, i] - lo), np.abs(c[:, i] - hi)) ** 2
        best = np.minimum.reduceat(most, bounds[:-1]) if len(cells) else most
        keep = least <= best[who]
        who, at = who[keep], at[keep]
        bounds = np.searchsorted(who, np.arange(len(cells) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            out.append(at[a:b])
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance, exactly, for each row."""
        cells = np.ascontiguousarray(np.floor_divide(x, self.side).astype(np.int64))
        keys = [row.tobytes() for row in cells]
        known = {k: self.memo[k] for k in set(keys) if k in self.memo}
        new = {k: i for i, k in enumerate(keys) if k not in known}
        rows = max(1, CHUNK // max(1, len(self.book)))
        names, places = list(new), list(new.values())
        for lo in range(0, len(names), rows):
            for k, found in zip(names[lo : lo + rows], self.candidates(cells[places[lo : lo + rows]])):
                known[k] = found
                if len(self.memo) < self.most:
                    self.memo[k] = found
        sets = [known[k] for k in keys]
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        lo = 0
        while lo < len(x):
            hi, pairs = lo, 0
            while hi < len(x) and (hi == lo or pairs + len(sets[hi]) <= CHUNK):
                pairs += len(sets[hi])
                hi += 1
            each = np.array([len(s) for s in sets[lo:hi]])
            at, starts = np.concatenate(sets[lo:hi]), np.cumsum(each) - each
            d = ((np.repeat(x[lo:hi], each, axis=0) - self.book[at]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(d, starts)
            first = np.where(d == np.repeat(least, each), at, len(self.book))  # candidates are in order, so the lower index wins
            index[lo:hi], error[lo:hi] = np.minimum.reduceat(first, starts), least
            lo = hi
        return index, error


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)


def _next_books(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One Lloyd round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # the codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(x) for x in sent.value]
        sums, counts = [np.zeros_like(x) for x in sent.value], [np.zeros(len(x), np.int64) for x in sent.value]
        for b in batches:
            if b.num_rows:
                x, start = _matrix(b), 0
                for p, grid in enumerate(grids):
                    part = x[:, start : start + grid.size]
                    index, _ = grid.nearest(part)
                    np.add.at(sums[p], index, part)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
                    start += grid.size
        for p, (s, c) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(c)
            if len(used) and s.shape[1]:
                place, width = np.repeat(used, s.shape[1]), np.tile(np.arange(s.shape[1]), len(used))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), p, np.int32)), pa.array(place.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(s[used].ravel()), pa.array(np.repeat(c[used], s.shape[1]))], ["part", "entry", "at", "total", "n"])

    made = rows.select("v").mapInArrow(run, "part int, entry int, at int, total long, n long")
    total, n = F.sum("total").cast("decimal(38,0)"), F.sum("n")
    means = made.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), n.alias("n"))
    out = [x.copy() for x in books]
    for r in means.collect():  # the codebooks
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, fitted over all rows of `whole_numbers`."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).toArrow()  # `entries` rows at most
    if not first.num_rows:
        return []
    x = np.array(first["v"].to_pylist(), np.int64)
    books = [x[:, a:b] for a, b in cuts(x.shape[1], parts)]
    for _ in range(rounds):
        books = _next_books(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (an index for each part), error (squared distances summed over the parts)."""
    out = rows.select("vec_id", "label").schema.add("codes", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    if not books:
        return rows.sparkSession.createDataFrame([], out)
    sent = rows.sparkSession.sparkContext.broadcast(books)  # the codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(x) for x in sent.value]
        for b in batches:
            x, start, codes, error = _matrix(b) if b.num_rows else np.zeros((0, 0), np.int64), 0, [], np.zeros(b.num_rows, np.int64)
            for grid in grids if b.num_rows else []:
                index, d = grid.nearest(x[:, start : start + grid.size])
                codes.append(index)
                error += d
                start += grid.size
            flat = np.stack(codes, axis=1).ravel() if codes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * len(grids), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, pa.array(error)], ["vec_id", "label", "codes", "error"])

    return rows.mapInArrow(run, out)


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """vec_id, embedding: each coded vector as the entries that stand for its parts."""
    entries = [F.array(*[F.array(*[F.lit(v / scale) for v in row]) for row in book.tolist()]) for book in books]
    return coded.select("vec_id", F.concat(*[F.get(e, F.get("codes", F.lit(p))) for p, e in enumerate(entries)]).alias("embedding"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the error summed over equal labels, nulls together. A label of any size is summed before it is joined."""
    coded = written(coded, "codes")
    by = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(written(by, "label_errors"), F.col("label").eqNullSafe(F.col("of"))).drop("of")


def hexadecimal(codes: str) -> Column:
    """Two hexadecimal digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def op12_vector_codes(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    small_batches(spark)
    rows = whole_numbers(vectors)
    books = fit(rows)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    coded = with_label_error(encode(rows, books))
    return coded.select("vec_id", hexadecimal("codes").alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by whole distance tables, one step per round."""
    width = "len(v) // 4"
    steps = [
        f"""
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT k, p, v[p * ({width}) + 1 : (p + 1) * ({width})] AS x FROM kept, range(4) r(p)),
book0 AS MATERIALIZED (SELECT p, CAST(k - 1 AS INT) AS e, x AS c FROM parts WHERE k <= 256)"""
    ]
    for i in range(5):
        steps.append(
            f"""
near{i} AS MATERIALIZED (SELECT k, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT k, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN book{i} USING (p)) GROUP BY ALL)"""
        )
        if i < 4:
            steps.append(
                f"""
mean{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (
  SELECT p, e, j, floor(sum(x[j]) / count(*)) AS m FROM near{i} JOIN parts USING (k, p), range(1, 4096) g(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"""
            )
    steps.append(
        """
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY k)"""
    )
    return f"WITH {','.join(steps)}\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (k), digest"


ORACLE = _sql()
